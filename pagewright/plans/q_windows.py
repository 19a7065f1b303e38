"""Window operators and ordered folds plus the task queries
built on the failure lifecycle."""

from pyspark.sql import functions as F

from ..functions import errors as E
from ..operators import failures as FL
from ..operators import links as LK
from ..operators import rates as RT
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers as RD
from ..sources import sinks as SK
from . import common as C
from . import oracle as O
from .q_exprs import CLASSIFY_SQL, POLICY_SQL
from .q_joins import NEW_LINKS_SQL, new_links
from .registry import query

DELAYS_SQL = """(SELECT regexp_extract(start_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain,
  arg_max(domain_delay, ord) AS domain_delay FROM fx_site WHERE domain_delay IS NOT NULL GROUP BY 1)"""


@query("frontier_first_n", f"""
SELECT site, url, rank FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS rank
FROM ({NEW_LINKS_SQL}) n) t WHERE rank <= 3""")
def frontier_first_n(spark, sf):
    return LK.frontier_first_n(new_links(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@query("page_budget", """
SELECT site, depth, url, rank FROM (SELECT site, depth, url, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS rank
FROM (SELECT DISTINCT site, depth, url FROM fx_fetch) d) t WHERE rank <= 10""")
def page_budget(spark, sf):
    from pyspark.sql import Window
    d = fx.fx_fetch(spark, sf).select("site", "depth", "url").distinct()
    w = Window.partitionBy("site").orderBy("depth", "url")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= 10)


@query("request_gap_wait", f"""
SELECT event_id, domain, CASE WHEN prev IS NULL THEN 0.0
  ELSE greatest(0.0, coalesce(d.domain_delay, 3.0) - (epoch_us(ts) - epoch_us(prev)) / 1000000.0) END AS wait_seconds
FROM (SELECT *, lag(ts) OVER (PARTITION BY domain ORDER BY ts, event_id) AS prev FROM fx_fetch) f
LEFT JOIN {DELAYS_SQL} d USING (domain)""")
def request_gap_wait(spark, sf):
    # project first: the ordered operators materialise their (chunked) input
    f = fx.fx_fetch(spark, sf).select("event_id", "ts", "domain")
    r = RT.request_gap_wait(f, C.delays(spark, sf))
    return r.select("event_id", "domain", "wait_seconds")


@query("trailing_request_rate", """
SELECT event_id, domain, n_trailing, n_trailing > 10 AS over_limit,
  CASE WHEN n_trailing > 10 THEN (epoch_us(oldest_ts) + 60000000 - epoch_us(ts)) / 1000000.0 END AS wait_seconds
FROM (SELECT event_id, domain, ts, count(*) OVER w AS n_trailing, min(ts) OVER w AS oldest_ts FROM fx_fetch
      WINDOW w AS (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)) t""")
def trailing_request_rate(spark, sf):
    r = RT.trailing_request_rate(fx.fx_fetch(spark, sf))
    return r.select("event_id", "domain", "n_trailing", "over_limit", "wait_seconds")


@query("trailing_request_rate_global", """
SELECT event_id, n_trailing, n_trailing > 10 AS over_limit,
  CASE WHEN n_trailing > 10 THEN (epoch_us(oldest_ts) + 60000000 - epoch_us(ts)) / 1000000.0 END AS wait_seconds
FROM (SELECT event_id, ts, count(*) OVER w AS n_trailing, min(ts) OVER w AS oldest_ts FROM fx_fetch
      WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)) t""")
def trailing_request_rate_global(spark, sf):
    r = RT.trailing_request_rate(fx.fx_fetch(spark, sf).select("event_id", "ts"), by=())
    return r.select("event_id", "n_trailing", "over_limit", "wait_seconds")


@query("consecutive_failures", """
SELECT event_id, domain, streak AS failure_streak, streak >= 5 AS alarm FROM (
  SELECT event_id, domain, CAST(fails - coalesce(max(CASE WHEN success THEN fails END)
    OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS streak
  FROM (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END)
    OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails FROM fx_fetch) a) b""")
def consecutive_failures(spark, sf):
    r = RT.consecutive_failures(fx.fx_fetch(spark, sf).select("event_id", "ts", "domain", "success"))
    return r.select("event_id", "domain", "failure_streak", "alarm")


@query("content_changed", """
SELECT page_key, seq, h AS content_hash, prev IS NULL OR h <> prev AS changed FROM (
  SELECT page_key, seq, md5(element_text) AS h, lag(md5(element_text)) OVER (PARTITION BY page_key ORDER BY seq) AS prev
  FROM fx_snapshot) t""")
def content_changed(spark, sf):
    from ..operators.changes import content_changed as cc
    return cc(fx.fx_snapshot(spark, sf), "page_key", "seq", "element_text")


@query("attempt_outcome", """
SELECT url, bool_or(success) AS success,
  CAST(coalesce(min(CASE WHEN success THEN attempt END), count(*)) AS INTEGER) AS attempts,
  CAST(coalesce(min(CASE WHEN success THEN attempt END), count(*)) - 1 AS INTEGER) AS retries
FROM (SELECT url, success, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS attempt FROM fx_fetch) t
WHERE attempt <= 3 GROUP BY url""")
def attempt_outcome(spark, sf):
    return FL.attempt_outcome(fx.fx_fetch(spark, sf))


@query("dedup_latest", """
SELECT url, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(success, (ts, event_id)) AS success
FROM fx_fetch GROUP BY url""")
def dedup_latest(spark, sf):
    f = fx.fx_fetch(spark, sf).select("url", "event_id", "ts", "success")
    return FL.dedup_latest(f, ["url"], ["ts", "event_id"])


# ------------------------------------------------------------------ 2.8

WALK_DEPTH = 6

# per site: three start pages and a page budget of its own (none for every fourth)
O.FX["fx_walk_seed"] = """SELECT site, concat('p', ord * 3 + k) AS node,
  CASE WHEN ord % 4 = 3 THEN NULL ELSE 10 + 45 * (ord % 4) END AS max_pages FROM fx_site, range(1, 4) r(k)"""


def _walk_sql() -> str:
    """The walks level by level, a CTE each."""
    levels = ["l0 AS (SELECT DISTINCT site, node FROM fx_walk_seed)"]
    for d in range(1, WALK_DEPTH + 1):
        before = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(d))
        levels.append(f"""t{d} AS ({before}),
n{d} AS (SELECT DISTINCT w.site, e.dst AS node FROM l{d - 1} w JOIN fx_edge e ON e.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM t{d} t WHERE t.site = w.site AND t.node = e.dst)),
r{d} AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY node) AS place FROM n{d}),
l{d} AS (SELECT r.site, r.node FROM r{d} r
  JOIN (SELECT site, max(max_pages) AS budget FROM fx_walk_seed GROUP BY site) b USING (site)
  JOIN (SELECT site, count(*) AS n FROM t{d} GROUP BY site) s USING (site)
  WHERE b.budget IS NULL OR r.place <= b.budget - s.n)""")
    return "WITH " + ",\n".join(levels) + "\n" + " UNION ALL ".join(
        f"SELECT site, node, {d} AS depth FROM l{d}" for d in range(WALK_DEPTH + 1))


@query("frontier_walk", _walk_sql())
def frontier_walk(spark, sf):
    s = fx.fx_site(spark, sf)
    seeds = s.select("site", F.explode(F.sequence(F.col("ord") * 3 + 1, F.col("ord") * 3 + 3)).alias("k"),
                     F.when(F.col("ord") % 4 != 3, 10 + 45 * (F.col("ord") % 4)).alias("max_pages"))
    seeds = seeds.select("site", F.concat(F.lit("p"), "k").alias("node"), "max_pages")
    return LK.site_walks(fx.fx_edge(spark, sf).select("src", "dst"), seeds, WALK_DEPTH)


# micro-steps: every request is an expiry check ('c'), its result ('u'), and
# for 403/429/503 a second failure ('f')
FETCH_STEPS_SQL = f"""SELECT domain, ts, ok, kind, base, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id, kind) AS rn
FROM (SELECT f.domain, f.ts, f.event_id, f.success AS ok, 'c' AS kind, coalesce(d.domain_delay, 3.0) AS base
        FROM fx_fetch f LEFT JOIN {DELAYS_SQL} d USING (domain)
      UNION ALL SELECT f.domain, f.ts, f.event_id, f.success, 'u', coalesce(d.domain_delay, 3.0)
        FROM fx_fetch f LEFT JOIN {DELAYS_SQL} d USING (domain)
      UNION ALL SELECT f.domain, f.ts, f.event_id, false, 'v', coalesce(d.domain_delay, 3.0)
        FROM fx_fetch f LEFT JOIN {DELAYS_SQL} d USING (domain) WHERE f.status_code IN (403, 429, 503)) s"""
O.FX["fx_fetch_steps"] = FETCH_STEPS_SQL

DELAY_NEXT = """CASE WHEN e.kind = 'c' THEN r.delay WHEN e.ok THEN (CASE WHEN r.delay > 0 THEN greatest(1.0, r.delay * 0.8) ELSE r.delay END)
  ELSE (CASE WHEN r.delay <= 0 THEN e.base ELSE least(20.0, r.delay * 2.0) END) END"""

O.FX["fx_throttle"] = f"""SELECT domain, CAST(0 AS BIGINT) AS rn, CAST(0.0 AS DOUBLE) AS delay, 0 AS failures, false AS throttled,
  CAST(NULL AS TIMESTAMP) AS until, CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS successes
FROM (SELECT DISTINCT domain FROM fx_fetch) t
UNION ALL
SELECT r.domain, e.rn, {DELAY_NEXT},
  CASE WHEN e.kind = 'c' THEN (CASE WHEN r.throttled AND r.until IS NOT NULL AND e.ts >= r.until THEN 0 ELSE r.failures END)
       WHEN e.ok THEN 0 ELSE r.failures + 1 END,
  CASE WHEN e.kind = 'c' THEN (CASE WHEN r.throttled AND r.until IS NOT NULL AND e.ts >= r.until THEN false ELSE r.throttled END)
       ELSE r.throttled OR (NOT e.ok AND r.failures + 1 >= 5) END,
  CASE WHEN e.kind = 'c' THEN (CASE WHEN r.throttled AND r.until IS NOT NULL AND e.ts >= r.until THEN NULL ELSE r.until END)
       WHEN NOT e.ok AND r.failures + 1 >= 5 THEN e.ts + INTERVAL 5 MINUTE ELSE r.until END,
  CASE WHEN e.kind = 'c' THEN r.requests ELSE r.requests + 1 END,
  CASE WHEN e.kind <> 'c' AND e.ok THEN r.successes + 1 ELSE r.successes END
FROM fx_throttle r JOIN fx_fetch_steps e ON e.domain = r.domain AND e.rn = r.rn + 1"""
O.RECURSIVE_FX.add("fx_throttle")
O.FX["fx_throttle_final"] = """SELECT t.domain, t.delay, t.failures, t.throttled, t.until, t.requests, t.successes FROM fx_throttle t
JOIN (SELECT domain, max(rn) AS rn FROM fx_fetch_steps GROUP BY domain) m ON m.domain = t.domain AND m.rn = t.rn"""


@query("domain_delay_fold", "SELECT domain, delay AS current_delay FROM fx_throttle_final")
def domain_delay_fold(spark, sf):
    f = fx.fx_fetch(spark, sf).select("event_id", "ts", "domain", "success", "status_code")
    return RT.domain_delay_fold(f, C.delays(spark, sf))


@query("domain_throttle_fold", "SELECT * FROM fx_throttle_final")
def domain_throttle_fold(spark, sf):
    f = fx.fx_fetch(spark, sf).select("event_id", "ts", "domain", "success", "status_code")
    return RT.domain_throttle_fold(f, C.delays(spark, sf))


@query("domain_stats", """
SELECT domain, requests AS total_requests, successes AS total_success,
  CASE WHEN requests > 0 THEN successes * 100.0 / requests ELSE 0.0 END AS success_rate,
  delay AS current_delay, throttled AS is_throttled, strftime(until, '%Y-%m-%d %H:%M:%S') AS throttled_until
FROM fx_throttle_final""")
def domain_stats(spark, sf):
    return RT.domain_stats(RT.domain_throttle_fold(fx.fx_fetch(spark, sf), C.delays(spark, sf)))


# statistics cleared: for each domain at its last event in so many, for all at the first
RESET_EVERY = 4000
O.FX["fx_reset"] = f"""SELECT domain, ts AS reset_at FROM fx_fetch WHERE event_id % {RESET_EVERY} = 0
UNION ALL SELECT NULL, min(ts) FROM fx_fetch"""
O.FX["fx_fetch_kept"] = """SELECT f.* FROM fx_fetch f LEFT JOIN (SELECT domain, max(reset_at) AS own FROM fx_reset WHERE domain IS NOT NULL GROUP BY domain) r
  USING (domain) WHERE f.ts > greatest((SELECT max(reset_at) FROM fx_reset WHERE domain IS NULL), own)"""
O.FX["fx_fetch_steps_kept"] = FETCH_STEPS_SQL.replace("fx_fetch f", "fx_fetch_kept f")
O.FX["fx_throttle_kept"] = (O.FX["fx_throttle"].replace("FROM fx_fetch)", "FROM fx_fetch_kept)")
                            .replace("fx_throttle r", "fx_throttle_kept r").replace("fx_fetch_steps", "fx_fetch_steps_kept"))
O.RECURSIVE_FX.add("fx_throttle_kept")


@query("domain_state_reset", """
SELECT t.domain, t.delay, t.failures, t.throttled, t.until, t.requests, t.successes FROM fx_throttle_kept t
JOIN (SELECT domain, max(rn) AS rn FROM fx_fetch_steps_kept GROUP BY domain) m ON m.domain = t.domain AND m.rn = t.rn""")
def domain_state_reset(spark, sf):
    """Delay and block of each domain after its statistics have been cleared."""
    f = fx.fx_fetch(spark, sf).select("event_id", "ts", "domain", "success", "status_code")
    resets = f.filter(F.col("event_id") % RESET_EVERY == 0).select("domain", F.col("ts").alias("reset_at")).unionByName(
        f.select(F.min("ts").alias("reset_at")).withColumn("domain", F.lit(None).cast("string")))
    return RT.domain_throttle_fold(RT.after_reset(f, resets), C.delays(spark, sf))


# ------------------------------------------------------- failure lifecycle

O.FX["fx_lc_ev"] = f"""SELECT f.url, f.site, f.ts, f.success, f.status_code, f.error_category,
  concat_ws(': ', coalesce(f.error_name, 'HTTPError'), CAST(f.status_code AS VARCHAR)) AS error_message,
  coalesce(p.max_retries, 3) AS max_retries, coalesce(p.min_delay, 10.0) AS min_delay, coalesce(p.max_delay, 30.0) AS max_delay,
  row_number() OVER (PARTITION BY f.url ORDER BY f.ts, f.event_id) AS rn
FROM (SELECT *, CASE WHEN NOT success THEN {CLASSIFY_SQL} END AS error_category FROM fx_fetch) f
LEFT JOIN {POLICY_SQL} USING (error_category)"""

_RC = "(CASE WHEN r.p_rc IS NOT NULL THEN r.p_rc + 1 ELSE 0 END)"
_RETRY = f"({_RC} < e.max_retries)"
_NEXT = (f"e.ts + to_microseconds(CAST(round(least((e.min_delay + e.max_delay) / 2.0 * pow(2.0, {_RC}), 3600.0)"
         f" * 1000000) AS BIGINT))")
_NEW = {"site": "CASE WHEN r.p_rc IS NOT NULL THEN r.p_site ELSE e.site END", "rc": _RC, "cat": "e.error_category", "msg": "e.error_message", "status": "e.status_code",
        "first": "CASE WHEN r.p_rc IS NOT NULL THEN r.p_first ELSE e.ts END", "last": "e.ts"}
_FIELDS = ["site", "rc", "cat", "msg", "status", "first", "last", "next"]
_TYPES = {"site": "VARCHAR", "rc": "INTEGER", "cat": "VARCHAR", "msg": "VARCHAR", "status": "INTEGER", "first": "TIMESTAMP",
          "last": "TIMESTAMP", "next": "TIMESTAMP"}


def _lc_step():
    cols = ["r.url", "e.rn"]
    for f in _FIELDS:  # pending task
        new = _NEXT if f == "next" else _NEW[f]
        cols.append(f"CASE WHEN e.success THEN NULL WHEN {_RETRY} THEN {new} END")
    for f in _FIELDS:  # permanent task
        new = "r.p_next" if f == "next" else _NEW[f]
        cols.append(f"CASE WHEN e.success OR {_RETRY} THEN r.q_{f} ELSE {new} END")
    return ",\n  ".join(cols)


_ZERO = ", ".join([f"CAST(NULL AS {_TYPES[f]})" for f in _FIELDS] * 2)
_NAMES = ", ".join(["url", "rn"] + [f"p_{f}" for f in _FIELDS] + [f"q_{f}" for f in _FIELDS])
O.FX["fx_lc"] = f"""SELECT url, CAST(0 AS BIGINT) AS rn, {_ZERO}
FROM (SELECT DISTINCT url FROM fx_lc_ev) t
UNION ALL
SELECT {_lc_step()}
FROM fx_lc r JOIN fx_lc_ev e ON e.url = r.url AND e.rn = r.rn + 1"""
O.FX["fx_lc"] = O.FX["fx_lc"].replace("SELECT url, CAST(0 AS BIGINT) AS rn, " + _ZERO,
                                      "SELECT * FROM (SELECT url, CAST(0 AS BIGINT) AS rn, "
                                      + _ZERO, 1)
O.FX["fx_lc"] = O.FX["fx_lc"].replace("FROM (SELECT DISTINCT url FROM fx_lc_ev) t\n",
                                      "FROM (SELECT DISTINCT url FROM fx_lc_ev) t) z(" + _NAMES + ")\n", 1)
O.RECURSIVE_FX.add("fx_lc")
_TASK_COLS = ("url, {p}site AS site_name, {p}cat AS error_category, {p}msg AS error_message, {p}status AS status_code, "
              "{p}rc AS retry_count, {p}first AS first_failed_at, {p}last AS last_failed_at, {p}next AS next_retry_at")
O.FX["fx_tasks"] = f"""WITH fin AS (SELECT l.* FROM fx_lc l JOIN (SELECT url, max(rn) AS rn FROM fx_lc_ev GROUP BY url) m
  ON m.url = l.url AND m.rn = l.rn)
SELECT 'pending' AS state, {_TASK_COLS.format(p='p_')} FROM fin WHERE p_rc IS NOT NULL
UNION ALL SELECT 'permanent', {_TASK_COLS.format(p='q_')} FROM fin WHERE q_rc IS NOT NULL"""


@query("failure_lifecycle_fold", "SELECT * FROM fx_tasks")
def failure_lifecycle_fold(spark, sf):
    return C.tasks(spark, sf)


@query("failure_stats_by_category", f"""
SELECT p.error_category, count(*) FILTER (WHERE t.state = 'pending') AS pending,
  count(*) FILTER (WHERE t.state = 'permanent') AS permanent
FROM {POLICY_SQL} LEFT JOIN fx_tasks t USING (error_category) GROUP BY p.error_category""")
def failure_stats_by_category(spark, sf):
    return FL.failure_stats_by_category(C.tasks(spark, sf), E.policy_table(spark))


@query("failure_stats_by_site", """
SELECT site_name, count(*) FILTER (WHERE state = 'pending') AS pending,
  count(*) FILTER (WHERE state = 'permanent') AS permanent FROM fx_tasks GROUP BY site_name""")
def failure_stats_by_site(spark, sf):
    return FL.failure_stats_by_site(C.tasks(spark, sf))


@query("ready_tasks", """
SELECT state, url, next_retry_at FROM fx_tasks
WHERE state = 'pending' AND next_retry_at <= (SELECT max(ts) FROM fx_fetch) ORDER BY next_retry_at, url LIMIT 10""")
def ready_tasks(spark, sf):
    now = C.as_of(fx.fx_fetch(spark, sf), "ts")
    return FL.ready_tasks(C.tasks(spark, sf), now).select("state", "url", "next_retry_at")


SNAPSHOT_CUT = "2024-01-20 00:00:00"
for _part, _when in (("early", "<"), ("recent", ">=")):
    # the lifecycle of the log before and from the snapshot on
    _log = f"FROM (SELECT * FROM fx_fetch WHERE ts {_when} TIMESTAMP '{SNAPSHOT_CUT}')"
    O.FX[f"fx_lc_ev_{_part}"] = O.FX["fx_lc_ev"].replace("FROM fx_fetch", _log)
    O.FX[f"fx_lc_{_part}"] = O.FX["fx_lc"].replace("fx_lc_ev", f"fx_lc_ev_{_part}").replace("FROM fx_lc r", f"FROM fx_lc_{_part} r")
    O.RECURSIVE_FX.add(f"fx_lc_{_part}")
    O.FX[f"fx_tasks_{_part}"] = O.FX["fx_tasks"].replace("fx_lc_ev", f"fx_lc_ev_{_part}").replace("FROM fx_lc l", f"FROM fx_lc_{_part} l")


@query("all_tasks_union", """
SELECT state, url, retry_count, error_category, last_failed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY state, url ORDER BY last_failed_at DESC, part DESC) AS rn FROM (
    SELECT state, url, retry_count, error_category, date_trunc('second', last_failed_at) AS last_failed_at, 0 AS part FROM fx_tasks_early
    UNION ALL SELECT state, url, retry_count, error_category, last_failed_at, 1 FROM fx_tasks_recent) u) t WHERE rn = 1""")
def all_tasks_union(spark, sf):
    """A snapshot of the tasks is saved and loaded, and united with the tasks
    of the log since."""
    f = fx.fx_fetch(spark, sf)
    cut, path = F.lit(SNAPSHOT_CUT).cast("timestamp_ntz"), scratch_path(spark, "task-snapshot")
    policy = E.policy_table(spark)
    SK.save_failure_snapshot(FL.failure_lifecycle(f.filter(F.col("ts") < cut), policy), path)
    recent = FL.failure_lifecycle(f.filter(F.col("ts") >= cut), policy)
    return FL.all_tasks(RD.read_failure_snapshot(spark, path), recent).select(
        "state", "url", "retry_count", "error_category", "last_failed_at")


@query("failed_task_format", """
SELECT state, url, strftime(first_failed_at, '%Y-%m-%d %H:%M:%S') AS first_failed_at,
  strftime(last_failed_at, '%Y-%m-%d %H:%M:%S') AS last_failed_at, strftime(next_retry_at, '%Y-%m-%d %H:%M:%S') AS next_retry_at
FROM fx_tasks""")
def failed_task_format(spark, sf):
    return FL.format_task_times(C.tasks(spark, sf)).select("state", "url", "first_failed_at", "last_failed_at",
                                                           "next_retry_at")
