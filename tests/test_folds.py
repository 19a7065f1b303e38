"""Ordered folds and bucketed scans against a plain Python replay.

One hot domain holds most events and is cut into many chunks, so the
fixpoint carry between chunks is exercised.
"""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import rates as RT
from pagewright.operators import failures as FL
from pagewright.operators import pacing as P
from pagewright.operators import retries as RS
from pagewright.functions import errors as E
from pagewright.operators.scan import bucketed_lag, bucketed_prefix, time_bucket, trailing_count

T0 = dt.datetime(2024, 1, 1)


def make_events(n=1500, seed=7):
    rnd = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([1, 5, 30, 90, 400]))
        dom = "hot.example.com" if rnd.random() < 0.7 else rnd.choice(["a.com", "b.com"])
        ok = rnd.random() < 0.55
        status = 200 if ok else rnd.choice([403, 429, 500, 503, 404, None])
        rows.append((i, t, dom, ok, status, rnd.choice([1.0, 3.0, 4.5])))
    return rows


SCHEMA = "event_id long, ts timestamp_ntz, domain string, success boolean, status_code int, domain_delay double"


def replay_throttle(rows):
    out = {}
    for eid, ts, dom, ok, status, base in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        s = out.setdefault(dom, dict(delay=0.0, failures=0, throttled=False, until=None, requests=0, successes=0))
        if s["throttled"] and s["until"] is not None and ts >= s["until"]:
            s.update(throttled=False, until=None, failures=0)
        for step in [ok] + ([False] if status in (403, 429, 503) else []):
            s["requests"] += 1
            d = s["delay"]
            if step:
                s["successes"] += 1
                s["failures"] = 0
                s["delay"] = max(1.0, d * 0.8) if d > 0 else d
            else:
                s["failures"] += 1
                s["delay"] = base if d <= 0 else min(20.0, d * 2.0)
                if s["failures"] >= 5:
                    s["throttled"], s["until"] = True, ts + dt.timedelta(minutes=5)
    return out


@pytest.mark.parametrize("chunks", [1, 7, 23])
def test_throttle_fold_matches_replay(spark, chunks):
    rows = make_events()
    df = spark.createDataFrame(rows, SCHEMA)
    delays = spark.createDataFrame([("a.com", 1.0)], "domain string, domain_delay double")
    ev = df.drop("domain_delay")
    got = {r["domain"]: r.asDict() for r in RT.domain_throttle_fold(ev, delays, n_chunks=chunks).collect()}
    base = {r[2]: 1.0 if r[2] == "a.com" else 3.0 for r in rows}
    exp = replay_throttle([(a, b, c, d, e, base[c]) for a, b, c, d, e, _ in rows])
    assert set(got) == set(exp)
    for dom, s in exp.items():
        g = got[dom]
        assert (g["delay"], g["failures"], g["throttled"], g["until"], g["requests"], g["successes"]) == \
            (s["delay"], s["failures"], s["throttled"], s["until"], s["requests"], s["successes"])


def test_delay_fold_equals_throttle_delay(spark):
    df = spark.createDataFrame(make_events(600, 3), SCHEMA).drop("domain_delay")
    delays = spark.createDataFrame([("b.com", 2.0)], "domain string, domain_delay double")
    a = {r[0]: r[1] for r in RT.domain_delay_fold(df, delays, n_chunks=9).collect()}
    b = {r["domain"]: r["delay"] for r in RT.domain_throttle_fold(df, delays, n_chunks=4).collect()}
    assert a == b


def test_bucketed_lag_and_prefix_match_plain_window(spark):
    from pyspark.sql import Window
    rows = make_events(800, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    b = time_bucket("ts", 600)
    lagged = bucketed_lag(df, ["domain"], ["ts", "event_id"], b, ["event_id"])
    w = Window.partitionBy("domain").orderBy("ts", "event_id")
    plain = df.withColumn("p", F.lag("event_id").over(w))
    j = lagged.join(plain, "event_id").filter(~F.col("prev_event_id").eqNullSafe(F.col("p")))
    assert j.count() == 0
    pre = bucketed_prefix(df, ["domain"], ["ts", "event_id"], b, "run", F.when(F.col("success"), 1).otherwise(0))
    plain = df.withColumn("r", F.sum(F.when(F.col("success"), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    assert pre.join(plain, "event_id").filter(F.col("run") != F.col("r")).count() == 0


def test_trailing_count_matches_brute_force(spark):
    rows = make_events(500, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["n_trailing"] for r in
           trailing_count(df, ["domain"], "ts", 60_000_000, n_chunks=5).collect()}
    for eid, ts, dom, *_ in rows:
        n = sum(1 for e2, t2, d2, *_ in rows if d2 == dom and ts - dt.timedelta(seconds=60) < t2 <= ts)
        assert got[eid] == n


def test_consecutive_failures(spark):
    rows = make_events(400, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["failure_streak"] for r in RT.consecutive_failures(df, bucket_seconds=300).collect()}
    streak = {}
    for eid, ts, dom, ok, *_ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        streak[dom] = 0 if ok else streak.get(dom, 0) + 1
        assert got[eid] == streak[dom]


def replay_lifecycle(events, policy):
    pending, permanent = {}, {}
    for url, ts, eid, ok, status, cat in sorted(events, key=lambda r: (r[0], r[1], r[2])):
        if ok:
            pending.pop(url, None)
            continue
        t = pending.get(url)
        rc = t["rc"] + 1 if t else 0
        first = t["first"] if t else ts
        mr, lo, hi = policy[cat]
        task = dict(rc=rc, cat=cat, first=first, last=ts, next=t["next"] if t else None)
        if rc < mr:
            task["next"] = ts + dt.timedelta(seconds=min((lo + hi) / 2 * 2 ** rc, 3600))
            pending[url] = task
        else:
            pending.pop(url, None)
            permanent[url] = task
    return pending, permanent


def test_lifecycle_fold_matches_replay(spark):
    rnd = random.Random(1)
    rows, t = [], T0
    for i in range(1200):
        t += dt.timedelta(seconds=rnd.choice([1, 20, 300]))
        url = "https://hot.example.com/x" if rnd.random() < 0.5 else f"https://a.com/{rnd.randint(0, 30)}"
        ok = rnd.random() < 0.3
        status = 200 if ok else rnd.choice([403, 404, 429, 500, None])
        err = None if ok else rnd.choice(["TimeoutError", "JSONDecodeError", "OSError"])
        rows.append((i, t, "s", url, ok, status, err))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, site string, url string, success boolean, "
                                     "status_code int, error_name string")
    policy_df = E.policy_table(spark)
    tasks = FL.failure_lifecycle(df, policy_df, n_chunks=11).collect()
    cats = {r["event_id"]: r["c"] for r in df.select(
        "event_id", E.classify_error("error_name", "status_code").alias("c")).collect()}
    policy = {c: (m, lo, hi) for c, m, lo, hi in E.POLICY}
    pend, perm = replay_lifecycle([(u, ts, e, ok, st, cats[e]) for e, ts, _, u, ok, st, _ in rows], policy)
    got_p = {r["url"]: r for r in tasks if r["state"] == "pending"}
    got_q = {r["url"]: r for r in tasks if r["state"] == "permanent"}
    assert set(got_p) == set(pend) and set(got_q) == set(perm)
    for url, t in pend.items():
        g = got_p[url]
        assert (g["retry_count"], g["error_category"], g["first_failed_at"], g["last_failed_at"], g["next_retry_at"]) \
            == (t["rc"], t["cat"], t["first"], t["last"], t["next"])
    for url, t in perm.items():
        g = got_q[url]
        assert (g["retry_count"], g["last_failed_at"], g["next_retry_at"]) == (t["rc"], t["last"], t["next"])


def test_row_chunked_scans_match_plain_window(spark):
    """Tiny chunks: the hot key spans dozens of chunks and the carry must stitch them."""
    from pyspark.sql import Window
    from pagewright.operators.scan import range_chunks
    rows = make_events(700, 21)
    df = range_chunks(spark.createDataFrame(rows, SCHEMA), ["domain"], ["ts", "event_id"], n_chunks=3,
                      chunk_rows=16)
    assert df.select("_chunk").distinct().count() > 30
    lagged = bucketed_lag(df, ["domain"], ["ts", "event_id"], F.col("_chunk"), ["event_id"])
    w = Window.partitionBy("domain").orderBy("ts", "event_id")
    plain = df.withColumn("p", F.lag("event_id").over(w)).select("event_id", "p")
    assert lagged.join(plain, "event_id").filter(~F.col("prev_event_id").eqNullSafe(F.col("p"))).count() == 0
    pre = bucketed_prefix(df, ["domain"], ["ts", "event_id"], F.col("_chunk"), "run",
                          F.when(F.col("success"), 1).otherwise(0))
    plain = df.withColumn("r", F.sum(F.when(F.col("success"), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).select("event_id", "r")
    assert pre.join(plain, "event_id").filter(F.col("run") != F.col("r")).count() == 0


def replay_stretch(events, state):
    delay, failures, until = state
    for at, ok, double, base in events:
        failures, until = P.run_after((failures, until), at, ok, double)
        for good in (ok, False) if double else (ok,):
            delay = P.delay_after(delay, good, base)
    return delay, failures, until


def test_stretch_maps_equal_the_replay_from_any_state():
    rnd = random.Random(3)
    for _ in range(3000):
        share = rnd.choice([0.0, 0.1, 0.3, 0.55, 0.8, 1.0])
        gaps = rnd.choice([[1], [1, 30, 60], [100, 299, 300, 301], [1, 5, 30, 90, 400], [0, 0, 100]])
        base = rnd.choice([0.0, 0.3, 1.0, 3.0, 30.0])
        at, events = 0, []
        for _ in range(rnd.choice([1, 2, 5, 13, 40])):
            at += rnd.choice(gaps) * 1_000_000
            ok = rnd.random() < share
            events.append((at, ok, rnd.random() < (0.05 if ok else 0.3), base))
        stretch = P.Stretch()
        for e in events:
            stretch.add(*e)
        summary = P.decode(P.encode(stretch.summary()))
        for _ in range(8):
            blocked = rnd.random() < 0.6
            until = events[0][0] + rnd.choice([-1, 0, 1, rnd.randrange(0, 300) * 1_000_000, 300_000_000])
            state = (rnd.choice([1.0, 20.0, rnd.uniform(1, 20)]), rnd.randrange(0, 9 if blocked else 5),
                     until if blocked else None)
            assert P.apply(summary, state) == replay_stretch(events, state)
        assert P.apply(summary, P.START) == replay_stretch(events, P.START)


@pytest.mark.parametrize("chunks", [1, 50])
def test_a_domain_that_never_clamps(spark, chunks):
    """The delay stays between its bounds through 50 chunks, so that no chunk
    forgets the one before; jobs don't grow with the chunks."""
    rnd, rows, d = random.Random(2), [], 4.0
    rows.append((0, T0, "hot", False, 404))
    for i in range(1, 5000):
        ok = d > 9 or (d > 2 and rnd.random() < 0.75)
        d = d * 0.8 if ok else d * 2
        rows.append((i, T0 + dt.timedelta(seconds=i), "hot", ok, 200 if ok else 404))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, domain string, success boolean, status_code int")
    delays = spark.createDataFrame([("hot", 4.0)], "domain string, domain_delay double")
    want = replay_throttle([(*r, 4.0) for r in rows])["hot"]
    group = f"never-clamps-{chunks}"
    spark.sparkContext.setJobGroup(group, group)
    got = RT.domain_throttle_fold(df, delays, n_chunks=chunks).collect()[0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert 1.0 < got["delay"] < 20.0 and got["delay"] == want["delay"]
    assert (got["failures"], got["throttled"], got["requests"]) == (want["failures"], want["throttled"], want["requests"])
    assert jobs <= 8


def test_after_reset(spark):
    rows = make_events(300, 6)
    df = spark.createDataFrame(rows, SCHEMA).drop("domain_delay")
    delays = spark.createDataFrame([], "domain string, domain_delay double")
    cut = rows[100][1]
    one = spark.createDataFrame([("a.com", cut), ("a.com", T0)], "domain string, reset_at timestamp_ntz")
    got = {r["domain"]: r["requests"] for r in RT.domain_throttle_fold(RT.after_reset(df, one), delays).collect()}
    want = replay_throttle([(*r[:5], 3.0) for r in rows if r[2] != "a.com" or r[1] > cut])
    assert got == {k: v["requests"] for k, v in want.items()}
    whole = spark.createDataFrame([(None, cut)], "domain string, reset_at timestamp_ntz")
    assert RT.after_reset(df, whole).count() == sum(r[1] > cut for r in rows)
    assert RT.after_reset(df, whole.limit(0)).count() == len(rows)


def test_retry_stretches_equal_the_replay():
    rnd = random.Random(5)
    policy = {"a": (5, 5.0, 15.0), "b": (1, 5.0, 10.0), "c": (8, 30.0, 60.0), "d": (0, 1.0, 2.0), "e": (3, 10.0, 20.0)}

    def replay(events):
        pending, permanent = None, None
        for at, ok, site, status, category, message, limit, low, high in events:
            if ok:
                pending = None
                continue
            n = pending[0] + 1 if pending else 0
            task = (n, *(pending[1:3] if pending else (site, at)), category, message, status, at)
            if n < limit:
                pending = (*task, RS.planned_at(at, n, low, high))
            else:
                permanent, pending = (*task, pending[7] if pending else None), None
        return pending, permanent

    for _ in range(2000):
        at, events = 0, []
        share, kinds = rnd.choice([0, 0.05, 0.3, 0.7]), rnd.sample(list(policy), rnd.randrange(1, 6))
        for i in range(rnd.randrange(1, 50)):
            at += rnd.randrange(1, 10 ** 9)
            c = rnd.choice(kinds)
            events.append((at, rnd.random() < share, f"s{i % 3}", rnd.choice([None, 404]), c, f"m{i}", *policy[c]))
        state, i = RS.START, 0
        while i < len(events):
            k, stretch = rnd.randrange(1, 12), RS.Stretch(8)
            for e in events[i:i + k]:
                stretch.add(*e)
            state, i = RS.apply(RS.decode(RS.encode(stretch.summary())), state), i + k
        assert state == replay(events)


def test_task_takes_the_site_of_its_opening_failure(spark):
    rows = [(1, T0, "siteA", "u", False), (2, T0 + dt.timedelta(1), "siteA", "u", True),
            (3, T0 + dt.timedelta(2), "siteB", "u", False), (4, T0 + dt.timedelta(3), "siteC", "u", False)]
    df = spark.createDataFrame([(*r, None, "TimeoutError", "") for r in rows],
                               "event_id long, ts timestamp_ntz, site string, url string, success boolean, "
                               "status_code int, error_name string, props string")
    got = FL.failure_lifecycle(df, E.policy_table(spark), n_chunks=3).collect()
    assert [(r["state"], r["site_name"], r["retry_count"], r["first_failed_at"]) for r in got] == [
        ("pending", "siteB", 1, T0 + dt.timedelta(2))]


@pytest.mark.parametrize("chunks", [4, 64])
def test_lifecycle_jobs_do_not_grow_with_chunks(spark, chunks):
    rnd = random.Random(1)
    rows = [(i, T0 + dt.timedelta(minutes=i), "s", "u", rnd.random() < 0.1, 500, "OSError", "") for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, site string, url string, success boolean, "
                                     "status_code int, error_name string, props string")
    group = f"lifecycle-{chunks}"
    spark.sparkContext.setJobGroup(group, group)
    got = {tuple(r) for r in FL.failure_lifecycle(df, E.policy_table(spark), n_chunks=chunks).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert got == {tuple(r) for r in FL.failure_lifecycle(df, E.policy_table(spark), n_chunks=1).collect()}
    assert jobs <= 30
