"""The driver contract and a sample of registered queries against their oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.sources.tables import TABLES

from conftest import SF001


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields] == ["site", "site_id", "website_category", "day", "n_articles",
                                                  "n_with_publish_time", "content_chars"]


def test_every_query_has_oracle():
    from pagewright.plans import catalog
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", ["clean_site_rules", "publish_time_site", "failed_upsert", "domain_throttle_fold",
                                 "failure_lifecycle_fold", "trailing_request_rate", "new_articles_per_site_day",
                                 "stream_domain_state", "extract_by_selector", "frontier_walk"])
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF001)
    cols = sorted(df.columns)
    got = _norm(tuple(r[c] for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    idx = [dcols.index(c) for c in cols]
    exp = _norm(tuple(r[i] for i in idx) for r in cur.fetchall())
    assert got == exp


def test_catalogue_imports_without_session():
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; "
            "q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q))")
    root = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


BATCH_KEYS = ["url_valid", "new_links_anti", "failed_for_site", "extract_by_selector", "site_by_id",
              "enrich_site", "site_stats_all", "request_gap_wait", "consecutive_failures", "trailing_request_rate",
              "articles_total", "retry_success_semi", "metadata_only"]


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_plans_have_no_pairs_joins_and_prune_columns(spark, key):
    df = entry.queries()[key](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key == "articles_total":  # a bare count reads no column at all
        assert "ReadSchema: struct<>" in df._jdf.queryExecution().simpleString()


def test_streams_do_not_depend_on_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
        df = entry.queries()["stream_counts_by_day"](spark, SF001)
        got = sorted(tuple(r) for r in df.select("window_start", "site", "n").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    spark.conf.set("spark.sql.session.timeZone", old)
    ref = sorted(tuple(r) for r in entry.queries()["stream_counts_by_day"](spark, SF001)
                 .select("window_start", "site", "n").collect())
    assert got == ref and got[0][0].hour == 0


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True,
                         timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and len(d["queries"]) >= 20
    assert abs(sum(d["queries"].values()) - d["value"]) < 0.01


def test_python_workers_find_the_package_from_any_directory(tmp_path):
    """Operators that run Python on executors ship the package themselves."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
q = e.queries()
for k in ("success_rate_pct", "extract_by_selector", "stream_content_change"):
    assert q[k](spark, {SF001!r}).count() > 0, k
print("ok")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0 and out.stdout.strip().endswith("ok"), out.stderr[-3000:]
