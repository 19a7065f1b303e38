import datetime as dt

from pyspark.sql import functions as F

from pagewright.operators import failures as FL

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, url string, reason string, status_code string, failed_time timestamp_ntz"


def test_prefix_key_collision_keeps_first_url(spark):
    long_a = "https://x.com/" + "a" * 250 + "/one"
    long_b = "https://x.com/" + "a" * 250 + "/two"
    rows = [(1, long_a, "r1", "500", T0), (2, long_b, "r2", "404", T0 + dt.timedelta(seconds=1))]
    out = FL.failed_upsert(None, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 1
    r = out[0]
    assert r["url"] == long_a and r["reason"] == "r2" and r["status_code"] == "404" and r["retry_count"] == 1


def test_upsert_in_batches_equals_one_batch(spark):
    rows = [(i, f"https://s.com/{i % 7}", f"r{i}", str(400 + i % 3), T0 + dt.timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = FL.failed_upsert(None, df)
    snap = None
    for k in range(4):
        part = df.filter((F.col("event_id") >= k * 15) & (F.col("event_id") < (k + 1) * 15))
        snap = FL.failed_upsert(snap, part)
    cols = ["url_key", "url", "reason", "status_code", "failed_time", "retry_count", "created_at"]
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, snap.select(cols).collect()))


def test_failed_for_site_like_semantics(spark):
    failed = spark.createDataFrame(
        [("k1", "https://MY_SITE.com/a", T0, 0), ("k2", "https://myxsite.com/b", T0, 1),
         ("k3", "https://other.com/c", T0, 0), ("k4", "https://my_site.com/d", T0, 5)],
        "url_key string, url string, failed_time timestamp_ntz, retry_count int")
    sites = spark.createDataFrame([("my_site",)], "site string")
    got = sorted(r["url_key"] for r in FL.failed_for_site(failed, sites).collect())
    # '_' matches any character; case is ignored; retry_count >= 3 is excluded
    assert got == ["k1", "k2"]


def test_attempt_outcome(spark):
    rows = [(1, "u1", T0, False), (2, "u1", T0 + dt.timedelta(1), True), (3, "u1", T0 + dt.timedelta(2), True),
            (4, "u2", T0, False), (5, "u2", T0 + dt.timedelta(1), False), (6, "u2", T0 + dt.timedelta(2), False),
            (7, "u2", T0 + dt.timedelta(3), True), (8, "u3", T0, False)]
    df = spark.createDataFrame(rows, "event_id long, url string, ts timestamp_ntz, success boolean")
    got = {r["url"]: (r["success"], r["attempts"], r["retries"]) for r in FL.attempt_outcome(df).collect()}
    assert got == {"u1": (True, 2, 1), "u2": (False, 3, 2), "u3": (False, 1, 0)}


def test_extra_data_newest_wins(spark):
    rows = [("u", T0, 1, {"a": "1", "b": "x"}), ("u", T0 + dt.timedelta(1), 2, {"a": "2"}),
            ("u", T0 + dt.timedelta(2), 3, {"b": None})]
    df = spark.createDataFrame(rows, "url string, ts timestamp_ntz, event_id long, extra_data map<string,string>")
    got = {r["name"]: r["value"] for r in FL.extra_data_merge(df).collect()}
    assert got == {"a": "2", "b": None}


def test_contains_like_join_matches_brute_force(spark):
    import random
    import re
    from pagewright.operators.joins import contains_like_join
    rnd = random.Random(3)
    alphabet = "abcxyz_."
    urls = ["https://" + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 30))) for _ in range(300)]
    names = ["ab", "a_", "x", "abc", "b_c", "zz.", "_a_b", "cab", "xyz", "q"]  # short / wildcard names too
    left = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    right = spark.createDataFrame([(n,) for n in names], "site string")
    got = sorted((r["id"], r["site"]) for r in contains_like_join(left, "url", right, "site").collect())

    def like(text, name):  # LIKE '%name%' with '_' as any character, case-insensitive
        pat = ".*" + "".join("." if c == "_" else re.escape(c) for c in name.lower()) + ".*"
        return re.fullmatch(pat, text.lower(), flags=re.DOTALL) is not None

    exp = sorted((i, n) for i, u in enumerate(urls) for n in names if like(u, n))
    assert got == exp
