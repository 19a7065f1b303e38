"""A stream over the data gives the batch result; a restart adds no duplicates."""

import datetime
import glob
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from pagewright.functions import errors as E
from pagewright.operators import failures as FL
from pagewright.operators import rates as RT
from pagewright.plans import common as C
from pagewright.sources import fixtures as fx
from pagewright.streaming import streams as S

from conftest import SF001


def test_domain_state_stream_equals_batch(spark):
    out, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    f = fx.fetch_rows(S.table_stream(spark, SF001, "events"))
    S.domain_state_stream(f, C.delays(spark, SF001), out, ck)
    got = {r["domain"]: tuple(r) for r in S.domain_state(spark, out).drop("late").collect()}
    batch = RT.domain_throttle_fold(fx.fx_fetch(spark, SF001), C.delays(spark, SF001))
    exp = {r["domain"]: tuple(r) for r in batch.collect()}
    assert got == exp


def test_restart_from_checkpoint_adds_nothing(spark):
    out, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    failures = FL.failure_record(fx.fetch_rows(S.table_stream(spark, SF001, "events")))
    S.failed_upsert_stream(failures, out, ck)
    first = sorted(map(tuple, S.failed_table(spark, out).read().collect()))
    failures = FL.failure_record(fx.fetch_rows(S.table_stream(spark, SF001, "events")))
    S.failed_upsert_stream(failures, out, ck)  # same checkpoint: nothing new to process
    second = sorted(map(tuple, S.failed_table(spark, out).read().collect()))
    assert first == second
    batch = FL.failed_upsert(None, FL.failure_record(fx.fx_fetch(spark, SF001)))
    assert len(first) == batch.count()


def test_stream_sinks_and_log_stream(spark):
    from pagewright.sources import readers as RD
    out, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    failures = FL.failure_record(fx.fetch_rows(S.table_stream(spark, SF001, "events")))
    S.failed_csv_stream(failures, out + "/csv", ck + "/csv")
    from pagewright.sources import sinks as SK
    from pyspark.sql import types as T
    back = SK.read_csv(spark, out + "/csv", T.StructType([T.StructField(c, T.StringType()) for c in
                                                         ("url", "reason", "status_code", "failed_time")]))
    assert back.count() == FL.failure_record(fx.fx_fetch(spark, SF001)).count()
    logs = tempfile.mkdtemp()
    RD.render_fetch_log(fx.fx_fetch(spark, SF001)).write.mode("overwrite").text(logs + "/part")
    lines = S.log_stream(spark, logs + "/part")
    S.run_available_now(lines, ck + "/log", S.batch_folder_writer(out + "/log"))
    assert spark.read.parquet(out + "/log").count() == fx.fx_fetch(spark, SF001).count()


def parts(spark, folder, conditions):
    """events of sf0.001 in one file for each condition, read in that order."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    os.makedirs(folder)
    for i, cond in enumerate(conditions):
        out = tempfile.mkdtemp()
        ev.filter(cond).coalesce(1).write.mode("overwrite").parquet(out)
        shutil.copy(glob.glob(f"{out}/*.parquet")[0], f"{folder}/part-{i}.parquet")
        os.utime(f"{folder}/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return S.file_stream(spark, str(folder), ev.schema, max_files_per_trigger=1)


def day(n):
    return F.lit(datetime.datetime(2024, 1, 1) + datetime.timedelta(n - 1)).cast("timestamp_ntz")


def test_due_retries_come_out_once(spark, tmp_path):
    """A retry comes out with the batch whose clock reaches it, if its task
    still stands; planned again, it comes out again."""
    ts = F.col("ts")
    stream = parts(spark, tmp_path / "in", [ts < day(10), (ts >= day(10)) & (ts < day(20)), ts >= day(20)])
    out = str(tmp_path / "out")
    S.failure_state_stream(fx.fetch_rows(stream), E.policy_table(spark), out, str(tmp_path / "ck"))
    due = S.due_retries(spark, out)
    assert due.select("batch").distinct().count() == 3
    assert due.count() == due.select("url", "next_retry_at").distinct().count()
    # each batch's clock: tasks pending then and due by then must have come out by then
    for n, end in enumerate((day(10), day(20), day(40))):
        log = fx.fx_fetch(spark, SF001).filter(ts < end)
        now = log.agg(F.max("ts")).first()[0]
        tasks = FL.failure_lifecycle(log, E.policy_table(spark)).filter("state = 'pending'")
        want = {(r.url, r.retry_count, r.next_retry_at) for r in tasks.filter(F.col("next_retry_at") <= F.lit(now)).collect()}
        got = {tuple(r)[:3] for r in due.filter(F.col("batch") <= n).collect()}
        assert want and want <= got
    flags = {(r.url, r.due) for r in S.current_tasks(spark, out).filter("state = 'pending'").collect()}
    assert flags == {(r.url, r.next_retry_at <= now) for r in tasks.collect()}


def test_failure_state_over_shuffled_files(spark, tmp_path):
    pick = F.pmod(F.hash("event_id"), F.lit(3))
    stream = parts(spark, tmp_path / "in", [pick == i for i in range(3)])
    out = str(tmp_path / "out")
    S.failure_state_stream(fx.fetch_rows(stream), E.policy_table(spark), out, str(tmp_path / "ck"), n_buckets=3)
    batch = FL.failure_lifecycle(fx.fx_fetch(spark, SF001), E.policy_table(spark))
    got = sorted(map(repr, S.current_tasks(spark, out).select(*batch.columns).collect()))
    assert got == sorted(map(repr, batch.collect()))


def test_domain_state_over_shuffled_files_and_restarts(spark, tmp_path):
    pick = F.pmod(F.hash("event_id"), F.lit(3))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    parts(spark, tmp_path / "a", [pick == i for i in range(2)])
    stream = S.file_stream(spark, str(tmp_path / "a"), spark.read.parquet(f"{SF001}/events.parquet").schema, max_files_per_trigger=1)
    S.domain_state_stream(fx.fetch_rows(stream), C.delays(spark, SF001), out, ck, bucket="7 days")
    third = tempfile.mkdtemp() + "/b"
    parts(spark, third, [pick == 2])
    shutil.copy(f"{third}/part-0.parquet", tmp_path / "a" / "part-9.parquet")
    S.domain_state_stream(fx.fetch_rows(stream), C.delays(spark, SF001), out, ck, bucket="7 days")
    batch = RT.domain_throttle_fold(fx.fx_fetch(spark, SF001), C.delays(spark, SF001))
    assert sorted(map(repr, S.domain_state(spark, out).drop("late").collect())) == sorted(map(repr, batch.collect()))


def test_closed_buckets_lose_their_events_and_count_late_ones(spark, tmp_path):
    ts = F.col("ts")
    odd = F.col("event_id") % 7 == 0
    stream = parts(spark, tmp_path / "in", [(ts < day(12)) & ~odd, (ts >= day(12)) & ~odd, odd])
    out = str(tmp_path / "out")
    S.domain_state_stream(fx.fetch_rows(stream), C.delays(spark, SF001), out, str(tmp_path / "ck"), retention="10 days")
    state = S.domain_state(spark, out)
    ev = fx.fx_fetch(spark, SF001)
    newest = ev.filter(~odd).agg(F.max("ts")).first()[0]
    closed = ((newest - datetime.datetime(1970, 1, 1)).days - 10) * 86400
    applied = ev.filter(~odd | (F.unix_seconds(S.ntz_to_instant(ts)) >= closed))
    want = RT.domain_throttle_fold(applied, C.delays(spark, SF001))
    assert sorted(map(repr, state.drop("late").collect())) == sorted(map(repr, want.collect()))
    assert state.agg(F.sum("late")).first()[0] == ev.count() - applied.count() > 0
    kept = {int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{out}/events/batch=*/bucket=*")}
    assert min(kept) >= closed // 86400 and len(glob.glob(f"{out}/summaries/batch=*")) == 3


def test_failed_delete_in_the_stored_table(spark, tmp_path):
    out = str(tmp_path / "t")
    failures = FL.failure_record(fx.fetch_rows(S.table_stream(spark, SF001, "events")))
    S.failed_upsert_stream(failures, out, str(tmp_path / "ck"))
    table = S.failed_table(spark, out)
    before = table.read()
    done = before.select("url").orderBy("url").limit(5)
    want = sorted(map(tuple, FL.failed_remove(before, done).select(before.columns).collect()))
    S.failed_delete(table, done)
    assert sorted(map(tuple, table.read().collect())) == want
    S.failed_upsert_stream(failures, out, str(tmp_path / "ck"))  # nothing new: the deletion stays
    assert sorted(map(tuple, table.read().collect())) == want


def test_failed_upsert_stream_over_several_batches(spark, tmp_path):
    """Batch n applies its failures to the table of n-1; the table then equals
    the one-shot batch upsert over all failures."""
    ts = F.col("ts")
    stream = parts(spark, tmp_path / "in", [ts < day(15), ts >= day(15)])
    out = str(tmp_path / "out")
    S.failed_upsert_stream(FL.failure_record(fx.fetch_rows(stream)), out, str(tmp_path / "ck"), n_buckets=3)
    table = S.failed_table(spark, out, 3)
    assert table.committed(1)
    cols = ["url_key", "url", "reason", "status_code", "failed_time", "retry_count", "created_at"]
    got = sorted(map(tuple, table.read().select(cols).collect()))
    exp = sorted(map(tuple, FL.failed_upsert(None, FL.failure_record(fx.fx_fetch(spark, SF001))).select(cols)
                     .collect()))
    assert got == exp


def test_content_changes_are_stitched_at_bucket_ends(spark, tmp_path):
    """Small buckets, files that bring sequence numbers in any order, repeats."""
    import random
    rnd = random.Random(3)
    seen = {(k, n): rnd.choice("ab") for k in (1, 2, None) for n in rnd.sample(range(60), 40)}
    rows = [(k, n, t) for (k, n), t in seen.items()] + [(1, None, "lost"), (3, 7, None)]
    rnd.shuffle(rows)
    os.makedirs(tmp_path / "in")
    schema = "page long, seq int, text string"
    for i in range(3):
        part = tempfile.mkdtemp()
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("overwrite").parquet(part)
        shutil.copy(glob.glob(f"{part}/*.parquet")[0], tmp_path / "in" / f"part-{i}.parquet")
    stream = S.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    out = str(tmp_path / "out")
    S.content_change_stream(stream, "page", "seq", "text", out, str(tmp_path / "ck"), bucket=8)
    want, last = set(), {}
    for k, n in sorted(seen, key=lambda x: (str(x[0]), x[1])):
        if last.get(k, "") != seen[k, n]:
            want.add((k, n))
        last[k] = seen[k, n]
    got = {(r.page_key, r.seq): r.content_hash for r in S.content_changes(spark, out).collect()}
    assert got.keys() == want | {(3, 7)} and got[3, 7] is None
