"""Tables of one row for each key: commits, deletes, compaction, replays."""

import random

import pytest

from pagewright.sources import folders
from pagewright.sources.keyed_table import KeyedTable

SCHEMA = "url string, n int, note string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("compact_every", [2, 3, 8])
def test_random_commits_against_a_dict(spark, tmp_path, compact_every):
    rnd, plain = random.Random(compact_every), {}
    table = KeyedTable(spark, str(tmp_path / "t"), "url", SCHEMA, n_buckets=3, compact_every=compact_every)
    assert table.read().count() == 0
    for step in range(6):
        keys = rnd.sample([f"u{i}" for i in range(12)], 4)
        changes = [(k, step, f"s{step}", rnd.random() < 0.3) for k in keys]
        for k, n, note, gone in changes:
            if gone:
                plain.pop(k, None)
            else:
                plain[k] = (k, n, note)
        table.commit(spark.createDataFrame(changes, SCHEMA + ", _gone boolean"))
        assert rows(table.read()) == sorted(plain.values())
    ask = spark.createDataFrame([("u1",), ("u5",), ("u5",), ("zz",)], "url string")
    assert rows(table.read_for(ask)) == sorted(v for k, v in plain.items() if k in ("u1", "u5"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "url", SCHEMA, n_buckets=2)
    table.commit(spark.createDataFrame([("a", 1, "x")], SCHEMA), batch=0)
    table.commit(spark.createDataFrame([("b", 1, "x")], SCHEMA), batch=1)
    table.commit(spark.createDataFrame([("a", 9, "again")], SCHEMA), batch=0)
    table.commit(spark.createDataFrame([("b", 9, "again")], SCHEMA), batch=1)
    assert table.committed(1) and not table.committed(2)
    assert rows(table.read()) == [("a", 1, "x"), ("b", 1, "x")]
    table.commit(spark.createDataFrame([("a", 0, "x", True), ("b", 0, "x", True)], SCHEMA + ", _gone boolean"))
    assert table.read().count() == 0 and table.committed(1)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "url", SCHEMA, n_buckets=8)
    table.commit(spark.createDataFrame([(f"u{i}", i, "x") for i in range(100)], SCHEMA))
    before = set(folders.matching(spark, f"{path}/data/folder=*/bucket=*"))
    table.commit(spark.createDataFrame([("u1", 5, "y")], SCHEMA))
    new = set(folders.matching(spark, f"{path}/data/folder=*/bucket=*")) - before
    assert len(new) == 1


def test_a_commit_without_a_manifest_does_not_show(spark, tmp_path):
    """A commit that failed before its manifest is overwritten by the next."""
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "url", SCHEMA, n_buckets=2)
    table.commit(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    spark.createDataFrame([("a", 7, "lost", False, 0), ("a", 7, "lost", False, 1)],
                          SCHEMA + ", _gone boolean, bucket int").write.partitionBy("bucket").parquet(f"{path}/data/folder=2")
    assert rows(table.read()) == [("a", 1, "x")]
    table.commit(spark.createDataFrame([("b", 2, "y")], SCHEMA))
    assert rows(table.read()) == [("a", 1, "x"), ("b", 2, "y")]
