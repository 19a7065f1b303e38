"""Stream queries give the batch result over a folder of part files read in
several micro-batches, in any file order."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pagewright.plans.catalog import queries
from pagewright.streaming import streams as S

from conftest import SF001

KEYS = [k for k in queries() if k.startswith("stream_")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with events, documents, pages and conversations in three part
    files each, the later rows in the earlier files."""
    root = tmp_path_factory.mktemp("layout")
    for f in glob.glob(f"{SF001}/*.parquet"):
        os.symlink(f, root / os.path.basename(f))
    for name, key in (("events", "ts"), ("documents", "doc_id"), ("pages", "page_id"), ("conversations", "turn")):
        t = spark.read.parquet(f"{SF001}/{name}.parquet")
        ranks = t.withColumn("_part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy(F.desc(key))))
        os.unlink(root / f"{name}.parquet")
        os.mkdir(root / f"{name}.parquet")
        for i in (1, 2, 3):
            out = str(tmp_path_factory.mktemp("part"))
            ranks.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("overwrite").parquet(out)
            target = root / f"{name}.parquet" / f"part-{i}.parquet"
            shutil.copy(glob.glob(f"{out}/*.parquet")[0], target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order
    return str(root)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_over_files_and_batches(spark, folder, key, monkeypatch):
    run = queries()[key]
    one = sorted(map(repr, run(spark, SF001).collect()))
    plain = S.table_stream
    monkeypatch.setattr(S, "table_stream", lambda s, d, n: plain(s, d, n, max_files_per_trigger=1))
    many = sorted(map(repr, run(spark, folder).collect()))
    assert one and many == one
