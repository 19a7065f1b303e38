"""Event logs of keyed state machines, summarised by key and time bucket.

A state machine's result depends on the order of its events, and a stream
brings them in any order.  So each micro-batch appends its events to the shared
log, which is laid out by time bucket, and summarises anew just the (key,
bucket) pairs that it touched; the state of a key is what its buckets'
summaries make of it, one after the other.  Nothing is held in the state store,
a hot key is spread over its buckets and, inside a bucket, over the stretches
that tasks read, and an event counts however late it comes, until its bucket is
closed: buckets that end more than ``retention`` before the newest event keep
their summaries only, their events are deleted, and what still comes for them
is counted as late.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folders

DAY = 86400
_CLOCK = "newest bigint, closed bigint"


class EventLog:
    """Log at ``path`` of events ordered by a column ``t`` (microseconds, or any
    number), in buckets of ``width``; without ``retention`` none is closed.

    ``summarise`` takes events with ``key`` and ``bucket`` and returns rows with
    these two and whatever sums their events up.
    """

    def __init__(self, path: str, key: str, schema: T.StructType, summarise: Callable[[DataFrame], DataFrame],
                 width: int = DAY * 1_000_000, retention: int | None = 60 * DAY * 1_000_000):
        self.path, self.key, self.schema, self.summarise = path.rstrip("/"), key, schema, summarise
        self.width, self.retention = width, retention

    def clock(self, spark: SparkSession, before: int) -> tuple[int | None, int | None]:
        """(newest event time, first open bucket) after the batches before ``before``."""
        done = [int(p.rsplit("=", 1)[1]) for p in folders.matching(spark, f"{self.path}/clock/batch=*")]
        done = [b for b in done if b < before]
        if not done:
            return None, None
        row = spark.read.schema(_CLOCK).parquet(f"{self.path}/clock/batch={max(done)}").first()
        return row["newest"], row["closed"]

    def _events(self, spark: SparkSession) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()),
                               T.StructField("bucket", T.LongType())])
        return spark.read.schema(stored).parquet(f"{self.path}/events")

    def append(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take in a micro-batch; returns the keys that it touched.  Running the
        same batch again writes the same folders again."""
        spark = batch.sparkSession
        newest, closed = self.clock(spark, batch_id)
        rows = batch.select(*self.schema.names).withColumn("bucket", F.expr(f"t div {self.width}"))
        open_ = F.lit(True) if closed is None else F.col("bucket") >= closed
        (rows.filter(open_).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/events/batch={batch_id}"))
        rows.filter(~open_).groupBy(self.key).agg(F.count(F.lit(1)).alias("late")) \
            .write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")

        log = self._events(spark).filter(F.col("batch") <= batch_id)
        mine = log.filter(F.col("batch") == batch_id)
        # the open buckets are at most retention / width
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]
        pairs = mine.select(self.key, "bucket").distinct()
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (self.key, "bucket")]
        again = log.filter(F.col("bucket").isin(*touched)).alias("l").join(pairs.alias("p"), same, "left_semi") \
            if touched else log.limit(0)
        self.summarise(again.drop("batch")).write.mode("overwrite").parquet(f"{self.path}/summaries/batch={batch_id}")

        last = mine.agg(F.max("t")).first()[0]
        newest = max((x for x in (newest, last) if x is not None), default=None)
        ends = None if newest is None or self.retention is None else (newest - self.retention) // self.width
        spark.createDataFrame([(newest, ends if closed is None or ends is None else max(ends, closed))], _CLOCK) \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch={batch_id}")
        if closed is not None:  # closed before this batch: not even its replay reads them
            for p in folders.matching(spark, f"{self.path}/events/batch=*/bucket=*"):
                if int(p.rsplit("=", 1)[1]) < closed:
                    folders.delete(spark, p)
        return mine.select(self.key).distinct()

    def summaries(self, spark: SparkSession, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """The newest summaries of every (key, bucket), of all keys or of ``keys``."""
        t = spark.read.parquet(f"{self.path}/summaries")
        if upto is not None:
            t = t.filter(F.col("batch") <= upto)
        if keys is not None:
            t = t.alias("l").join(keys.alias("p"), F.col(f"l.{self.key}").eqNullSafe(F.col(f"p.{self.key}")),
                                  "left_semi")
        last = t.groupBy(self.key, "bucket").agg(F.max("batch").alias("batch"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (self.key, "bucket", "batch")]
        return t.alias("l").join(last.alias("p"), same, "left_semi").drop("batch")

    def late(self, spark: SparkSession) -> DataFrame:
        """(key, late): events that came after their bucket had been closed."""
        return spark.read.parquet(f"{self.path}/late").groupBy(self.key).agg(F.sum("late").alias("late"))
