"""Ordered per-key computations that stay parallel when one key is hot.

A window ``PARTITION BY key ORDER BY ts`` sends a whole key to one task; if
one domain holds a third of all rows that task holds a third of the data.
The helpers here split every key into buckets -- row-bounded, order-contiguous
chunks from ``range_chunks`` (the default everywhere) or time buckets:

* ``range_chunks``      – range partitioning on (key, order), sorted, cut every
  2^17 rows: a chunk never exceeds that, whatever the volume or skew;
* ``bucketed_lag``      – previous row within a key (local lag, and for the
  first row of a bucket the last row of the nearest earlier bucket);
* ``bucketed_prefix``   – running sum / max within a key (local running value
  plus the exclusive prefix over the per-bucket totals);
* ``trailing_count``    – count / min over a trailing time range, from running
  sums over entering and leaving rows;

Only per-bucket summaries (one small row per key and bucket) are ever ordered
per key in a single task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOUR = 3600


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP_NTZ (no time zone involved)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def ntz_from_micros(micros) -> Column:
    """TIMESTAMP_NTZ of microseconds since 1970-01-01 (inverse of ``epoch_micros``)."""
    c = F.col(micros) if isinstance(micros, str) else micros
    seconds = (c.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds)


def time_bucket(ts, seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1000000)).cast("long")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def bucketed_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>`` = value of ``col`` on the previous row of the key.

    ``order`` must give a total order within a key.  The result also has
    ``has_prev`` (False on the first row of a key).
    """
    keys, order, cols = list(keys), list(order), list(cols)
    d = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    d = (d.withColumn("_rn", F.row_number().over(w))
         .withColumn("_local", F.lag(row).over(w)))
    # last row of every bucket, then the previous non-empty bucket's last row
    last = d.groupBy(*keys, "_b").agg(
        F.max_by(row, F.struct(*_cols(order))).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    last = last.select(*keys, "_b", F.lag("_last").over(wb).alias("_carry"))
    d = d.join(last, [*keys, "_b"], "left")
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_local"))
    d = d.withColumn("_prev", prev).withColumn("has_prev", F.col("_prev").isNotNull())
    for c in cols:
        d = d.withColumn(prefix + c, F.col("_prev")[c])
    return d.drop("_b", "_rn", "_local", "_carry", "_prev")


def bucketed_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                    out: str, value: Column, how: str = "sum") -> DataFrame:
    """Running (inclusive) ``sum`` or ``max`` of ``value`` within each key."""
    keys, order = list(keys), list(order)
    agg = {"sum": F.sum, "max": F.max}[how]
    d = df.withColumn("_b", bucket).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", agg("_v").over(w))
    tot = d.groupBy(*keys, "_b").agg(agg("_v").alias("_tot"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", agg("_tot").over(wb).alias("_before"))
    d = d.join(tot, [*keys, "_b"], "left")
    if how == "sum":
        res = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    else:
        res = F.greatest(F.col("_before"), F.col("_local"))
    return d.withColumn(out, res).drop("_b", "_v", "_local", "_before")


def bucketed_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  values: dict[str, Column]) -> DataFrame:
    """Several running (inclusive) sums within each key in one pass."""
    keys, names = list(keys), list(values)
    d = df.withColumn("_b", bucket).withColumns({f"_v_{k}": v for k, v in values.items()})
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = d.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    tot = tot.select(*keys, "_b", *[F.sum(f"_t_{k}").over(wb).alias(f"_p_{k}") for k in names])
    d = d.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w) for k in names}).join(tot, [*keys, "_b"], "left")
    zero = F.lit(0)
    d = d.withColumns({k: F.coalesce(f"_p_{k}", zero) + F.coalesce(f"_l_{k}", zero) for k in names})
    return d.drop("_b", *[f"_{x}_{k}" for k in names for x in "vlp"])


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, width_micros: int,
                   n_chunks: int | None = None) -> DataFrame:
    """Rows of the same key with ``ts`` in (t - width, t], and the oldest such ``ts``.

    Adds ``n_trailing`` (current row and peers with the same ts included) and
    ``oldest_ts``.  With no keys the count is global.  Work is linear however
    many rows a window holds: a row adds one at its time and takes it back
    ``width`` later, so the counts are running sums over distinct times; the
    oldest time is the one whose rank follows the last expired.
    """
    keys = list(keys)
    rows = df.withColumn("_t", epoch_micros(ts))
    at = rows.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_at"))
    enter = at.select(*keys, "_t", "_n", F.lit(1).alias("_in"), F.lit(0).alias("_out"), "_at")
    leave = at.select(*keys, (F.col("_t") + width_micros).alias("_t"), (-F.col("_n")).alias("_n"),
                      F.lit(0).alias("_in"), F.lit(1).alias("_out"), F.lit(None).cast("timestamp_ntz").alias("_at"))
    steps = enter.unionByName(leave).groupBy(*keys, "_t").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_in", "_out")], F.max("_at").alias("_at"))
    steps = range_chunks(steps, keys, ["_t"], n_chunks)
    steps = bucketed_sums(steps, keys, ["_t"], F.col("_chunk"), {
        "n_trailing": F.col("_n"), "_rank": F.col("_in"), "_expired": F.col("_out")})
    steps = cut_lineage(steps.filter(F.col("_at").isNotNull()).drop("_chunk", "_n", "_in", "_out"))
    oldest = steps.select(*keys, (F.col("_rank") - 1).alias("_expired"), F.col("_at").alias("oldest_ts"))
    found = steps.select(*keys, "_t", "n_trailing", "_expired").join(oldest, [*keys, "_expired"]).drop("_expired")
    return rows.join(found, [*keys, "_t"], "left").drop("_t")


CHUNK_ROWS = 1 << 17


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_chunks: int | None = None,
                 name: str = "_chunk", chunk_rows: int = CHUNK_ROWS, materialize: bool = True) -> DataFrame:
    """Bounded, order-contiguous chunks of the rows of every key.

    Rows are range-partitioned on (keys, order) -- so a hot key is spread over
    many partitions -- sorted inside each partition, and cut every
    ``chunk_rows`` rows.  ``monotonically_increasing_id`` is partition-local
    (partition id in the high bits, row index below), so ``id // chunk_rows``
    numbers the chunks in (keys, order) order and no chunk crosses a partition.
    A chunk therefore never holds more than ``chunk_rows`` rows, whatever the
    data size or key skew.  ``n_chunks`` is the number of range partitions; by
    default it follows the size of the rows (at most the shuffle partition
    count, small partitions are merged at runtime).

    Range bounds come from sampling, so two evaluations of the same plan may
    cut differently; with ``materialize`` (the default) the chunked rows are
    checkpointed to the shared folder once, and every later branch (a window
    and its carry, say) sees the same chunks.  A caller that consumes the
    result exactly once and checkpoints after it may pass False.
    """
    if chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    cols = [F.col(c) for c in list(keys) + list(order)]
    spread = df.repartitionByRange(n_chunks, *cols) if n_chunks else df.repartitionByRange(*cols)
    out = (spread.sortWithinPartitions(*cols)
           .withColumn(name, F.floor(F.monotonically_increasing_id() / F.lit(chunk_rows)).cast("long")))
    return cut_lineage(out) if materialize else out
