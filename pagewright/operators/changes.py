"""Content change detection over repeated observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .scan import bucketed_lag, range_chunks


def content_changed(obs: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """md5 of each observation and whether it differs from the previous one of
    the key; the first observation counts as changed."""
    d = range_chunks(obs.select(key, seq, content_hash(text).alias("content_hash")), [key], [seq])
    d = bucketed_lag(d, [key], [seq], F.col("_chunk"), ["content_hash"])
    changed = ~F.col("has_prev") | (F.col("content_hash") != F.col("prev_content_hash"))
    return d.select(key, seq, "content_hash", changed.alias("changed"))
