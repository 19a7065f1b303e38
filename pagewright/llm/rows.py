"""Rows with a key of their own, for operators whose ids may be null or shared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_path


def numbered(docs: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    """The columns and a row number, written once so that every reader sees the
    same numbers."""
    path = scratch_path(docs.sparkSession, "numbered")
    docs.select(F.monotonically_increasing_id().alias(name), *columns).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
