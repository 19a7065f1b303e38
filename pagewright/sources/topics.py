"""Message topics in folders, read as a stream by offsets.

A topic is a folder ``<path>/<topic>/partition=<p>/base=<offset>/*.json``: every
partition is a run of records (key, value), one JSON line each, in segments that
are named by the offset of their first record.  ``TopicSource`` is a streaming
data source over it: a query starts at the earliest record or where its
consumer group has left off and reads each partition in a task of its own.  The
task polls: it takes at most ``max_poll_records`` at a time, and polls at most
``polls_per_batch`` times in a micro-batch (once by default).
"""

from __future__ import annotations

import io
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_package

# Poll size of the consumer, records; polls of a partition in a
# micro-batch where a long topic is read (a micro-batch has costs of its own,
# whatever it holds); records of a segment.
MAX_POLL_RECORDS = 500
BACKLOG_POLLS = 200
SEGMENT_RECORDS = 10_000


def publish_topic(rows: DataFrame, path: str, topic: str, order, n_partitions: int = 8,
                  segment_records: int = SEGMENT_RECORDS) -> None:
    """Write (key, value) rows as a topic.  A key's records lie in one
    partition, in ``order``; offsets are running counts over bounded chunks,
    so a hot partition is numbered by many tasks."""
    from ..operators.scan import bucketed_prefix, range_chunks

    order = list(order)
    keyed = rows.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(n_partitions)).cast("int"))
    keyed = range_chunks(keyed, ["partition"], order)
    keyed = bucketed_prefix(keyed, ["partition"], order, F.col("_chunk"), "offset", F.lit(1))
    keyed = keyed.withColumn("offset", F.col("offset") - 1)
    base = (F.col("offset") - F.pmod("offset", F.lit(segment_records))).alias("base")
    (keyed.select("partition", base, "offset", "key", "value").repartition("partition", "base")
     .sortWithinPartitions("partition", "base", "offset").drop("offset")
     .write.mode("overwrite").partitionBy("partition", "base").option("ignoreNullFields", "false")
     .json(f"{path}/{topic}"))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path there."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _segments(uri: str) -> dict[int, list[tuple[int, str, int]]]:
    """{partition: [(first offset, file, bytes), ...]} in offset order."""
    fs, folder = _store(uri)
    found: dict[int, list[tuple[int, str, int]]] = {}
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True)):
        m = re.search(r"/partition=(\d+)/base=(\d+)/[^/]*\.json$", f.path)
        if m and f.is_file:
            found.setdefault(int(m[1]), []).append((int(m[2]), f.path, f.size))
    return {p: sorted(files) for p, files in found.items()}


class Slice(InputPartition):
    """Records [start, end) of a partition and the segments that hold them,
    [(first offset, file), ...]."""

    def __init__(self, partition: int, start: int, end: int, files: list[tuple[int, str]]):
        self.partition, self.start, self.end, self.files = partition, start, end, files


class TopicReader(DataSourceStreamReader):
    """Offsets are {partition: next record}.  The group's file holds offsets
    that the query has finished with; it is at most one micro-batch behind.  The
    topic is listed again as soon as a partition's known records are taken, so a
    backlog isn't listed in every micro-batch."""

    def __init__(self, folder: str, group: str | None, limit: int, polls: int = 1):
        self.folder, self.limit, self.polls = folder, limit, polls
        self.group = f"{folder}/_groups/{group}.json" if group else None
        self.at: dict[str, int] | None = None
        self.counted: dict[str, tuple[int, int]] = {}
        self.segments: dict[int, list[tuple[int, str, int]]] = {}
        self.ends: dict[str, int] = {}

    def _look(self) -> None:
        """List the topic: its segments and where each partition ends."""
        ends, (fs, _) = {}, _store(self.folder)
        self.segments = _segments(self.folder)
        for p, files in self.segments.items():
            base, last, size = files[-1]
            if self.counted.get(last, (None, 0))[0] != size:  # only what has grown is counted again
                with fs.open_input_stream(last) as f:
                    self.counted[last] = size, sum(1 for _ in io.BufferedReader(f))
            ends[str(p)] = base + self.counted[last][1]
        self.ends = ends

    def initialOffset(self) -> dict:
        if self.group:
            fs, path = _store(self.group)
            if fs.get_file_info(path).is_file:
                with fs.open_input_stream(path) as f:
                    return json.loads(f.read())
        return {}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        if not self.ends or any(self.at.get(p, 0) >= end for p, end in self.ends.items()):
            self._look()
        most = self.limit * self.polls
        self.at = {p: min(end, self.at.get(p, 0) + most) for p, end in self.ends.items()}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {p: max(n, (self.at or {}).get(p, 0)) for p, n in end.items()}
        if any(n > self.ends.get(p, 0) for p, n in end.items()):  # a planned batch after a restart
            self._look()
        return [Slice(int(p), start.get(p, 0), n, self._holding(int(p), start.get(p, 0), n))
                for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def _holding(self, partition: int, start: int, end: int) -> list[tuple[int, str]]:
        files = self.segments.get(partition, [])
        first = max(bisect_right(files, start, key=lambda f: f[0]) - 1, 0)
        return [(base, name) for base, name, _ in files[first:bisect_left(files, end, key=lambda f: f[0])]]

    def _lines(self, part: Slice) -> Iterator[tuple[int, bytes]]:
        fs, _ = _store(self.folder)
        for base, name in part.files:
            with fs.open_input_stream(name) as f:
                yield from islice(enumerate(io.BufferedReader(f), base), max(part.start - base, 0), part.end - base)

    def poll(self, part: Slice) -> Iterator[list[tuple]]:
        """The records of a slice, at most ``limit`` at a time."""
        lines = self._lines(part)
        while polled := [*islice(lines, self.limit)]:
            records = ((n, json.loads(line)) for n, line in polled)
            yield [(part.partition, n, r.get("key"), r.get("value")) for n, r in records]

    def read(self, part: Slice) -> Iterator[tuple]:
        for polled in self.poll(part):
            yield from polled

    def commit(self, end: dict) -> None:
        if self.group:
            fs, path = _store(self.group)
            fs.create_dir(path.rsplit("/", 1)[0])
            with fs.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{path}.new", path)


class TopicSource(DataSource):
    """Options: path, topic, group (none: start at the earliest record),
    max_poll_records, polls_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "topic_folder"

    def schema(self) -> str:
        return "partition int, offset bigint, key string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        folder = f"{self.options['path'].rstrip('/')}/{self.options['topic']}"
        return TopicReader(folder, self.options.get("group"),
                           int(self.options.get("max_poll_records", MAX_POLL_RECORDS)),
                           int(self.options.get("polls_per_batch", 1)))


def topic_stream(spark: SparkSession, path: str, topic: str, group: str | None = None,
                 max_poll_records: int = MAX_POLL_RECORDS, polls_per_batch: int = 1) -> DataFrame:
    """(partition, offset, key, value) of a topic as a stream."""
    ship_package(spark)
    spark.dataSource.register(TopicSource)
    r = spark.readStream.format("topic_folder").option("path", path).option("topic", topic).option(
        "max_poll_records", max_poll_records).option("polls_per_batch", polls_per_batch)
    return (r.option("group", group) if group else r).load()


def consume(messages: DataFrame, checkpoint: str, batch_fn) -> None:
    """Poll until nothing is left, then stop; a later call with the same
    checkpoint goes on behind the last finished poll."""
    q = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_fn).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
