"""Topics in folders: offsets, poll size, consumer groups, restarts."""

import glob
import json
import os
import re

from pyspark.sql import functions as F

from pagewright.sources import topics
from pagewright.sources.topics import TopicReader, consume, publish_topic, topic_stream
from pagewright.streaming.streams import batch_folder_writer


def records(spark, n, first=0):
    return spark.range(first, first + n).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"),
                                                F.concat(F.lit("line\n"), "id").alias("value"), "id")


def test_offsets_are_gapless_and_keys_keep_their_order(spark, tmp_path):
    publish_topic(records(spark, 500), str(tmp_path), "t", ["id"], n_partitions=3, segment_records=40)
    seen = []
    for p in range(3):
        reader = TopicReader(f"{tmp_path}/t", None, 10 ** 6)
        end = reader.latestOffset()[str(p)]
        got = [r for s in reader.partitions({}, {str(p): end}) for r in reader.read(s)]
        assert [r[1] for r in got] == list(range(end))
        ids = [int(r[3].split("\n")[1]) for r in got]
        assert ids == sorted(ids) and len(glob.glob(f"{tmp_path}/t/partition={p}/base=*")) == -(-end // 40)
        seen += ids
        part = [r for s in reader.partitions({str(p): 13}, {str(p): 95}) for r in reader.read(s)]
        assert part == got[13:95]
    assert sorted(seen) == list(range(500))


def test_polls_are_bounded_and_a_restart_goes_on(spark, tmp_path):
    path, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    publish_topic(records(spark, 400), path, "t", ["id"], n_partitions=2, segment_records=100)
    consume(topic_stream(spark, path, "t", max_poll_records=60), ck, batch_folder_writer(out))
    got = spark.read.parquet(out)
    polls = got.groupBy("batch", "partition").count()
    assert polls.agg(F.max("count")).first()[0] <= 60 and polls.select("batch").distinct().count() >= 4
    assert got.count() == 400 == got.select("partition", "offset").distinct().count()
    # more records come; the same checkpoint reads only those
    before = got.agg(F.max("batch")).first()[0]
    p = sorted(os.listdir(f"{path}/t"))[-1]
    base = int(got.filter(F.col("partition") == int(p[10:])).agg(F.max("offset")).first()[0]) + 1
    os.makedirs(f"{path}/t/{p}/base={base}")
    with open(f"{path}/t/{p}/base={base}/part-0.json", "w") as f:
        f.write("".join(json.dumps({"key": "k", "value": f"new {i}"}) + "\n" for i in range(130)))
    consume(topic_stream(spark, path, "t", max_poll_records=60), ck, batch_folder_writer(out))
    new = spark.read.parquet(out).filter(F.col("batch") > before)
    assert sorted(r.value for r in new.collect()) == sorted(f"new {i}" for i in range(130))
    consume(topic_stream(spark, path, "t", max_poll_records=60), ck, batch_folder_writer(out))
    assert spark.read.parquet(out).count() == 530


def test_a_group_goes_on_without_the_checkpoint(spark, tmp_path):
    path = str(tmp_path / "in")
    publish_topic(records(spark, 90), path, "t", ["id"], n_partitions=1)
    first, second = TopicReader(f"{path}/t", "g", 50), TopicReader(f"{path}/t", "g", 50)
    end = first.latestOffset()
    assert end == {"0": 50}
    first.commit(end)
    assert second.initialOffset() == {"0": 50} and second.latestOffset() == {"0": 90}
    assert TopicReader(f"{path}/t", "other", 50).initialOffset() == {}
    assert TopicReader(f"{path}/none", None, 50).latestOffset() == {}


def test_a_micro_batch_makes_several_polls(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    publish_topic(records(spark, 400), path, "t", ["id"], n_partitions=2, segment_records=100)
    reader = TopicReader(f"{path}/t", None, 30, polls=4)
    end = reader.latestOffset()
    assert max(end.values()) == 120
    for s in reader.partitions({}, end):
        polls = list(reader.poll(s))
        assert [len(p) for p in polls] == [30] * (s.end // 30) + [s.end % 30] * (s.end % 30 > 0)
        assert [r for p in polls for r in p] == list(reader.read(s))
    consume(topic_stream(spark, path, "t", max_poll_records=30, polls_per_batch=4), str(tmp_path / "ck"),
            batch_folder_writer(out))
    got = spark.read.parquet(out)
    sizes = [r["count"] for r in got.groupBy("batch", "partition").count().collect()]
    assert max(sizes) == 120 and got.select("batch").distinct().count() <= 4
    assert sorted(r.value for r in got.collect()) == sorted(f"line\n{i}" for i in range(400))


def test_a_backlog_is_listed_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    publish_topic(records(spark, 90), path, "t", ["id"], n_partitions=1, segment_records=20)
    listed = []
    monkeypatch.setattr(topics, "_segments", lambda uri, find=topics._segments: listed.append(uri) or find(uri))
    reader, start, ids = TopicReader(f"{path}/t", None, 25), {}, []
    for at in (25, 50, 75, 90):
        end = reader.latestOffset()
        assert end == {"0": at} and len(listed) == 1
        ids += [int(r[3].split("\n")[1]) for s in reader.partitions(start, end) for r in reader.read(s)]
        start = end
    assert ids == list(range(90)) and len(listed) == 1
    # what comes later is found when the known records are taken
    os.makedirs(f"{path}/t/partition=0/base=90")
    with open(f"{path}/t/partition=0/base=90/part-0.json", "w") as f:
        f.write('{"key": "k", "value": "new"}\n')
    assert reader.latestOffset() == {"0": 91} and len(listed) == 2
    again = TopicReader(f"{path}/t", None, 25)  # a restart plans the last batch first
    assert [r[3] for s in again.partitions({"0": 89}, {"0": 91}) for r in again.read(s)] == ["line\n89", "new"]


def test_src_messages_takes_few_micro_batches(spark, tmp_path):
    from pagewright.plans.catalog import queries
    rows = spark.range(9000).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
                                    F.format_string('{"k": %d}', F.col("id") % 50).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["src_messages"](spark, str(tmp_path))
    folders = {re.search(r"batch=\d+", f)[0] for f in got.inputFiles()}
    assert len(folders) == 1
    assert sorted(map(tuple, got.collect())) == [(i, i % 50 if i % 10 else None) for i in range(9000)]
