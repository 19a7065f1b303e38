"""Quality by attention-based multiple-instance learning: gradients, passages,
held-out accuracy, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import catalog, quality
from pagewright.llm.quality import AttentionNet, fit, passage_features, pieces, score
from odd_rows import nothing, odd  # noqa: F401

SF01 = "/root/testdata/sf0.01"


def loss(net, x, ptr, label):
    total = 0.0
    for i, y in enumerate(label):
        h, _, _, logit = net.encode(x[ptr[i]:ptr[i + 1]])
        weight = np.exp(logit - logit.max())
        z = (weight / weight.sum()) @ h @ net.p["c"] + net.p["c0"][0]
        total += np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))
    return total / len(label)


def test_gradients_against_differences():
    texts = ["Some words here. " * 40, "SHOUT!! SHOUT!! " * 30, "x", "", "tokens | of | a | table " * 20]
    label = np.array([1, 0, 1, 0, 1], dtype=float)
    ptr, x = passage_features([t.encode() for t in texts])
    net = AttentionNet(hidden=5, gate=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    got = net.gradients(x.astype(float), ptr, label)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            kept, h = flat[i], 1e-6
            flat[i] = kept + h
            up = loss(net, x.astype(float), ptr, label)
            flat[i] = kept - h
            down = loss(net, x.astype(float), ptr, label)
            flat[i] = kept
            assert got[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * h), abs=1e-6)


def test_passages_cover_whole_texts():
    texts = ["one two three", "", "   ", " ".join(f"w{i}" for i in range(100)), "é\tü\n" * 50]
    ptr, x = passage_features([t.encode() for t in texts])
    assert list(np.diff(ptr)) == [1, 1, 1, 4, 4]
    for i, t in enumerate(texts):  # a text's features don't depend on its neighbours
        alone_ptr, alone = passage_features([t.encode()])
        assert np.array_equal(alone, x[ptr[i]:ptr[i + 1]])
    kinds = x[:, quality.PAIR_BUCKETS:quality.PAIR_BUCKETS + 8] ** 2
    assert np.allclose(kinds.sum(axis=1), 1)  # every byte is counted, in one passage


def test_long_texts_in_pieces(monkeypatch):
    net = AttentionNet()
    text = "some words and NUMBERS 123 then | more. " * 400
    whole = net.scores([text])[0]
    assert "".join(p.decode() for p in pieces(text)) == text
    monkeypatch.setattr(quality, "PIECE_BYTES", 1280)  # 32 passages of 8 words and a space would end elsewhere
    assert "".join(p.decode() for p in pieces(text)) == text
    assert net.scores([text])[0] == pytest.approx(whole, abs=0.02)
    assert net.scores([text, "short", text]) == pytest.approx([net.scores([text])[0], net.scores(["short"])[0],
                                                               net.scores([text])[0]])


def auc(label, value):
    order = np.argsort(value, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


def test_held_out_accuracy(spark):
    got = catalog.queries()["op13_quality"](spark, SF01)
    assert got.columns == ["doc_id", "score", "predicted", "held_out"]
    rows = got.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").filter("held_out").collect()
    label = np.array([r.quality for r in rows])
    value = np.array([r.score for r in rows])
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert auc(label, value) > 0.97
    assert np.mean((value >= 0.7) == label) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    turned = labels.withColumn("quality", F.when(catalog.quality_held_out(), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    nets = [fit(docs, x.filter(~catalog.quality_held_out())) for x in (labels, turned)]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (5, None), (7, 0), (6, 1), (9, 7)],
                                   "doc_id bigint, quality int")
    net = fit(odd, labels)
    assert net.constant is None
    got = score(odd, net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[6]) == 1 and by[2] == by[3] and None in by  # repeated rows; null and empty texts alike
    assert score(nothing, net).count() == 0
    assert score(odd, fit(odd, labels.limit(0))).filter("score = 0.5").count() == 11
    assert score(odd, fit(nothing, labels)).filter("score = 0.5").count() == 11
    assert score(odd, fit(odd, labels.filter("quality = 1"))).filter("score = 1 and predicted = 1").count() == 11
