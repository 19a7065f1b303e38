"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words, over its whole
text).  Every passage is encoded from its bytes: shares of hashed byte pairs,
shares of character classes and word statistics go through one hidden layer.  A
gated attention unit (a tanh and a sigmoid branch, multiplied) weighs the
passages of a document, and a logistic unit scores the weighted sum of their
encodings.  Only document labels are learned from; the attention finds out
which passages they hang on.

The network is fitted by Adam on a bounded sample: about ``docs_per_label``
labelled documents of either label, taken by a hash of the id, of each at most
``max_train_chars`` characters.  Scores cover every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.joins import broadcast_bounded
from pagewright.session import ship_package

from .textkernel import mix, span_hashes, text_chunks, utf8

PASSAGE_WORDS = 32
PAIR_BUCKETS = 128
DOCS_PER_LABEL = 1000
MAX_TRAIN_CHARS = 12_000
PIECE_BYTES = 1 << 20
KEEP_SCORE = 0.7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.full(256, 7, dtype=np.int64)  # other ASCII symbols and controls
_KIND[_SPACE] = 0
_KIND[10] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[128:] = 5
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_KINDS = 8
_PAIR = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
N_WORD_STATS = 6
N_FEATURES = PAIR_BUCKETS + _KINDS + N_WORD_STATS


def pieces(text: str):
    """The text's bytes in pieces of bounded size, cut at white space (a run
    of bytes without any is cut where the piece ends)."""
    blob, start = utf8(text), 0
    while len(blob) - start > PIECE_BYTES:
        end = max(blob.rfind(c, start + PIECE_BYTES // 2, start + PIECE_BYTES) for c in (b" ", b"\n", b"\t"))
        end = start + PIECE_BYTES if end < 0 else end
        yield blob[start:end]
        start = end
    yield blob[start:]


def passage_features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, features): passages ptr[i]:ptr[i+1] belong to blob i; every blob
    has one at least."""
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    text_at = np.cumsum([0] + [len(b) + 1 for b in blobs])
    turn = np.diff(np.concatenate([[1], _SPACE[buf].astype(np.int8)]))
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    word_ptr = np.searchsorted(starts, text_at)
    n_passages = np.maximum(1, -(-np.diff(word_ptr) // PASSAGE_WORDS))
    ptr = np.concatenate([[0], np.cumsum(n_passages)])
    doc = np.repeat(np.arange(len(blobs)), np.diff(word_ptr))
    passage = ptr[doc] + (np.arange(len(starts)) - word_ptr[doc]) // PASSAGE_WORDS
    # a passage reaches to the start of the next one
    first = np.searchsorted(passage, np.arange(ptr[-1]))
    begin = np.append(starts, len(buf))[first]
    begin[ptr[:-1]] = text_at[:-1]
    size = np.diff(np.append(begin, len(buf)))
    of = np.repeat(np.arange(ptr[-1]), size)

    out = np.zeros((ptr[-1], N_FEATURES), dtype=np.float32)
    after = np.append(buf[1:], np.uint8(10))
    after[text_at[1:] - 1] = 10  # the next blob has no part in this one
    pair = _PAIR[buf.astype(np.int64) * 256 + after]
    count = np.bincount(of * PAIR_BUCKETS + pair, minlength=ptr[-1] * PAIR_BUCKETS)
    out[:, :PAIR_BUCKETS] = np.sqrt(count.reshape(-1, PAIR_BUCKETS) / size[:, None])
    kind = np.bincount(of * _KINDS + _KIND[buf], minlength=ptr[-1] * _KINDS).reshape(-1, _KINDS)
    out[:, PAIR_BUCKETS:PAIR_BUCKETS + _KINDS] = np.sqrt(kind / size[:, None])

    words = np.maximum(1, np.bincount(passage, minlength=ptr[-1]))
    hashes = span_hashes(buf, starts, ends)
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, passage))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (passage[order][1:] != passage[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    last = _KIND[buf[ends - 1]]
    upper = (_KIND[buf[starts]] == 3) & (_KIND[buf[np.maximum(starts, ends - 2)]] == 3)
    stats = (again, new, last >= 6, upper, last == 7)
    by = (passage, passage[order], passage, passage, passage)
    for j, (flag, p) in enumerate(zip(stats, by)):
        out[:, PAIR_BUCKETS + _KINDS + j] = np.bincount(p, flag, minlength=ptr[-1]) / words
    length = np.bincount(passage, ends - starts, minlength=ptr[-1]) / words
    out[:, -1] = np.log1p(length)
    return ptr, out


class AttentionNet:
    """Encoder, gated attention and scoring unit; ``shift`` is the log odds of
    label 1 among the labelled documents, as the sample has as many of either."""

    def __init__(self, hidden: int = 24, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)

        def weights(rows, cols):
            return (rng.normal(size=(rows, cols)) / np.sqrt(rows)).astype(np.float32)

        self.p = {"w": weights(N_FEATURES, hidden), "b": np.zeros(hidden, np.float32),
                  "v": weights(hidden, gate), "u": weights(hidden, gate), "a": weights(gate, 1)[:, 0],
                  "c": weights(hidden, 1)[:, 0], "c0": np.zeros(1, np.float32)}
        self.mean = np.zeros(N_FEATURES, np.float32)
        self.scale = np.ones(N_FEATURES, np.float32)
        self.shift = 0.0
        self.constant: float | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(encodings, tanh branch, sigmoid branch, attention logits)."""
        h = np.tanh(((x - self.mean) * self.scale).clip(-8, 8) @ self.p["w"] + self.p["b"])
        t, s = np.tanh(h @ self.p["v"]), 1 / (1 + np.exp(-(h @ self.p["u"])))
        return h, t, s, (t * s) @ self.p["a"]

    def gradients(self, x: np.ndarray, ptr: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the bags ptr[i]:ptr[i+1]."""
        size = np.diff(ptr)
        h, t, s, logit = self.encode(x)
        top = np.repeat(np.maximum.reduceat(logit, ptr[:-1]), size)
        weight = np.exp(logit - top)
        weight /= np.repeat(np.add.reduceat(weight, ptr[:-1]), size)
        bag = np.add.reduceat(weight[:, None] * h, ptr[:-1])
        off = (1 / (1 + np.exp(-(bag @ self.p["c"] + self.p["c0"]))) - label) / len(label)
        each = np.repeat(off, size)
        pull = h @ self.p["c"]
        d_logit = weight * each * (pull - np.repeat(bag @ self.p["c"], size))
        d_t = d_logit[:, None] * self.p["a"] * s * (1 - t * t)
        d_s = d_logit[:, None] * self.p["a"] * t * s * (1 - s)
        d_h = (weight * each)[:, None] * self.p["c"] + d_t @ self.p["v"].T + d_s @ self.p["u"].T
        d_h *= 1 - h * h
        x = ((x - self.mean) * self.scale).clip(-8, 8)
        return {"w": x.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s,
                "a": (t * s).T @ d_logit, "c": bag.T @ off, "c0": off.sum(keepdims=True)}

    def fit(self, texts: list[str], labels: list[int], epochs: int = 40, batch: int = 64, rate: float = 0.005,
            decay: float = 1e-4, seed: int = 11) -> AttentionNet:
        label = np.array(labels, dtype=np.float32)
        if not texts or label.min() == label.max():
            self.constant = float(label.mean()) if texts else 0.5
            return self
        ptr, x = passage_features([utf8(t) for t in texts])
        self.mean = x.mean(axis=0)
        self.scale = (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), batch):
                rows = order[start:start + batch]
                take = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in rows])
                bounds = np.concatenate([[0], np.cumsum(ptr[rows + 1] - ptr[rows])])
                step += 1
                for k, g in self.gradients(x[take], bounds, label[rows]).items():
                    g = g + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * move).astype(np.float32)
        return self

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of label 1 of each whole text.  The attention's softmax
        is carried over the pieces of a long text, so memory stays bounded."""
        if self.constant is not None:
            return [self.constant] * len(texts)
        top = np.full(len(texts), -np.inf)
        total, bag = np.zeros(len(texts)), np.zeros((len(texts), len(self.p["b"])))

        def add(rows, blobs):
            ptr, x = passage_features(blobs)
            h, _, _, logit = self.encode(x.astype(float))
            size = np.diff(ptr)
            high = np.maximum(top[rows], np.maximum.reduceat(logit, ptr[:-1]))
            keep = np.exp(top[rows] - high)
            weight = np.exp(logit - np.repeat(high, size))
            total[rows] = total[rows] * keep + np.add.reduceat(weight, ptr[:-1])
            bag[rows] = bag[rows] * keep[:, None] + np.add.reduceat(weight[:, None] * h, ptr[:-1])
            top[rows] = high

        short = [i for i, t in enumerate(texts) if len(t) * 4 <= PIECE_BYTES]
        if short:
            add(np.array(short), [utf8(texts[i]) for i in short])
        for i in set(range(len(texts))) - set(short):
            for piece in pieces(texts[i]):
                add(np.array([i]), [piece])
        logit = (bag / total[:, None]) @ self.p["c"] + self.p["c0"] + self.shift
        # what is left of the order in which sums were taken is rounded away
        return [round(float(s), 9) for s in 1 / (1 + np.exp(-logit))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", docs_per_label: int = DOCS_PER_LABEL,
        max_train_chars: int = MAX_TRAIN_CHARS) -> AttentionNet:
    """Fit on about ``docs_per_label`` documents of either label.

    Null ids, labels other than 0 and 1 and ids with both labels are not
    learned from; of several rows under one id one text is taken (the
    smallest); a null text is an empty one.  With one label only, or none, all
    scores are that label's value, or 0.5.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
             .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
             .filter("label = most").select("id", "label"))
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20))
    wanted = F.lit(False)
    for label, n in size.items():
        wanted = wanted | ((F.col("label") == label) & (share < min(1 << 20, -(-(docs_per_label << 20) // n))))
    texts = docs.select(F.col(id_col).alias("id"),
                        F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, max_train_chars).alias("text"))
    # one row for each id taken, however many rows bear it
    sample = (texts.join(broadcast_bounded(known.filter(wanted)), "id").groupBy("id", "label")
              .agg(F.min("text").alias("text")).orderBy("label", "id").collect())
    net = AttentionNet().fit([r["text"] for r in sample], [r["label"] for r in sample])
    if len(size) == 2:
        net.shift = float(np.log(size[1] / size[0]))
    return net


def score(docs: DataFrame, net: AttentionNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, from its whole text alone.

    A null text counts as empty, and an empty text is one empty passage, so it
    gets a score too; equal texts get equal scores; rows with null or repeated
    ids keep their rows; an empty table gives none; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)  # some 5,000 weights

    def run(batches):
        for batch, texts in text_chunks(batches, "text", 1 << 18):
            got = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(got, pa.float64()),
                 pa.array([int(s >= KEEP_SCORE) for s in got], pa.int32())], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col))
