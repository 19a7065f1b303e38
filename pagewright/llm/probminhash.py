"""Near duplicates by ProbMinHash over weighted word shingles.

Each shingle of a text (five words; weight 1 + ln of its count) runs a Poisson
process whose rate is its weight; every arrival falls on a random register,
which keeps its earliest arrival and the shingle that brought it.  A shingle
ends its process when the next arrival comes after the latest register, so
most end after one step.  Two registers agree with the probability Jaccard

    J_P(u, v) = sum over shared d of 1 / sum_d' max(u_d' / u_d, v_d' / v_d).

Registers are banded; texts that share a band are candidates and are verified
by the exact J_P of their whole texts.  Equal word sequences fall together
before banding.  Within a band, members are compared with a lead, the one that
shares bands with the most others, and with a second lead outside the largest
class then formed.  In bands that still hold several classes not all pairs are
tested; the pairs
that can reach the threshold t are found through their rarest shared shingle.
With s_u, s_v the shares of either text's weight that is shared,

    J_P <= 1 / (1/s_u + 1/s_v - 1),

so 1/s_u + 1/s_v <= 1 + 1/t, and neither text can have more than 1 - t of its
weight before the rarest shingle that both have.  Each text lists its rarest
shingles up to that weight; texts meet where a listed shingle is the same and
the weights before it leave the bound open.  Parities of hashed shingles
bound from below how many shingles two texts don't share, which by the same
bound rules out most pairs below t before any text is fetched.  All bounds are
exact and no group is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_path, ship_package
from pagewright.sources import folders

from .textkernel import mix, shingle_hashes, text_chunks, weighted, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability 3e-6
PARITY_BITS = 2048
RARITY_BUCKETS = 1 << 18
LIST_ROWS = 512  # of a shingle's list that one task compares with as many others at a time
_U = np.uint64


def weighted_shingles(texts: list[str], k: int = WORDS):
    """(ptr, hashes, weights) of the texts' distinct shingles."""
    ptr, hashes, counts = weighted(*shingle_hashes(*word_hashes(texts), k))
    return ptr, hashes, 1.0 + np.log(counts)


def signatures(ptr: np.ndarray, hashes: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """uint64 [texts, registers]: the shingle that won each register."""
    n = len(ptr) - 1
    doc = np.repeat(np.arange(n), np.diff(ptr))
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=_U)
    latest = np.full(n, np.inf)
    h, w, time, step = hashes, weights, np.zeros(len(hashes)), 0
    while len(h):
        draw = mix(h + _U(step * 0xD1342543DE82EF95 % (1 << 64)))
        time = time - np.log(((draw >> _U(11)) + _U(1)).astype(np.float64) * 2.0 ** -53) / w
        on = time < latest[doc]
        doc, h, w, time, draw = doc[on], h[on], w[on], time[on], draw[on]
        slot = doc * registers + (mix(draw) % _U(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = h[won]
        latest = first.reshape(n, registers).max(axis=1)
        on = time < latest[doc]
        doc, h, w, time = doc[on], h[on], w[on], time[on]
        step += 1
    return winner.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 [texts, bands]: one hash of each band's registers."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.tile(np.arange(bands, dtype=_U), (len(sig), 1))
    for r in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def marks(sig: np.ndarray) -> np.ndarray:
    """int64 [texts, registers / 16]: four bits of each register, sixteen registers a number."""
    n, registers = sig.shape
    nibbles = np.zeros((n, -(-registers // 16) * 16), dtype=_U)
    nibbles[:, :registers] = mix(sig) & _U(15)
    shift = (_U(4) * np.arange(16, dtype=_U))
    return np.bitwise_or.reduce(nibbles.reshape(n, -1, 16) << shift, axis=2).view(np.int64)


def probability_jaccard(ha, wa, hb, wb) -> float:
    """Exact J_P of two weighted sets (hashes rising)."""
    shared, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    u, v = wa[ia], wb[ib]
    only_u, only_v = wa.sum() - u.sum(), wb.sum() - v.sum()
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    above = np.cumsum(u[::-1])[::-1] + only_u  # those with at least this ratio count by u
    below = np.concatenate([[0.0], np.cumsum(v)[:-1]]) + only_v
    # equal ratios give the same value on either side
    return float((1.0 / (above / u + below / v)).sum())


def _fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, n, total, top, marks, bands): k1, k2 hash the word sequence
    (null: no words); n shingles weigh total, the heaviest top."""
    def run(batches):
        for batch, texts in text_chunks(batches, budget=1 << 19):
            wptr, words = word_hashes(texts)
            n_words = np.diff(wptr)
            keys = _word_keys(wptr, words)
            ptr, hashes, counts = weighted(*shingle_hashes(wptr, words, k))
            weights = 1.0 + np.log(counts)
            sig = signatures(ptr, hashes, weights, bands * rows)
            sums = np.concatenate([[0.0], np.cumsum(weights)])
            top = np.zeros(len(texts))
            np.maximum.at(top, np.repeat(np.arange(len(texts)), np.diff(ptr)), weights)
            found = band_keys(sig, bands, rows)
            none = n_words == 0
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]),
                                              pa.array(x.ravel())) for x in (marks(sig), found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, mask=none) for x in keys), pa.array(np.diff(ptr).astype(np.int64)),
                 pa.array(sums[ptr[1:]] - sums[ptr[:-1]]), pa.array(top), *lists],
                names=["id", "k1", "k2", "n", "total", "top", "marks", "bands"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(
        run, "id bigint, k1 bigint, k2 bigint, n bigint, total double, top double, "
             "marks array<bigint>, bands array<bigint>")


def _may_reach(x, y, threshold: float, registers: int):
    """False only if two texts' sizes rule out J_P >= threshold (each shared
    shingle adds at most its share of either text's weight), or if so few of
    their registers agree that a pair at the threshold falls below with a
    probability of 1e-7."""
    shared = F.least(x["n"], y["n"])
    fits = ((shared * x["top"] >= (threshold - 1e-9) * x["total"])
            & (shared * y["top"] >= (threshold - 1e-9) * y["total"]))
    differ = F.lit(0)
    for i in range(-(-registers // 16)):
        d = x["marks"][i].bitwiseXOR(y["marks"][i])
        for bits in (1, 2):  # a register differs if any of its four bits does
            d = d.bitwiseOR(F.shiftrightunsigned(d, bits))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return fits & (differ <= _most_differ(threshold, registers))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have J_P >= threshold."""
    def run(batches):
        for batch, left in text_chunks(batches, "ta", 1 << 19):
            n = len(left)
            ptr, h, w = weighted_shingles(left + batch.column("tb").to_pylist(), k)
            like = [probability_jaccard(h[ptr[i]:ptr[i + 1]], w[ptr[i]:ptr[i + 1]],
                                        h[ptr[n + i]:ptr[n + i + 1]], w[ptr[n + i]:ptr[n + i + 1]])
                    for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], names=["a", "b", "likeness"])

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, likeness double").filter(F.col("likeness") >= threshold)


_written: list[str] = []


def _saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and read again: cuts the lineage."""
    path = scratch_path(df.sparkSession, f"probminhash-{name}")
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _forget(spark, since: int) -> None:
    """Delete what has been written since, but for what the result still reads."""
    for path in _written[since:]:
        if not path.rsplit("/", 1)[-1].startswith(("probminhash-prints", "probminhash-keys")):
            folders.delete(spark, path)
    del _written[since:]


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node of ``links`` (a, b); the class is the
    smallest node of its component.

    Each round every node hooks onto its smallest smaller neighbour, pointers
    are shortened to their roots, and links are contracted to links between
    roots, until none is left.
    """
    both = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = _saved(both.select("node", F.col("node").alias("class")), "label")
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = _saved(edges.distinct(), "edges")
    while not edges.isEmpty():
        up = _saved(edges.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "node"), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = _saved(up.join(above, "up", "left")
                            .select("node", F.coalesce("top", "up").alias("up"),
                                    F.col("top").isNotNull().alias("moved")), "up")
            up = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        to = up.select(F.col("node").alias("class"), "up")
        label = _saved(label.join(to, "class", "left")
                       .select("node", F.coalesce("up", "class").alias("class")), "label")
        low = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        high = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(low, "a", "left").join(high, "b", "left").select(
            F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
        edges = _saved(edges.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct(), "edges")
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) of every row: documents of a class are connected by links
    of J_P >= ``threshold``; the class id is the smallest id in it.

    Rows under one id are one document: what links any of its texts links it.
    A text without words (null, empty) forms a class of its own; a text of
    fewer than ``words`` words has one shingle.  Repeated rows share a class.
    A row with a null id is compared with nothing and has a null class.  An
    empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    since = len(_written)
    prints = _saved(_fingerprint_rows(docs, id_col, text_col, words, bands, rows), "prints")
    known = prints.filter(F.col("k1").isNotNull() & F.col("id").isNotNull())
    first = _saved(known.groupBy("k1", "k2").agg(F.min_by(F.struct("id", "n", "total", "top", "marks", "bands"), "id").alias("f"))
                   .select("k1", "k2", "f.*"), "first")
    held = first.select(F.struct("id", "n", "total", "top", "marks").alias("doc"), F.posexplode("bands").alias("band", "key"))
    buckets = held.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = _saved(held.join(buckets, ["band", "key"]), "member")
    # a bucket's lead is its member that shares buckets with the most others
    degree = member.groupBy("doc.id").agg(F.sum("m").alias("degree"))
    member = member.withColumn("id", F.col("doc.id")).join(degree, "id").drop("id", "m")
    member = _saved(member, "member")
    leads = member.groupBy("band", "key").agg(F.max_by("doc", F.struct("degree", -F.col("doc.id"))).alias("lead"))
    same_id = known.groupBy("id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high")
    same_id = same_id.select("id").join(known, "id").join(first.select("k1", "k2", F.col("id").alias("b")), ["k1", "k2"])
    links = _saved(same_id.filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), "links")
    pairs = _saved(_lead_pairs(member.join(leads, ["band", "key"]), threshold, bands * rows), "pairs")
    classes = None
    if not member.isEmpty():
        texts = _texts_of(docs, member.select("doc.id").distinct(), first, id_col, text_col)
        links = links.unionByName(_saved(_verified(pairs, texts, words, threshold).select("a", "b"), "links"))
        classes = components(links)
        # once more in what is left, led by the first of the members outside the largest class
        more = _saved(_lead_pairs(_second_leads(_held(member, classes)), threshold, bands * rows)
                      .join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_saved(_verified(more, texts, words, threshold).select("a", "b"), "links"))
        pairs, classes = pairs.unionByName(more), components(links)
        more = _rare_pairs(_mixed(_held(member, classes)), texts, words, threshold, bands * rows)
        more = _saved(more.join(pairs, ["a", "b"], "left_anti"), "more")
        links = links.unionByName(_saved(_verified(more, texts, words, threshold).select("a", "b"), "links"))
        classes = components(links)
    elif not links.isEmpty():
        classes = components(links)
    keys = first.select("k1", "k2", F.col("id").alias("node"))
    if classes is not None:
        keys = keys.join(classes, "node", "left").select("k1", "k2", F.coalesce("class", "node").alias("node"))
    keys = _saved(keys, "keys")
    _forget(docs.sparkSession, since)
    found = prints.select("id", "k1", "k2").join(keys, ["k1", "k2"], "left")
    own = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("node", "id"))
    return found.select(F.col("id").alias(id_col), own.alias("class_id"))


def _word_keys(wptr: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's word sequence."""
    place = mix(np.arange(len(words), dtype=_U) - np.repeat(wptr[:-1], np.diff(wptr)).astype(_U))
    keys = []
    for salt in (1, 2):
        total = np.zeros(len(words) + 1, dtype=_U)
        np.cumsum(mix((words ^ _U(salt)) * (place | _U(1))), out=total[1:])
        keys.append((total[wptr[1:]] - total[wptr[:-1]]).view(np.int64))
    return keys


def _texts_of(docs: DataFrame, ids: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the word sequences that ``ids`` stand for in ``first``."""
    def run(batches):
        for batch, texts in text_chunks(batches, budget=1 << 19):
            k1, k2 = _word_keys(*word_hashes(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array(k1), pa.array(k2)],
                names=["id", "text", "k1", "k2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    keyed = rows.mapInArrow(run, "id bigint, text string, k1 bigint, k2 bigint")
    wanted = first.select("id", "k1", "k2")
    return _saved(keyed.join(wanted, ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"])
                  .select("id", "text"), "texts")


def _lead_pairs(led: DataFrame, threshold: float, registers: int) -> DataFrame:
    """(a, b): each lead with the members that it can reach the threshold with."""
    lead, doc = F.col("lead"), F.col("doc")
    near = led.filter((lead["id"] != doc["id"]) & _may_reach(lead, doc, threshold, registers))
    return near.select(F.least("lead.id", "doc.id").alias("a"), F.greatest("lead.id", "doc.id").alias("b")).distinct()


def _held(member: DataFrame, classes: DataFrame) -> DataFrame:
    """The members with their classes."""
    label = classes.withColumnRenamed("node", "id")
    held = member.withColumn("id", F.col("doc.id")).join(label, "id", "left")
    return _saved(held.withColumn("class", F.coalesce("class", "id")), "held")


def _second_leads(held: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with a lead of another
    class: that of the members outside the bucket's largest class."""
    count = held.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("m"))
    main = count.groupBy("band", "key").agg(F.max(F.struct("m", "class")).alias("main"),
                                            F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    inside = held.join(main.select("band", "key", F.col("main.class").alias("main")), ["band", "key"])
    leads = inside.filter("class <> main").groupBy("band", "key").agg(
        F.max_by(F.struct("doc", "class"), F.struct("degree", -F.col("id"))).alias("l"))
    led = inside.join(leads.select("band", "key", F.col("l.doc").alias("lead"), F.col("l.class").alias("own")), ["band", "key"])
    return led.filter("class <> own")


def _mixed(held: DataFrame) -> DataFrame:
    """(id, class) of the documents in bands that hold several classes."""
    mixed = held.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    inside = held.join(mixed.filter("low < high").select("band", "key"), ["band", "key"])
    return _saved(inside.groupBy("id").agg(F.min("class").alias("class")), "mixed")


def parity_bits(ptr: np.ndarray, hashes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """int64 [texts, bits / 64]: of each bit, whether an odd number of the
    text's shingles fall on it.  Two texts differ in at least as many shingles
    as bits."""
    out = np.zeros((len(ptr) - 1, bits // 64), dtype=np.int64)
    place = (mix(hashes ^ _U(0x5A5A5A5A5A5A5A5A)) % _U(bits)).astype(np.int64)
    for a in range(0, len(out), 512):
        b = min(a + 512, len(out))
        doc = np.repeat(np.arange(b - a), np.diff(ptr[a:b + 1]))
        count = np.bincount(doc * bits + place[ptr[a]:ptr[b]], minlength=(b - a) * bits)
        out[a:b] = np.packbits((count & 1).astype(np.uint8).reshape(b - a, bits), axis=1).view(np.int64)
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % _U(RARITY_BUCKETS)).astype(np.int64)


def _rarity(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles of all texts that fall on each of a fixed number of buckets.
    They order shingles from rare to frequent; any order finds the same pairs."""
    def run(batches):
        count = np.zeros(RARITY_BUCKETS, dtype=np.int64)
        for _, some in text_chunks(batches, "text", 1 << 19):
            count += np.bincount(_bucket(weighted_shingles(some, k)[1]), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])

    total = np.zeros(RARITY_BUCKETS, dtype=np.int64)
    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for part in counted.toArrow().to_batches():
        total[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return total


def rare_first(ptr: np.ndarray, hashes: np.ndarray, weights: np.ndarray, count: np.ndarray, threshold: float):
    """(ptr, hashes, before): each text's rarest shingles, as long as the share
    of its weight before them is at most 1 - threshold."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, count[_bucket(hashes)], doc))
    hashes, weights = hashes[order], weights[order]
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    total = (sums[ptr[1:]] - sums[ptr[:-1]])[doc]
    before = (sums[:-1] - sums[ptr[:-1]][doc]) / total
    on = before <= 1 - threshold + 1e-9
    return np.searchsorted(doc[on], np.arange(len(ptr))), hashes[on], before[on]


def _open(lost_x, lost_y, threshold: float):
    """Whether two texts that lack these shares of each other can reach the threshold."""
    left_x, left_y = 1 - lost_x, 1 - lost_y
    return (left_x > 0) & (left_y > 0) & (left_x + left_y <= (1 + 1 / threshold + 1e-9) * left_x * left_y)


def _rare_pairs(mixed: DataFrame, texts: DataFrame, k: int, threshold: float, registers: int) -> DataFrame:
    """(a, b): pairs of different classes that can reach the threshold."""
    some = _saved(texts.join(mixed.select("id"), "id", "left_semi"), "mixed-texts")
    shared = some.sparkSession.sparkContext.broadcast(_rarity(some, k))  # a fixed number of counts

    def lists_of(array):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(array) + 1, dtype=np.int32) * array.shape[1]),
                                        pa.array(array.ravel()))

    def run(batches):
        for batch, part in text_chunks(batches, "text", 1 << 19):
            ptr, h, w = weighted_shingles(part, k)
            at, rare, before = rare_first(ptr, h, w, shared.value, threshold)
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(rare.view(np.int64)), pa.array(before)], names=["h", "before"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), listed, pa.array(np.diff(ptr).astype(np.int64)),
                 pa.array(np.add.reduceat(w, ptr[:-1])), pa.array(np.maximum.reduceat(w, ptr[:-1])),
                 lists_of(marks(signatures(ptr, h, w, registers))), lists_of(parity_bits(ptr, h))],
                names=["id", "listed", "n", "total", "top", "marks", "bits"])

    kept = _saved(some.select("id", "text").mapInArrow(
        run, "id bigint, listed array<struct<h: bigint, before: double>>, n bigint, total double, top double, "
             "marks array<bigint>, bits array<bigint>"), "rare").withColumn("row", F.monotonically_increasing_id())
    kept = _saved(kept, "rare-rows")
    lists = (kept.select("row", "id", F.explode("listed").alias("l")).select("row", "id", "l.*")
             .join(mixed.select("id", "class"), "id"))
    # in a list, the pairs of its largest class with itself need no comparison
    count = lists.groupBy("h", "class").agg(F.count(F.lit(1)).alias("m"))
    meet = count.groupBy("h").agg(F.max(F.struct("m", "class")).alias("main"), F.sum("m").alias("m"),
                                  F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    meet = meet.select("h", F.col("main.class").alias("main"), F.ceil(F.col("m") / LIST_ROWS).cast("int").alias("n_all"),
                       F.ceil((F.col("m") - F.col("main.m")) / LIST_ROWS).cast("int").alias("n_rest"))
    lists = _saved(lists.select("row", "class", "h", "before").join(meet, "h"), "lists")
    full = lists.join(kept.drop("listed"), "row")
    doc = F.struct("id", "class", (F.col("class") == F.col("main")).alias("in_main"), "before", "n", "total", "top",
                   "marks", "bits")
    # a long list lies in blocks, and every pair of blocks is compared on its own
    x = full.filter("class <> main").select(
        "h", F.pmod(F.xxhash64("row"), F.col("n_rest")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), doc.alias("x"))
    y = full.select("h", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("i"),
                    F.pmod(F.xxhash64("row"), F.col("n_all")).cast("int").alias("j"), doc.alias("y"))
    fx, fy = F.col("x"), F.col("y")
    apart = F.aggregate(F.zip_with(fx["bits"], fy["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                        lambda n, more: n + more)
    # at least so many shingles of either text are not in the other; each weighs 1 or more
    lost_x = F.greatest(F.lit(0), apart + fx["n"] - fy["n"]) / 2 / fx["total"]
    lost_y = F.greatest(F.lit(0), apart + fy["n"] - fx["n"]) / 2 / fy["total"]
    can = ((fy["in_main"] | (fx["id"] < fy["id"])) & (fx["class"] != fy["class"])
           & _open(fx["before"], fy["before"], threshold)
           & _open(lost_x, lost_y, threshold) & _may_reach(fx, fy, threshold, registers))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("h", "i", "j")]
    met = x.alias("l").join(y.alias("r"), [*same, can])
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _most_differ(threshold: float, registers: int) -> int:
    agree = threshold + (1 - threshold) / 16  # four bits may agree by chance
    return int(registers * (1 - agree) + 5.2 * (registers * agree * (1 - agree)) ** 0.5)
