"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of L words is compared with the windows of L words of every
document.  Windows and items have a 64-bit SimHash of their weighted five-word
shingles.  A multi-index finds all items within ``RADIUS`` bits of a window:
the 64 bits are cut into four blocks, and a fingerprint within the radius must
agree with the window's in one block up to ``RADIUS // 4`` bits, so each item
stands in a block's table under every value that near.  Candidates are then
verified by the exact weighted Jaccard of their shingle counts.

A window whose shingles occur in items of that size less often than the
threshold asks for cannot pass, so no SimHash is built for it; that bound loses
nothing.  The benchmark is taken in blocks of bounded size, each sent to the
workers once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import KeyTable, shingle_hashes, text_chunks, word_hashes

WORDS = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCK_ITEMS, BLOCK_CHARS = 1000, 4_000_000
SEGMENT = 1 << 16
_U = np.uint64
_PARTS, _PART_BITS = 4, 16


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(hashes: np.ndarray) -> int:
    """SimHash of a bag of shingles (a repeated one weighs more)."""
    return int(_pack(_signs(hashes).sum(axis=0, keepdims=True))[0])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two bags."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(at[:len(a)], minlength=len(both)), np.bincount(at[len(a):], minlength=len(both))
    return float(np.minimum(ca, cb).sum() / max(1, np.maximum(ca, cb).sum()))


class MultiIndex:
    """All fingerprints within ``radius`` bits of a query."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        masks = [sum(1 << b for b in c) for r in range(radius // _PARTS + 1)
                 for c in combinations(range(_PART_BITS), r)]
        masks = np.array(masks, dtype=np.int64)
        self.blocks = []
        for p in range(_PARTS):
            key = self._part(prints, p)[:, None] ^ masks[None, :]
            order = np.argsort(key.ravel(), kind="stable")
            item = (order // len(masks)).astype(np.int32)
            start = np.searchsorted(key.ravel()[order], np.arange((1 << _PART_BITS) + 1))
            self.blocks.append((start, item))

    @staticmethod
    def _part(prints: np.ndarray, p: int) -> np.ndarray:
        return ((prints >> _U(_PART_BITS * p)) & _U((1 << _PART_BITS) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) index pairs, each once."""
        qs, items = [], []
        for p, (start, item) in enumerate(self.blocks):
            key = self._part(queries, p)
            size = start[key + 1] - start[key]
            q = np.repeat(np.arange(len(queries)), size)
            at = np.repeat(start[key] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            qs.append(q)
            items.append(item[at])
        pair = np.unique(np.concatenate(qs).astype(np.int64) * len(self.prints) + np.concatenate(items))
        q, i = pair // len(self.prints), pair % len(self.prints)
        ok = np.bitwise_count(queries[q] ^ self.prints[i]) <= self.radius
        return q[ok], i[ok]


class ItemIndex:
    """Items of one benchmark block whose shingles have ``k`` words."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float, radius: int):
        ptr, hashes = shingle_hashes(*word_hashes([t for _, t in items]), k)
        self.k, self.threshold, self.ids = k, threshold, [i for i, _ in items]
        self.bags = [hashes[a:b] for a, b in zip(ptr, ptr[1:])]
        self.size = np.diff(ptr)
        self.sizes = np.unique(self.size)
        self.index = MultiIndex(np.array([simhash(b) for b in self.bags], dtype=_U), radius)
        known = np.unique(hashes)
        self.seeds = KeyTable(known)
        self.in_size = np.zeros((len(known), len(self.sizes)), dtype=bool)
        item_of = np.repeat(np.arange(len(self.bags)), self.size)
        self.in_size[np.searchsorted(known, hashes), np.searchsorted(self.sizes, self.size[item_of])] = True
        self.needed = np.ceil(self.sizes * threshold - 1e-9).astype(np.int64)

    def search(self, ptr: np.ndarray, words: np.ndarray) -> list[dict[int, tuple[float, int]]]:
        """For each text {item: (similarity, first word)} of its best windows."""
        sptr, hashes = shingle_hashes(ptr, words, self.k)
        row = self.seeds.find(hashes)
        seeds = np.concatenate([[0], np.cumsum(row >= 0)])
        enough = seeds[sptr[1:]] - seeds[sptr[:-1]] >= max(1, self.needed.min(initial=1))
        out: list[dict] = [{} for _ in range(len(ptr) - 1)]
        longest = int(self.sizes.max(initial=0))
        for d in np.flatnonzero(enough):
            a, z = sptr[d], sptr[d + 1]
            for at in range(a, z, SEGMENT):  # segments overlap by the longest window
                end = min(z, at + SEGMENT + longest)
                if at > a and end - at <= longest:
                    break
                if seeds[end] > seeds[at]:
                    self._one(hashes[at:end], row[at:end], int(at - a), out[d])
        return out

    def _one(self, hashes: np.ndarray, row: np.ndarray, shift: int, found: dict) -> None:
        flags = np.zeros((len(row) + 1, len(self.sizes)), dtype=np.int32)
        flags[1:][row >= 0] = self.in_size[row[row >= 0]]
        np.cumsum(flags, axis=0, out=flags)
        first, length = [], []
        for s in np.flatnonzero(flags[-1] >= self.needed):
            n = min(int(self.sizes[s]), len(row))
            at = np.flatnonzero(flags[n:, s] - flags[:len(row) - n + 1, s] >= self.needed[s])
            first.append(at)
            length.append(np.stack([np.full(len(at), n), np.full(len(at), self.sizes[s])]))
        if not first:
            return
        first, length = np.concatenate(first), np.concatenate(length, axis=1)
        lo = int(first.min(initial=0))
        hi = int((first + length[0]).max(initial=0))
        total = np.zeros((hi - lo + 1, 64), dtype=np.int32)
        np.cumsum(_signs(hashes[lo:hi]), axis=0, out=total[1:])
        for a in range(0, len(first), 4096):
            f, (n, size) = first[a:a + 4096], length[:, a:a + 4096]
            q, i = self.index.near(_pack(total[f + n - lo] - total[f - lo]))
            same = self.size[i] == size[q]
            for w, item in zip(q[same], i[same]):
                like = weighted_jaccard(hashes[f[w]:f[w] + n[w]], self.bags[item])
                if like >= self.threshold and like > found.get(self.ids[item], (0.0,))[0]:
                    found[self.ids[item]] = (like, int(f[w]) + shift)


def _blocks(items: DataFrame) -> list:
    """Row filters that cut the distinct items into blocks of bounded size."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item")).alias("c")).collect()[0]
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["c"] or 0) // BLOCK_CHARS))
    return [F.pmod(F.xxhash64("item"), F.lit(n)) == b for b in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS,
               threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, similarity, first_word) of the items whose best window in
    a row's whole text reaches ``threshold``.

    Null texts and texts without words match nothing; an item of fewer than
    ``words`` words is one shingle of its length; a text shorter than the item
    is one window.  Items of equal text are one item, reported under its
    smallest id; an item without id or text is none.  Repeated rows are
    reported each; hits carry the row's id, so where ids may be null or shared,
    number the rows (``rows.numbered``) and pass the number as id.  An empty
    benchmark gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item"))
    items = items.filter(F.col("item_id").isNotNull() & F.col("item").isNotNull())
    items = items.groupBy("item").agg(F.min("item_id").alias("item_id"))
    schema = f"id {kind}, item_id bigint, similarity double, first_word bigint"
    found = None
    for block in _blocks(items):
        texts = [(r["item_id"], r["item"]) for r in items.filter(block).orderBy("item_id", "item").collect()]
        shared = spark.sparkContext.broadcast(texts)  # at most about BLOCK_ITEMS texts

        def run(batches, shared=shared):
            ptr, _ = word_hashes([t for _, t in shared.value])
            by_k: dict[int, list] = {}
            for item, n in zip(shared.value, np.diff(ptr)):
                if n:
                    by_k.setdefault(min(words, int(n)), []).append(item)
            indexes = [ItemIndex(x, k, threshold, radius) for k, x in sorted(by_k.items())]
            for batch, texts in text_chunks(batches):
                wptr, hashes = word_hashes(texts)
                out = []
                for index in indexes:
                    for d, hits in enumerate(index.search(wptr, hashes)):
                        out += [(d, i, s, f) for i, (s, f) in hits.items()]
                if out:
                    d, i, s, f = zip(*sorted(out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s, pa.float64()),
                         pa.array(f, pa.int64())], names=["id", "item_id", "similarity", "first_word"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)


def report(rows: DataFrame, leaks: DataFrame, id_col: str = "doc_id", row_col: str = "row") -> DataFrame:
    """One row per numbered row: its id, number of items, their ids, the highest
    similarity (0 without any).  ``leaks`` carries row numbers."""
    per = leaks.groupBy(F.col(row_col).alias("leak")).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("top"))
    return (rows.select(id_col, row_col).join(per, F.col(row_col) == F.col("leak"), "left")
            .select(id_col, F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
                    F.coalesce("top", F.lit(0.0)).alias("similarity")))
