"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph (a line, cut further at sentence ends) has a 64-bit digest; the
n-th repetition of a paragraph within a text has a digest of its own.  Each
digest is added to three cells of a small table; a cell keeps the count, the
sum of digests and the sum of check hashes.  Subtracting two tables leaves the
differing digests only, and peeling cells that hold a single one recovers them
all; when peeling gets stuck the tables are built again with twice the cells.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import mix, span_hashes, utf8

CELLS = 24
HASHES = 3
_U = np.uint64
_SENTENCE = {ord("."), ord("!"), ord("?")}


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, digests) of the paragraphs of each text."""
    blobs = [utf8(t) for t in texts]
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    line = buf == 10
    stop = np.zeros(256, dtype=bool)
    stop[list(_SENTENCE)] = True
    blank = buf == 32
    # a paragraph ends at a line end, or at the blank after a sentence end
    end = line.copy()
    end[1:] |= blank[1:] & stop[buf[:-1]]
    ends = np.flatnonzero(end)
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = ends > starts
    starts, ends = starts[full], ends[full]
    text_at = np.cumsum([0] + [len(b) + 1 for b in blobs])
    ptr = np.searchsorted(starts, text_at)
    digests = span_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(ptr))
    order = np.lexsort((digests, doc))
    d, h = doc[order], digests[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    out = np.empty_like(h)
    out[order] = np.where(run > 0, mix(h + run.astype(_U) * _U(0xA24BAED4963EE407)), h)
    return ptr, out


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """Cells of each digest: one in every third of the table."""
    part = cells // HASHES
    return np.stack([(mix(digests ^ _U(77 + j)) % _U(part)).astype(np.int64) + j * part
                     for j in range(HASHES)], axis=1)


def _check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ _U(0x5851F42D4C957F2D)) >> _U(32)


def tables(ptr: np.ndarray, digests: np.ndarray, cells: int):
    """(count, digest sum, check sum) arrays of shape [texts, cells]."""
    n = len(ptr) - 1
    at = (np.repeat(np.arange(n), np.diff(ptr))[:, None] * cells + _places(digests, cells)).ravel()
    count = np.bincount(at, minlength=n * cells).astype(np.int64)
    sums = np.zeros(n * cells, dtype=_U)
    checks = np.zeros(n * cells, dtype=_U)
    np.add.at(sums, at, np.repeat(digests, HASHES))
    np.add.at(checks, at, np.repeat(_check(digests), HASHES))
    return [x.reshape(n, cells) for x in (count, sums, checks)]


def peel(a, b) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Subtract tables ``b`` from ``a`` and recover the differing digests of
    each text pair: (complete, digests only in a, digests only in b)."""
    n, cells = a[0].shape
    count, sums, checks = [(x - y).ravel() for x, y in zip(a, b)]
    only = {1: ([], []), -1: ([], [])}
    while True:
        moved = False
        for sign in (1, -1):
            at = np.flatnonzero(count == sign)
            key = sums[at] if sign > 0 else _U(0) - sums[at]
            good = (checks[at] if sign > 0 else _U(0) - checks[at]) == _check(key)
            doc, key = at[good] // cells, key[good]
            if not len(key):
                continue
            order = np.lexsort((key, doc))  # one digest may stand alone in several cells
            doc, key = doc[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            doc, key = doc[new], key[new]
            only[sign][0].append(doc)
            only[sign][1].append(key)
            cell = (doc[:, None] * cells + _places(key, cells)).ravel()
            three, three_checks = np.repeat(key, HASHES), np.repeat(_check(key), HASHES)
            np.add.at(count, cell, -sign)
            if sign > 0:
                np.subtract.at(sums, cell, three)
                np.subtract.at(checks, cell, three_checks)
            else:
                np.add.at(sums, cell, three)
                np.add.at(checks, cell, three_checks)
            moved = True
        if not moved:
            break
    complete = ~((count != 0) | (sums != 0) | (checks != 0)).reshape(n, cells).any(axis=1)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=_U)
    return complete, [cat(only[1][0]).astype(np.int64), cat(only[1][1])], \
        [cat(only[-1][0]).astype(np.int64), cat(only[-1][1])]


def _slice(ptr: np.ndarray, digests: np.ndarray, which: np.ndarray):
    size = np.diff(ptr)[which]
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(ptr[which] - out[:-1], size) + np.arange(out[-1])
    return out, digests[at]


def differences(a, b, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests only in a and only in b, for texts given as
    (ptr, digests); tables that cannot be peeled are built twice as large."""
    n = len(a[0]) - 1
    left = np.arange(n)
    only_a, only_b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    while len(left):
        complete, x, y = peel(tables(*_slice(*a, left), cells), tables(*_slice(*b, left), cells))
        ok = np.flatnonzero(complete)
        only_a[left[ok]] = np.bincount(x[0], minlength=len(left))[ok]
        only_b[left[ok]] = np.bincount(y[0], minlength=len(left))[ok]
        left = left[~complete]
        cells *= 2
    return only_a, only_b


def likeness(a, b, cells: int = CELLS) -> np.ndarray:
    """Shared share of the paragraphs of two texts (1 for two without any)."""
    only_a, only_b = differences(a, b, cells)
    size_a, size_b = np.diff(a[0]), np.diff(b[0])
    both = ((size_a - only_a) + (size_b - only_b)) / 2
    union = both + only_a + only_b
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def fingerprints(ptr: np.ndarray, digests: np.ndarray, cells: int = CELLS) -> list[str]:
    """Printable table of each text: counts, digest sums, check sums."""
    count, sums, checks = tables(ptr, digests, cells)
    raw = np.concatenate([count.astype("<u4").view(np.uint8), sums.astype("<u8").view(np.uint8),
                          (checks & _U(0xFFFFFFFF)).astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, n_paragraphs, fingerprint) of every row; null texts count as empty."""
    from .textkernel import text_chunks

    ship_package(docs.sparkSession)

    def run(batches):
        for batch, texts in text_chunks(batches):
            ptr, digests = paragraph_digests(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ptr)), pa.array(fingerprints(ptr, digests, cells))],
                names=["id", "n_paragraphs", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_paragraphs bigint, fingerprint string")
            .withColumnRenamed("id", id_col))


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of ``other``'s start."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of falling id and sorted, each range followed by
    the first row of the next one (``tail``; the last range by the first row of
    all), so that a task sees the successor of each of its rows.

    The ranges' bounds and first rows (their ids and hashes only) are gathered
    first; each text is shuffled once.  Null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    got = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).collect()
    cuts = np.array(sorted(set(got[0]["c"] or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = len(cuts) - np.searchsorted(cuts, ids.fillna(0).astype("int64").to_numpy(), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at).astype("int32"))

    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", range_of("id"))
    firsts = rows.groupBy("part").agg(F.max(F.struct("id", "h")).alias("k")).orderBy("part").collect()
    first = {r["part"]: (r["k"]["id"], r["k"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def tail_of(part: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        """The range that this row ends as its successor, -1 for most rows."""
        return pd.Series([first[p][2] if (None if pd.isna(i) else int(i), x) == first[p][:2] else -1
                          for p, i, x in zip(part, ids, h)], dtype="int32")

    here = F.struct(F.col("part"), F.lit(False).alias("tail"))
    there = F.struct(F.col("to").alias("part"), F.lit(True).alias("tail"))
    return (rows.withColumn("to", tail_of("part", "id", "h"))
            .withColumn("at", F.explode(F.when(F.col("to") < 0, F.array(here)).otherwise(F.array(here, there))))
            .select("id", "text", "h", "at.part", "at.tail")
            .repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc("id"), F.desc("h"))
            .select("id", "text", "part", "tail"))


_COLUMNS = ("id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, n_paragraphs bigint")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     cells: int = CELLS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last half
    replaced by the start of the next document in falling id order, after the
    last the first), and the likeness of the text to the edited one and to the
    next document, from the digests that subtracted tables give back.

    Null texts count as empty; a text without paragraphs is like another such
    text (1) and unlike all others (0).  Of equal ids the larger text hash
    comes first; a single row follows itself.
    """
    ship_package(docs.sparkSession)

    def result(rows):
        ids, texts, nexts = zip(*rows)
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        own, new, after = (paragraph_digests(list(x)) for x in (texts, changed, nexts))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(utf8(t)).hexdigest() for t in changed]),
            pa.array(fingerprints(*own, cells)), pa.array(fingerprints(*new, cells)),
            pa.array(likeness(own, new, cells)), pa.array(likeness(own, after, cells)),
            pa.array(np.diff(own[0]).astype(np.int64))],
            names=[c.split()[0] for c in _COLUMNS.split(", ")])

    def run(batches):
        held, ready, chars = None, [], 0
        for batch in batches:
            for i, text, part, tail in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held is not None and held[2] == part:
                    ready.append((held[0], held[1], text))
                    chars += len(held[1]) + len(text)
                held = None if tail else (i, text, part)
                if chars > 1 << 20:
                    yield result(ready)
                    ready, chars = [], 0
        if ready:
            yield result(ready)

    return _in_order(docs, id_col, text_col).mapInArrow(run, _COLUMNS).withColumnRenamed("id", id_col)
