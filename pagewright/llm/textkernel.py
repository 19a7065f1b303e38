"""Array helpers that the Python operators share inside Spark tasks.

Texts of an Arrow batch are handled a bounded number of characters at a time;
words and word shingles get 64-bit hashes without creating Python objects.
A word is a run of ASCII letters and digits and of all non-ASCII characters,
after lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 1 << 20

_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True
_WORD[128:] = True

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the splitmix64 steps)."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(256, dtype=_U)) | _U(1)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:  # longer ones serve one huge text only
            _powers[base] = have
    return have[:n]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text",
                budget: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), about ``budget``
    bytes each; one longer text is a slice of its own.  Only a slice's texts
    are Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = end


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end) of ``buf``, equal for equal bytes."""
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_BYTE[buf] * _power(_P, len(buf)), out=total[1:])
    inverse = _power(_P_INV, len(buf) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, hashes): words ptr[i]:ptr[i+1] belong to text i."""
    blobs = [utf8(t.lower()) for t in texts]
    buf = np.frombuffer(b"\0".join(blobs) + b"\0", dtype=np.uint8)
    is_word = np.zeros(len(buf) + 1, dtype=np.int8)
    is_word[1:] = _WORD[buf]
    turn = np.diff(is_word)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    text_at = np.cumsum([0] + [len(b) + 1 for b in blobs])
    return np.searchsorted(starts, text_at), span_hashes(buf, starts, ends)


def shingle_hashes(ptr: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, hashes) of the runs of ``k`` words; a text of 1 to k-1 words has
    one shorter run, a text without words none."""
    count = np.diff(ptr)
    n_sh = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_ptr = np.concatenate([[0], np.cumsum(n_sh)])
    doc = np.repeat(np.arange(len(count)), n_sh)
    first = ptr[:-1][doc] + np.arange(out_ptr[-1]) - out_ptr[:-1][doc]
    end = ptr[1:][doc]
    padded = np.concatenate([words, np.zeros(k, dtype=_U)])
    acc = np.zeros(len(first), dtype=_U)
    for j in range(k):
        inside = first + j < end
        acc = acc * _U(0xD6E8FEB86659FD93) + np.where(inside, padded[first + j], _U(j + 1))
    return out_ptr, mix(acc)


def weighted(ptr: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, hashes, counts): each text's distinct hashes in rising order."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(doc)))
    out_ptr = np.searchsorted(doc[at], np.arange(len(ptr)))
    return out_ptr, hashes[at], counts


class KeyTable:
    """Distinct uint64 keys -> their positions, by open addressing on arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.rows = np.full(size, -1, dtype=np.int32)
        self.keys = np.zeros(size, dtype=_U)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(left), dtype=bool)
            put[first] = True
            put &= free
            self.rows[slot[put]] = left[put]
            self.keys[slot[put]] = keys[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        slot = self._slot(keys)
        rows = self.rows[slot]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            rows[open_] = self.rows[slot[open_]]
            at = slot[open_]
            open_ = open_[(rows[open_] >= 0) & (self.keys[at] != keys[open_])]
        return rows
