"""Hierarchical multi-length packing of documents into training sequences.

Token streams are routed to context-size tiers (powers of two).  Whole windows
of the longest tier are cut off first; the rest of a document waits in the
smallest tier that holds it.  Each tier is packed from the longest down: a
waiting piece opens a window, and its gap is filled from the shorter tiers,
best fit first, the last filler being cut.  Completed sequences have exactly
their tier's size, so nothing is padded; what is left at the end of a task is
cut into sequences of power-of-two sizes.  Sequences are dealt into step
groups of equal token sums.

A task packs what it reads, window after window, and keeps only the pieces
that still wait, so memory does not grow with the input and nothing is
shuffled.  Sequence ids hold the task's partition, so a task that is run again
gives the same ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_right, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import text_chunks

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
END_ID = 2
CACHE_WORDS = 1 << 19
# ASCII punctuation.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# A capital that stays apart from the mark after it, where the small letter might not.
_MARKED = re.compile("[A-Z][\u0300-\u036f]")


def _stays(c: str) -> bool:
    """Whether a letter or digit is letters or digits too after the
    tokenizer's normalisation (NFC, then lower case)."""
    return c.isalnum() and unicodedata.normalize("NFC", c).lower().isalnum()


# Letters and digits of Latin, Greek and Cyrillic script that stay such; other
# characters are left to the tokenizer together with what stands around them.
_PLAIN = frozenset(c for c in map(chr, [*range(0x30, 0x250), *range(0x370, 0x530)]) if _stays(c))
# An ASCII punctuation character right after one of them.
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~](?<=[" + "".join(sorted(_PLAIN)) + r"].)", re.S)


class WordIds:
    """Token ids of whole texts under a tokenizer that lower-cases, splits at
    white space and between letters and punctuation, and closes every word by
    a token that ends in ``</w>``.

    Each part between blanks is encoded once and kept: plain words are encoded
    together and cut after their closing tokens, punctuation around a word is
    taken off first.  Parts that hold anything else, and texts that may hold a
    special token, go to the tokenizer as they are.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Encode words of letters, many in one call."""
        for a in range(0, len(words), 4096):
            some = words[a:a + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                raw, at = ids.tobytes(), 0
                for w, end in zip(some, (4 * ends).tolist()):
                    self.known[w] = raw[at:end]
                    at = end
            else:
                self.known.update(zip(some, self._encode(some)))

    def _learn(self, new: set[str]) -> None:
        words = {p for p in new if p.isalpha() and _PLAIN.issuperset(p)}
        split, whole = [], set()
        for part in new - words:
            body = part.strip(_MARKS)
            if body.isalpha() and _PLAIN.issuperset(body) and "<|" not in part:
                at = part.index(body)
                head, tail = part[:at], part[at + len(body):]
                if not head.endswith("'"):  # with the letter after it that may be one token
                    split.append((part, head, body, tail))
                    words.add(body)
                    whole.update(x for x in (head, tail) if x)
                    continue
            whole.add(part)
        known = self.known
        whole = [x for x in whole if x not in known]
        known.update(zip(whole, self._encode(whole)))
        self._words([w for w in words if w not in known])
        for part, head, body, tail in split:
            known[part] = known.get(head, b"") + known[body] + known.get(tail, b"")

    @staticmethod
    def _parts(text: str) -> list[str]:
        if "<|" not in text:  # A-Z in lower case, a gap before punctuation after a letter or digit
            if text.isascii() or not _MARKED.search(text):
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            text = _PUNCTUATION.sub(r" \g<0>", text)
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def __call__(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        """Little-endian uint32 ids of each text, then ``end_id``."""
        parts = [self._parts(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        known[""] = b""
        new = set().union(*parts).difference(known)
        if new:
            self._learn(new)
        end = np.array([end_id], dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, p)) + end for p in parts]


_ready: dict[str, WordIds] = {}


def word_ids(tokenizer_file: str) -> WordIds:
    """The tokenizer of this Python process, with the words that it has met."""
    if tokenizer_file not in _ready:
        _ready[tokenizer_file] = WordIds(tokenizer_file)
    return _ready[tokenizer_file]


class Piece:
    __slots__ = ("doc", "ids", "start", "length", "total")

    def __init__(self, doc, ids: bytes, start: int, length: int, total: int):
        self.doc, self.ids, self.start, self.length, self.total = doc, ids, start, length, total

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.ids[:4 * n], self.start, n, self.total),
                Piece(self.doc, self.ids[4 * n:], self.start + n, self.length - n, self.total))


class Packer:
    """Packs the documents of one task.  ``take`` returns completed sequences,
    ``rest`` cuts up what still waits."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.pool: list[tuple[int, int, Piece]] = []  # waiting, by length
        self.serial = self.held = 0  # held: their tokens

    def _wait(self, piece: Piece) -> None:
        if piece.length:
            insort(self.pool, (piece.length, self.serial, piece))
            self.serial += 1
            self.held += piece.length

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def take(self, docs: list[tuple[object, bytes]]) -> list[list[Piece]]:
        done, top = [], self.tiers[-1]
        for doc, ids in docs:
            piece = Piece(doc, ids, 0, len(ids) // 4, len(ids) // 4)
            while piece.length >= top:
                whole, piece = piece.cut(top)
                done.append([whole])
            self._wait(piece)
        while self.pool:
            length, _, piece = self.pool[-1]
            size = self._tier(length)
            if self.held < size:
                break  # not enough waits to fill this window: the next documents will
            self.pool.pop()
            self.held -= length
            window, gap = [piece], size - length
            while gap:
                at = bisect_right(self.pool, gap, key=lambda x: x[0]) - 1
                if at >= 0:
                    n, _, filler = self.pool.pop(at)
                    self.held -= n
                else:
                    n, _, first = self.pool.pop(0)
                    self.held -= n
                    filler, left = first.cut(gap)
                    self._wait(left)
                window.append(filler)
                gap -= filler.length
            done.append(window)
        return done

    def rest(self) -> list[list[Piece]]:
        """Sequences of falling powers of two that hold all that waits."""
        pieces = [x[2] for x in reversed(self.pool)]
        self.pool, self.held, done = [], 0, []
        left = sum(p.length for p in pieces)
        while left:
            gap = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= gap
            window = []
            while gap:
                piece = pieces.pop(0)
                if piece.length > gap:
                    piece, after = piece.cut(gap)
                    pieces.insert(0, after)
                window.append(piece)
                gap -= piece.length
            done.append(window)
        return done


class StepGroups:
    """Deals sequences into groups of ``budget`` tokens each: the longest that
    still fits comes next, others wait for the following group."""

    def __init__(self, budget: int = STEP_TOKENS):
        self.budget, self.left, self.group = budget, budget, 0
        self.waiting: list[tuple[int, int, list[Piece]]] = []
        self.serial = 0

    def deal(self, sequences: list[list[Piece]], last: bool = False) -> list[tuple[int, list[Piece]]]:
        for s in sequences:
            insort(self.waiting, (sum(p.length for p in s), self.serial, s))
            self.serial += 1
        out = []
        while self.waiting:
            at = bisect_right(self.waiting, self.left, key=lambda x: x[0]) - 1
            if at < 0:
                if not last:
                    break
                self.group, self.left = self.group + 1, self.budget
                at = len(self.waiting) - 1
            size, _, s = self.waiting.pop(at)
            out.append((self.group, s))
            self.left -= size
            if self.left <= 0:
                self.group, self.left = self.group + 1, self.budget
        return out


_FIELDS = [("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"),
           ("sequence_id", "bigint"), ("offset", "bigint"), ("tier", "bigint"), ("step_group", "bigint")]


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
         tiers=TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (tokens of its sequence) and step_group.

    Every document, also one with a null or empty text (it has the end id
    only), lies in the pieces exactly once; repeated rows are packed each for
    itself.  An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    tiers = tuple(tiers)

    def run(batches):
        from pyspark import TaskContext

        first_id = TaskContext.get().partitionId() << 40
        words, packer, steps = word_ids(tokenizer_file), Packer(tiers), StepGroups(step_tokens)
        serial = 0
        id_type = None

        def rows(dealt):
            nonlocal serial
            ids, numbers = [], []
            for group, window in dealt:
                offset, size = 0, sum([p.length for p in window])
                for p in window:
                    ids.append(p.doc)
                    numbers += (p.start, p.length, crc32(p.ids), p.total, first_id + serial, offset, size,
                                first_id + group)
                    offset += p.length
                serial += 1
            table = np.array(numbers, dtype=np.int64).reshape(-1, len(_FIELDS)).T.copy()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, table)],
                                              names=["id", *[n for n, _ in _FIELDS]])

        for batch, texts in text_chunks(batches):
            id_type = batch.column(0).type
            ids = words(texts, end_id)
            yield rows(steps.deal(packer.take(list(zip(batch.column(0).to_pylist(), ids)))))
        if id_type is not None:
            yield rows(steps.deal(packer.rest(), last=True))

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in _FIELDS)
    return rows_in.mapInArrow(run, schema).withColumnRenamed("id", id_col)
