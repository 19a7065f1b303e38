"""License scan: fuzzy search for short license notices.

A notice of length L may differ from the text by up to k edits (k is a tenth
of L).  Split into k + 1 pieces, at least one piece of it must then stand in
the text unchanged (pigeonhole), so the pieces are exact seeds: one automaton
finds all of them in the whole text, each seed hit fixes a small window, and
the regex library's bounded-error matching verifies the window and reports the
span and the number of edits.

Texts are compared as words: A-Z in lower case, words of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, one space between words.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import text_chunks, utf8

# Base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices searched with bounded errors, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2", "apache"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version", "mpl"),
    ("eclipse public license version", "epl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def fold(text: str) -> bytes:
    """The text's words, lower case, with single spaces between them."""
    return b" ".join(utf8(text).translate(_FOLD).split())


def _edits(notice: str) -> int:
    return max(1, len(notice) // 10)


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def _within(notice: str, edits: int):
    """A test whether text[lo:hi] holds the notice with at most ``edits`` edits:
    one column of the edit distances at a time, kept as the bits of two integers
    (where a step goes up, where it goes down).  It spares near misses the
    search for a match."""
    size = len(notice)
    every, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = {}
    for j, c in enumerate(notice):
        where[c] = where.get(c, 0) | 1 << j

    def near(text: str, lo: int, hi: int) -> bool:
        up, down, distance = every, 0, size
        for c in text[lo:hi]:
            same = where.get(c, 0)
            keep = (((same & up) + up) ^ up) | same | down
            rise, fall = down | (every & ~(keep | up)), keep & up
            distance += bool(rise & top) - bool(fall & top)
            if distance <= edits:
                return True
            rise, fall = rise << 1 & every, fall << 1 & every
            up, down = fall | (every & ~(keep | rise)), rise & keep
        return False

    return near


def _fewest_edits(spans: list) -> list:
    """Spans without overlaps: fewest edits first, then the longest."""
    kept: list = []
    for s in sorted(spans, key=lambda x: (x[3], x[0] - x[1], x)):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return kept


class NoticeSearch:
    """Compiled notices: seed automaton and one bounded-error pattern each."""

    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES):
        self.notices = notices
        self.base = [(p.encode(), re.compile(rb"(?<![^ ])" + re.escape(p.encode()) + rb"(?![^ ])"), label)
                     for p, label in phrases]
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.patterns, self.near = [], []
        for i, (notice, _) in enumerate(notices):
            k = _edits(notice)
            self.patterns.append((k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            self.near.append(_within(notice, k))
            for offset, piece in seeds_of(notice, k):
                pieces.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def spans(self, folded: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) byte spans in the folded text; of spans
        that overlap the one with the fewest edits."""
        text = folded.decode("latin-1")  # one character for each byte
        # where a notice would start if it held this seed unedited
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(last - size + 1 - offset)
        out = set()
        for i, mine in starts.items():
            k, pattern = self.patterns[i]
            size = len(self.notices[i][0])
            group: list[int] = []
            for at in [*sorted(mine), None]:
                # seeds of one place shift each other's start by the edits between them
                if group and (at is None or at - group[-1] > k or at - group[0] > 2 * k):
                    lo, hi = max(0, group[0] - k), min(len(text), group[-1] + size + k)
                    if self.near[i](text, lo, hi) and (m := pattern.search(text, lo, hi)):
                        out.add((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                    group = []
                group.append(at)
        best: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, int, int, int]] = []  # spans that hang together
        reach = 0
        for s in sorted(out):
            if s[0] >= reach:
                best += _fewest_edits(group)
                group = []
            group.append(s)
            reach = max(reach, s[1])
        return sorted(best + _fewest_edits(group))

    def scan(self, text: str) -> dict:
        """Everything found in one whole text."""
        folded = fold(text)
        n_words = folded.count(b" ") + 1 if folded else 0
        places = []
        for phrase, pattern, label in self.base:
            if phrase in folded:
                places += [(m.start(), label) for m in pattern.finditer(folded)]
        spans = self.spans(folded)
        starts = None
        if places or spans:
            starts = [0] + [i + 1 for i, b in enumerate(folded) if b == 32]
        words = [bisect_right(starts, p) - 1 for p, _ in places]
        base = {label for _, label in places}
        score = 1.0 if places else 0.0
        found = []
        for start, end, i, edits in spans:
            notice, label = self.notices[i]
            likeness = 1.0 - edits / len(notice)
            score = max(score, likeness)
            found.append((bisect_right(starts, start) - 1, bisect_right(starts, max(start, end - 1)) - 1,
                          label, edits))
        return {"n_words": n_words, "n_base": len(places), "first_word": min(words, default=None),
                "last_word": max(words, default=None), "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | {x[2] for x in found})), "score": score,
                "spans": [dict(zip(("first", "last", "label", "edits"), x)) for x in found]}


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()),
                             ("edits", pa.int64())]))
_FIELDS = [("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"),
           ("first_word", pa.int64(), "bigint"), ("last_word", pa.int64(), "bigint"),
           ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
           ("score", pa.float64(), "double"),
           ("spans", _SPANS, "array<struct<first:bigint,last:bigint,label:string,edits:bigint>>")]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  notices=NOTICES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per input row: word and base phrase counts, labels, score and
    the fuzzy notice spans (first and last word, label, edits).

    A null or empty text has no words, no labels and score 0.  Repeated rows
    give repeated results.  The score is 1 for a base phrase, else the best
    notice's share of unedited characters.
    """
    ship_package(docs.sparkSession)
    notices, phrases = tuple(notices), tuple(phrases)

    def run(batches):
        search = NoticeSearch(notices, phrases)
        for batch, texts in text_chunks(batches):
            found = [search.scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([f[n] for f in found], t) for n, t, _ in _FIELDS],
                names=["id"] + [n for n, _, _ in _FIELDS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in _FIELDS)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
