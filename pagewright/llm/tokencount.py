"""Token counts by a linear longest-match automaton.

The vocabulary stands in a byte trie.  Greedy longest-match splitting restarts
after each piece; here every trie node has instead a failure link to the node
of the text left after the longest pieces have been popped, and the number of
pieces popped on the way.  Reading a word then never goes back, and its number
of tokens is the sum of those counts: no piece is built.

All single bytes belong to the vocabulary (byte fallback), so each word can be
split.  A word starts with the word mark of the vocabulary.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import text_chunks, utf8

WORD_MARK = "▁"
CACHE_WORDS = 1 << 18


def load_vocabulary(model_file: str) -> list[bytes]:
    """Ordinary pieces of a sentencepiece model as bytes (no control or byte
    pieces; the bytes themselves are added by the automaton)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class LongestMatch:
    """Trie with failure links and popped-token counts."""

    def __init__(self, pieces):
        self.go: list[dict[int, int]] = [{}]
        length, final = [0], [False]
        for piece in sorted({bytes([b]) for b in range(256)} | {p for p in pieces if p}):
            node = 0
            for b in piece:
                nxt = self.go[node].get(b)
                if nxt is None:
                    nxt = self.go[node][b] = len(self.go)
                    self.go.append({})
                    length.append(length[node] + 1)
                    final.append(False)
                node = nxt
            final[node] = True
        n = len(self.go)
        self.fail, self.pops = [0] * n, [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in self.go[node].items():
                queue.append(child)
                if final[child]:  # the whole path is a piece: pop it
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                # the path's last byte comes after what is left of the parent
                at, popped = self.fail[node], self.pops[node]
                while b not in self.go[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[child], self.pops[child] = self.go[at][b], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of ``word``."""
        go, fail, pops = self.go, self.fail, self.pops
        node = total = 0
        for b in word:
            nxt = go[node].get(b)
            while nxt is None:
                total += pops[node]
                node = fail[node]
                nxt = go[node].get(b)
            node = nxt
        while node:
            total += pops[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, pieces, id_col: str = "doc_id", text_col: str = "text",
                 mark: str = WORD_MARK) -> DataFrame:
    """(id, n_chars, n_words, n_tokens) of every row's whole text.

    Words are separated by white space; each is counted with ``mark`` before
    it.  A null or empty text has no tokens; repeated rows repeat.  ``pieces``
    is a vocabulary of fixed size and goes to the workers once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(list(pieces))  # a tokenizer's vocabulary

    def run(batches):
        automaton = LongestMatch(shared.value)
        known: dict[str, int] = {}
        head = mark.encode()
        for batch, texts in text_chunks(batches):
            chars, words, tokens = [], [], []
            for text in texts:
                parts = text.split()
                total = 0
                for w in parts:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(head + utf8(w))
                        if len(w) <= 64:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[w] = n
                    total += n
                chars.append(len(text))
                words.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(x, pa.int64()) for x in (chars, words, tokens)],
                names=["id", "n_chars", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_chars bigint, n_words bigint, n_tokens bigint")
            .withColumnRenamed("id", id_col))
