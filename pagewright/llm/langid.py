"""Language identification by prediction by partial matching (PPM).

One byte context tree per language holds the counts of every context of up to
``ORDER`` bytes.  A symbol seen after a context costs -log2(c / (n + q)) bits
(c its count, n all symbols, q distinct symbols there); an unseen one costs the
escape -log2(q / (n + q)) and is coded after the next shorter context, at last
with eight bits.  The statistics are frozen: a text's code length under each
tree is exact and depends on that text only, and the shortest wins.

The trees are fitted on a bounded sample: for each of the ``max_langs`` most
frequent labels about ``docs_per_lang`` distinct labelled texts, taken by a hash
of id and text, of each the first ``max_train_chars`` characters.  Prediction
covers every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import ship_package

from .textkernel import KeyTable, text_chunks, utf8

ORDER = 4
DOCS_PER_LANG = 400
MAX_TRAIN_CHARS = 20_000
MAX_LANGS = 64
UNKNOWN = "und"

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1, dtype=np.uint8)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, bytes): lower case; each run of ASCII non-letters is one space,
    and every text begins and ends with one."""
    blobs = [utf8(t.lower()) for t in texts]
    buf = _FOLD[np.frombuffer(b"\0" + b"\0\0".join(blobs) + b"\0", dtype=np.uint8)]
    ends = np.cumsum([len(b) + 2 for b in blobs])
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    keep[np.concatenate([[0], ends[:-1]])] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[np.concatenate([[0], ends])], buf[keep]


def _grams(ptr: np.ndarray, buf: np.ndarray, order: int) -> list[np.ndarray]:
    """For m = 1 .. order+1 the last m bytes at each place; places before a
    text's start count as zero bytes."""
    at = np.arange(len(buf)) - np.repeat(ptr[:-1], np.diff(ptr))
    key, out = np.zeros(len(buf), dtype=_U), []
    for back in range(order + 1):
        b = np.zeros(len(buf), dtype=_U)
        b[back:] = buf[:len(buf) - back]
        b[at < back] = 0
        key = key | (b << _U(8 * back))
        out.append(key)
    return out


class ContextTrees:
    """Frozen statistics of all languages: for each gram length a table of the
    grams seen, with every language's cost of the gram's last byte and its cost
    of escaping from the gram taken as a context."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        n_lang = len(self.langs)
        seen = [[] for _ in range(order + 1)]
        for lang in self.langs:
            for m, keys in enumerate(_grams(*_letters(samples[lang]), order)):
                seen[m].append(np.unique(keys, return_counts=True))
        self.tables, self.cost, self.esc = [], [], []
        for m in range(order + 1 if samples else 0):
            union = np.unique(np.concatenate([k for k, _ in seen[m]]))
            count = np.zeros((len(union), n_lang))
            for j, (k, c) in enumerate(seen[m]):
                count[np.searchsorted(union, k), j] = c
            # the context of a gram is the gram without its last byte
            context, ctx_of = np.unique(union >> _U(8), return_inverse=True)
            n = np.zeros((len(context), n_lang))
            q = np.zeros((len(context), n_lang))
            np.add.at(n, ctx_of, count)
            np.add.at(q, ctx_of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(q > 0, -np.log2(q / (n + q)), 0.0)
                own = -np.log2(count / (n + q)[ctx_of])
            if m == 0:
                self.empty_escape = escape[0]
                shorter = np.full((len(union), n_lang), 8.0)
            else:
                shorter = self.cost[m - 1][self.tables[m - 1].find(union & _U((1 << 8 * m) - 1))]
                row = self.tables[m - 1].find(context)
                have = row >= 0
                self.esc[m - 1][row[have]] = escape[have]
            self.cost.append(np.where(count > 0, own, escape[ctx_of] + shorter).astype(np.float32))
            self.esc.append(np.zeros((len(union), n_lang), dtype=np.float32))
            self.tables.append(KeyTable(union))

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits[text, language], bytes[text]) of whole texts."""
        ptr, buf = _letters(texts)
        grams = _grams(ptr, buf, self.order)
        bits = np.zeros((len(buf), len(self.langs)), dtype=np.float32)
        left = np.arange(len(buf))
        for m in range(self.order, -1, -1):
            row = self.tables[m].find(grams[m][left])
            hit = row >= 0
            bits[left[hit]] += self.cost[m][row[hit]]
            left = left[~hit]
            if not len(left):
                break
            if m:
                ctx = self.tables[m - 1].find(grams[m][left] >> _U(8))
                known = ctx >= 0
                bits[left[known]] += self.esc[m - 1][ctx[known]]
            else:
                bits[left] += (self.empty_escape + 8.0).astype(np.float32)
        return np.add.reduceat(bits.astype(np.float64), ptr[:-1], axis=0), np.diff(ptr)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text.  The score is the winner's share
        when code lengths are compared over at most 64 bytes."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits, size = self.code_lengths(texts)
        gap = (bits - bits.min(axis=1, keepdims=True)) / size[:, None] * np.minimum(size, 64)[:, None]
        best = bits.argmin(axis=1)
        score = 1.0 / np.exp2(-gap).sum(axis=1)
        letter = [any(map(str.isalpha, t)) for t in texts]
        return ([self.langs[b] if a else UNKNOWN for a, b in zip(letter, best)],
                [float(s) if a else 0.0 for a, s in zip(letter, score)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG, max_train_chars: int = MAX_TRAIN_CHARS,
        max_langs: int = MAX_LANGS, order: int = ORDER) -> ContextTrees:
    """Fit the context trees on a bounded sample of labelled rows.

    Rows with a null id, text or language are not used.  Without any usable
    row the model has no language and predicts ``und`` everywhere.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = rows.withColumn("text", F.substring("text", 1, max_train_chars)).filter(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = (usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_langs).collect())
    wanted = F.lit(False)
    share = F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(1 << 20))
    for r in counts:
        limit = min(1 << 20, -(-(docs_per_lang << 20) // r["n"]))
        wanted = wanted | ((F.col("lang") == r["lang"]) & (share < limit))
    sample: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    if counts:
        # about docs_per_lang texts of each language, whatever the input size
        for r in usable.filter(wanted).distinct().orderBy("lang", "id", F.xxhash64("text")).collect():
            sample[r["lang"]].append(r["text"])
    return ContextTrees({k: v for k, v in sample.items() if v}, order)


def identify(docs: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, lang_pred, score) of every row, from its whole
    text alone.

    A null text and a text without any letter give ``und`` with score 0;
    repeated rows give repeated results.  ``carry`` names further columns to
    keep (they go along unread).
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    kept = [f"kept_{i}" for i in range(len(carry))]

    def run(batches):
        trees = shared.value
        for batch, texts in text_chunks(batches, "text_in", 1 << 18):
            lang, score = trees.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ["id", *kept]]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["id", *kept, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_in"),
                       *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ["id", *kept])
    found = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return found.toDF(id_col, *carry, "lang_pred", "score")
