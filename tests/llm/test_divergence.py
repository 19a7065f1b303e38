"""Source divergence audit: against a plain computation, blocks, edges."""

import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import divergence
from pagewright.llm.divergence import audit_sources, level_products, term_counts
from odd_rows import nothing, odd  # noqa: F401

SF001 = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, top=10):
    """All result rows of (text, lang, source) rows."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        group = (lang or "", source or "")
        groups.add(group)
        count[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        tables = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        tables[None] = {t: sum(tables[s][t] for s in sources) for t in kept}
        p = {}
        for s, table in tables.items():
            total = sum(table.values()) + 2 * len(kept)
            p[s] = {t: 1 + 10 ** 9 * (n + 2) // total for t, n in table.items()}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o)
                     for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-((p[s][t] - p[None][t]) ** 2 // (p[s][t] + p[None][t])), t.encode(), t)
                     for t in kept if tables[s][t] > 0 and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_plain(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = audit_sources(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == plain([(r.text, r.lang, r.source) for r in docs.collect()])


def test_small_blocks_and_group_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", 3)
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i, j in product(range(8), range(6))]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 30)))), "xx", f"s{int(rng.integers(0, 11))}")
            for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(audit_sources(df, min_docs=5)) == plain(rows, 5)


def test_products_in_tiles(monkeypatch):
    """Tiles smaller than the columns change nothing."""
    rng = np.random.default_rng(4)
    rows = [("l", 0, 0, 0, 0, 0, f"s{s}", None, 0, 50 + s) for s in range(9)]
    rows += [("l", 0, 0, 0, 0, 0, f"s{s}", f"t{t}", n, 50 + s + 7 * n) for s in range(9) for t in range(40)
             if (n := int(rng.integers(0, 6)))]
    names = ["lang", "band", "block", "gi", "gj", "g", "source", "term", "n", "p"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    key = tuple(pa.scalar(x) for x in ("l", 0, 0, 0, 0))
    whole = level_products(key, table)
    assert whole.num_rows == 9 * 8
    monkeypatch.setattr(divergence, "TILE", 7)
    assert whole.equals(level_products(key, table))


def test_held_counts_are_given_out(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").coalesce(1)
    want = sorted(map(tuple, term_counts(docs).collect()))
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 50)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    assert want == sorted(map(tuple, divergence.term_counts(docs).collect()))


def test_odd_rows(spark, odd, nothing):
    got = rows_of(audit_sources(odd.drop("source").withColumn("source", F.lit("a")), min_docs=2))
    rows = [(r.text, "en", "a") for r in odd.collect()]
    assert got == plain(rows, 2)
    assert audit_sources(nothing.withColumn("source", F.lit(None).cast("string"))).count() == 0
    mixed = [("Ünïcode ÀÉ word", None, None), (None, None, "b"), ("", "en", None), ("word word", None, "b"),
             ("a\u0000b word", None, "c")] * 3
    df = spark.createDataFrame(mixed, "text string, lang string, source string")
    for c in ("term", "n", "p", "total", "v", "df", "lead", "item", "value", "rank"):
        df = df.withColumn(c, F.lit("x"))
    assert rows_of(audit_sources(df, min_docs=3)) == plain(mixed, 3)
