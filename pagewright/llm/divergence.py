"""Divergence of sources from each other and from their language.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents.  With
``n`` occurrences of a term in a group of ``total`` kept occurrences over a
vocabulary of ``v`` terms the share is p = 1 + floor(10^9 (n + 2) / (total + 2v))
and two shares are priced f = floor((p - q)^2 / (p + q)).

Two groups are compared by one-hot level products.  A block of kept terms
becomes a 0/1 matrix with one row for each term and one column for each
(group, count level), count 0 included.  The product of its transpose with
itself holds, for every two groups, the joint table of their levels: how many
terms have level u in the one and level v in the other.  Each cell is priced
once and the prices, weighted by the cells, add up over the blocks.  Matrix
entries are counts of at most a block's terms, so float32 products are exact,
and all prices are integers.

Terms are dealt to blocks by the magnitude of their counts, so terms of a block
share levels, and by a hash; groups of a language with many sources are dealt
to blocks too, and every pair of group blocks is a task of its own.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.joins import broadcast_bounded
from pagewright.session import scratch_path, ship_package

MIN_DOCS = 10
TOP_TERMS = 10
BLOCK_TERMS = 256
BLOCK_GROUPS = 64
TILE = 2048
HELD_ENTRIES = 300_000
PIECE_BYTES = 1 << 22

# bytes of terms: ASCII letters, lower-cased, and all of non-ASCII characters
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: str):
    """Lists of a text's terms (as bytes), a bounded number of bytes at a time."""
    blob = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    start = 0
    while start < len(blob):
        end = blob.find(b" ", start + PIECE_BYTES)
        end = len(blob) if end < 0 else end
        yield blob[start:end].split()
        start = end


def _count_terms(batches):
    """Rows (lang, source, term, n, n_docs) of a partition.  What is held is
    given out and forgotten whenever it reaches HELD_ENTRIES; an empty term
    stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()),
                "term": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64()),
                "n_docs": pa.array(list(docs.values()), pa.int64())})
        held.clear()

    for batch in batches:
        texts = batch.column("text")
        for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
            if key not in held:
                held[key] = Counter({b"": 0}), Counter({b"": 0})
            n, docs = held[key]
            before, distinct = len(n), set()
            for terms in _pieces(texts[i].as_py()):
                n.update(terms)
                distinct.update(terms)
            docs.update(distinct)  # the keys of n and docs come in the same order below
            size += len(n) - before
            if size >= HELD_ENTRIES:
                yield from _aligned(held, rows)
                size = 0
    yield from _aligned(held, rows)


def _aligned(held, rows):
    for key, (n, docs) in held.items():
        held[key] = n, {t: docs[t] for t in n}
    return rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of each term
    in each group; the row with the empty term stands for the group itself.

    Tasks count whole texts in memory of a fixed size and hand on sums, so a
    frequent term or a hot group costs a few rows a task.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = rows.mapInArrow(_count_terms, "lang string, source string, term binary, n bigint, n_docs bigint")
    return (parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
            .withColumn("term", F.col("term").cast("string")))


def share(n: str, total: str, v: str):
    """1 + floor(10^9 (n + 2) / (total + 2v)) of three long columns, exact
    (without kept terms nothing is priced; the divisor is 1 then)."""
    return F.expr(f"1L + cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))"
                  f" div cast(greatest({total} + 2 * {v}, 1L) as decimal(20,0))")


def price(p: str, q: str):
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so it fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _columns(rows: pd.DataFrame, floor: pd.DataFrame, codes: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(sources, group of each column, share of each column, one-hot matrix)."""
    sources = sorted(floor["source"])
    at = {s: i for i, s in enumerate(sources)}
    level = np.zeros((len(codes), len(sources)), dtype=np.int64)
    p = np.tile(floor.set_index("source")["p"].reindex(sources).to_numpy(np.int64), (len(codes), 1))
    t, g = rows["term"].map(codes).to_numpy(), rows["source"].map(at).to_numpy()
    level[t, g], p[t, g] = rows["n"], rows["p"]
    # columns in the order of the groups, each group's levels rising
    order = np.lexsort((level.ravel(), np.tile(np.arange(len(sources)), len(codes))))
    group = np.tile(np.arange(len(sources)), len(codes))[order]
    sorted_level = level.ravel()[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (sorted_level[1:] != sorted_level[:-1])
    column = np.empty(len(order), dtype=np.int64)
    column[order] = np.cumsum(new) - 1
    one_hot = np.zeros((len(codes), int(new.sum())), dtype=np.float32)
    one_hot[np.repeat(np.arange(len(codes)), len(sources)), column] = 1
    return sources, group[new], p.ravel()[order][new], one_hot


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def level_products(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of prices (lang, source, item, value) over one block of terms, for
    every group of block ``gi`` with every group of block ``gj``."""
    lang, _, _, gi, gj = (k.as_py() for k in key)
    rows = table.to_pandas()
    floor = rows["term"].isna()
    if not {gi, gj} <= set(rows.loc[floor, "g"]):  # the hash gave one of the blocks no group
        return _SUMS.empty_table()
    codes = {t: i for i, t in enumerate(rows.loc[~floor, "term"].unique())}
    sides = [_columns(rows[~floor & (rows["g"] == g)], rows[floor & (rows["g"] == g)], codes)
             for g in ([gi] if gi == gj else [gi, gj])]
    (a, ga, pa_, ma), (b, gb, pb, mb) = sides[0], sides[-1]
    value = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(0, ma.shape[1], TILE):
        left = np.ascontiguousarray(ma[:, i:i + TILE].T)
        for j in range(0, mb.shape[1], TILE):
            joint = left @ mb[:, j:j + TILE]
            u, v = np.nonzero(joint)
            cells = joint[u, v].astype(np.int64)
            u, v = u + i, v + j
            f = (pa_[u] - pb[v]) ** 2 // (pa_[u] + pb[v])
            np.add.at(value, (ga[u], gb[v]), f * cells)
    x, y = (m.ravel() for m in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    left, right, sums = np.array(a, object)[x], np.array(b, object)[y], value.ravel()
    if gi == gj:
        out = left[x != y], right[x != y], sums[x != y]
    else:
        out = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([sums, sums])
    return pa.Table.from_pydict({"lang": [lang] * len(out[0]), "source": out[0], "item": out[1], "value": out[2]}, _SUMS)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part ``pair``: item is each other source of the language, value the summed
    price over all kept terms.  Part ``term``: the ``top_terms`` kept terms that
    the group uses more than its language does, by price.  Ranks count from 1,
    value falling, item rising by UTF-8 bytes.

    Null text, language and source count as empty strings; an empty text gives
    its group no term but the group exists; repeated rows count each time; an
    empty table gives no row; a group alone in its language has no pair; extra
    columns are ignored.  Sums that exceed a long raise Spark's overflow error.
    """
    spark = docs.sparkSession
    ship_package(spark)
    term = Window.partitionBy("lang", "term")
    counted = (term_counts(docs, text_col, lang_col, source_col)
               .withColumn("df", F.sum("n_docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
               .withColumn("lead", F.min("source").over(term) == F.col("source"))
               .filter((F.col("term") == "") | (F.col("df") >= min_docs)))
    path = scratch_path(spark, "divergence-kept")
    counted.select("lang", "source", "term", "n", "lang_n", "lead").write.parquet(path)
    saved = spark.read.parquet(path)
    is_term = F.col("term") != ""

    # one row for each group; sums and the size of the language's vocabulary
    vocabulary = saved.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                           F.count_if(F.col("lead") & is_term).alias("v"))
    groups = (saved.groupBy("lang", "source").agg(F.sum("n").alias("total"))
              .join(broadcast_bounded(vocabulary), "lang"))
    sized = broadcast_bounded(groups)
    entries = (saved.filter(is_term).join(sized, ["lang", "source"])
               .withColumn("p", share("n", "total", "v")))

    best = (entries.withColumn("q", share("lang_n", "lang_total", "v")).filter("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    price("p", "q").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    sums = _pair_sums(entries, groups, saved.filter(is_term & F.col("lead")))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.select("lang", "source").join(others, "lang").filter("source <> item")
             .join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce("value", F.lit(0)).cast("long").alias("value")))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best)


def _pair_sums(entries: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) summed over the term blocks."""
    band = F.floor(F.log2(F.col("lang_n").cast("double"))).cast("int").alias("band")
    blocks = terms.groupBy("lang", band).agg(F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).cast("int").alias("n_blocks"))
    spread = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_GROUPS).cast("int").alias("n_g"))
    g = F.pmod(F.xxhash64("source"), F.col("n_g")).cast("int").alias("g")
    dealt = broadcast_bounded(groups.join(broadcast_bounded(spread), "lang")
                              .select("lang", "source", "n_g", g, share("0L", "total", "v").alias("p0")))
    cells = (entries.withColumn("band", band).join(broadcast_bounded(blocks), ["lang", "band"])
             .withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int"))
             .join(dealt.select("lang", "source", "n_g", "g"), ["lang", "source"])
             .select("lang", "band", "block", "n_g", "g", "source", "term", "n", "p"))
    # every block holds the level 0 of all groups, as rows without a term
    each = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    zero = (each.join(dealt, "lang")
            .select("lang", "band", "block", "n_g", "g", "source", F.lit(None).cast("string").alias("term"),
                    F.lit(0).cast("long").alias("n"), F.col("p0").alias("p")))
    other = F.explode(F.sequence(F.lit(0), F.col("n_g") - 1))
    placed = (cells.unionByName(zero).withColumn("other", other)
              .select("lang", "band", "block", F.least("g", "other").alias("gi"), F.greatest("g", "other").alias("gj"),
                      "g", "source", "term", "n", "p"))
    return (placed.groupBy("lang", "band", "block", "gi", "gj")
            .applyInArrow(level_products, "lang string, source string, item string, value bigint")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
