"""Join helpers: size-checked broadcast and an exact substring join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_MAX_BROADCAST_ROWS = 100_000
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20


def broadcast_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only for a side proven small, in rows and in bytes.

    A capped pass (it reads at most ``max_rows + 1`` rows) checks the bounds;
    beyond them the hint is not given and the planner / AQE picks a shuffled
    join from runtime sizes.
    """
    size = F.lit(0)
    for f in df.schema.fields:
        wide = f.dataType.simpleString() in ("string", "binary") or f.dataType.typeName() in ("array", "map", "struct")
        value = F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        size = size + (F.coalesce(F.octet_length(value), F.lit(0)) if wide else F.lit(8))
    n, b = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (b or 0) <= max_bytes else df


GRAM_CHARS = 6


def _grams(text, n):
    """All substrings of ``n`` characters (none of a shorter text)."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                                                   lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def _grams_in(text, lengths: list[int], wanted: list[str] | None):
    """Distinct substrings of the lengths; of those ``wanted`` only, if given."""
    found = F.array_distinct(F.flatten(F.array(*[_grams(text, F.lit(n)) for n in lengths])))
    return found if wanted is None else F.array_intersect(found, F.array(*map(F.lit, wanted)))


def contains_like_join(left: DataFrame, text_col: str, right: DataFrame, name_col: str,
                       gram_chars: int = GRAM_CHARS, max_names: int = 2000) -> DataFrame:
    """Rows of ``left`` x ``right`` where lower(text) LIKE '%' || lower(name) || '%'.

    ``_`` and ``%`` in a name are LIKE wildcards.  Exact, without forming all
    pairs, by an index of rare grams: a match contains the name's longest piece
    without wildcards, and so each of its grams (substrings of ``gram_chars``
    characters; a shorter piece is one gram).  Every name is looked up by the
    one of its grams that the fewest texts contain, and LIKE verifies.  Up to
    ``max_names`` names, texts keep only grams of the index before they are
    exploded, so the rows are little more than the matches; with more names the
    join drops the others.  A name of wildcards only has no piece: it asks for
    a least length and so matches nearly every text by definition.
    """
    lname, ltext = F.lower(F.col(name_col)), F.lower(F.col(text_col))
    pieces = F.split(lname, r"[_%\\]")
    longest = F.aggregate(pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    r = right.withColumn("_piece", longest)
    keyed, loose = r.filter(F.col("_piece") != ""), r.filter(F.col("_piece") == "").drop("_piece")
    grams = keyed.withColumn("_gram", F.explode(_grams("_piece", F.least(F.length("_piece"), F.lit(gram_chars)))))
    index = _rarest_grams(left.select(ltext.alias("_text")), grams.select("_piece", "_gram").distinct(), gram_chars, max_names)

    cond = F.like(ltext, F.concat(F.lit("%"), lname, F.lit("%")))
    if index is None:
        found = left.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    else:
        lengths, wanted, chosen = index
        cut = left.withColumn("_gram", F.explode(_grams_in(ltext, lengths, wanted)))
        names = keyed.join(broadcast_bounded(chosen), "_piece").drop("_piece")
        found = cut.join(broadcast_bounded(names), "_gram").drop("_gram").filter(cond)
    if loose.isEmpty():
        return found
    least = F.length(F.regexp_replace(lname, "[^_]", ""))
    return found.unionByName(left.join(broadcast_bounded(loose), (F.length(ltext) >= least) & cond))


def _rarest_grams(texts: DataFrame, grams: DataFrame, gram_chars: int, max_names: int):
    """(gram lengths, grams or None for too many, (_piece, _gram) chosen); None
    without any name."""
    pieces = grams.select("_piece").distinct().count()
    if not pieces:
        return None
    # at most gram_chars lengths
    lengths = [r[0] for r in grams.select(F.length("_gram")).distinct().orderBy(F.length("_gram")).collect()]
    few = pieces <= max_names
    every = [r[0] for r in grams.select("_gram").distinct().collect()] if few else None
    seen = texts.select(F.explode(_grams_in(F.col("_text"), lengths, every)).alias("_gram")).groupBy("_gram").agg(
        F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    chosen = cut_lineage(grams.join(seen, "_gram", "left").groupBy("_piece").agg(
        F.min(F.struct(n.alias("n"), (-F.length("_gram")).alias("size"), "_gram")).alias("best"))
        .select("_piece", F.col("best._gram").alias("_gram")))
    return lengths, [r[0] for r in chosen.select("_gram").distinct().collect()] if few else None, chosen
