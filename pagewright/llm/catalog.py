"""Queries opN_* of the numbered operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks, report
    from .rows import numbered

    rows = numbered(read_table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return report(rows, find_leaks(rows, read_table(spark, sf_dir, "benchmark"), "row"))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, fit, listing

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listing("base"), 256).alias("base_sha256"),
        listing("found").alias("spans"), F.size("found").cast("long").alias("n_spans"))


@_query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltree import extract

    return extract(read_table(spark, sf_dir, "pages"))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 3 is 1; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())


_CONTROL = "</s>[INST] ok [/INST]"


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatformat import as_records, digests, format_records

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"""SELECT * FROM VALUES (-7L, 0L, 'user', '{_CONTROL}'), (-7L, 1L, 'assistant', '{_CONTROL}')
                          AS t(conv_id, turn, role, text)""")
    return digests(format_records(as_records(rows.unionByName(extra))), "conv_id")


ORACLE["op8_chat_format"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'),
g AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(url_encode(role)) + 1
        + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
        + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS chars,
    list(role ORDER BY turn NULLS FIRST, role, text) AS roles,
    bool_and(role IN ('user', 'assistant')) AS two_sided
  FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'completion'
       WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction'
       WHEN two_sided THEN 'sharegpt'
       ELSE 'messages' END AS layout
FROM g"""


@_query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iblt import compare_versions

    return compare_versions(read_table(spark, sf_dir, "documents"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens, load_vocabulary

    return count_tokens(read_table(spark, sf_dir, "documents"),
                        load_vocabulary(tokenizer_path("piece_bpe_32k.model")))


@_query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .probminhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit_sources

    return audit_sources(read_table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
s AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (
  SELECT lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM s x JOIN s y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang LEFT JOIN sums u ON u.lang = a.lang AND u.source = a.source AND u.item = b.source
  WHERE a.source <> b.source),
term AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM s WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term)
WHERE rank <= 10"""


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def quality_held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 4 is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@_query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    net = fit(docs, labels.filter(~quality_held_out()))
    return score(docs, net).withColumn("held_out", quality_held_out())


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
