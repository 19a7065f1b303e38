import pytest
from pyspark.sql import functions as F


LONG = "long text of many words " * 20_000

ROWS = [(1, "A plain text with seven words here."), (2, None), (3, ""), (4, "   \n\t "), (5, "12345 !!!"),
        (6, "A plain text with seven words here."), (6, "A plain text with seven words here."),
        (7, LONG), (8, "éàü ñ 漢字 <|endoftext|> \x00 end"), (None, "no id"), (9, "word")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for c in ("id", "score", "lang_pred", "n_words", "start", "found", "base", "class_id", "a", "b", "extra", "h",
              "part", "tail", "pii_text", "length", "offset", "n_chars", "item_id", "similarity"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
