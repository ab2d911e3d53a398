"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \n\t ", None, "b"),
    (6, LONG, "en", "b"),
    (7, "eins zwei drei", "de", "b"),
    (8, "EINS zwei\ndrei", "de", "b"),
    (9, "!!! 123", "en", "b"),
    (None, "no id here at all", "en", "c"),
    (10, "<|im_end|> Straße ﬁ Ａ \U0001f600 é", "de", "c"),
    (10, "<|im_end|> Straße ﬁ Ａ \U0001f600 é", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=TEXTS, extra=True):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(length(text) as long) AS n_chars")
    return df.selectExpr("*", "1 AS block", "'x' AS n", "2 AS k", "'y' AS secret_spans") if extra else df
