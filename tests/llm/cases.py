"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "word", "xx"),
    (5, "The quick brown fox. " * 40, "en"),
    (5, "The quick brown fox. " * 40, "en"),
    (None, "No id here at all, but text.", "en"),
    (6, "ü" * 5000, "de"),
    (7, "日本語のテキスト 中文 " * 30, None),
    (8, "a b " * 20000, "en"),
    (9, "  two  spaces ▁ mark <|endoftext|> <s> \x00 é́ İ Σ", "fr"),
]
#: Columns whose names the operators use themselves.
CLASHES = ("digest", "n_tokens", "piece", "rank", "salt", "length", "kept", "fingerprint", "component_id", "line", "row", "n", "label")


def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


def empty(spark):
    return odd(spark).limit(0)
