"""Small tables with every oddity: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "the same text of some words here", "en", "a"),
    (2, "the same text of some words here", "en", "b"),
    (9, "the same text of some words here", None, None),
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (5, " \t\n ", "en", "b"),
    (6, "Two words", "en", "c"),
    (6, "Two words", "en", "c"),
    (7, "two words", "en", "c"),
    (None, "no id on this text at all, none", "en", "a"),
    (None, "no id on this text at all, none", "en", "a"),
    (None, None, None, None),
    (10, LONG, "en", "d"),
    (11, LONG + " end", "en", "d"),
    (12, "x" * 300 + "one", "en", "a"),
    (13, "x" * 300 + "two", "en", "a"),
    (14, "\U0001f600 é \x00 <|endoftext|> 'S", "en", "a"),
]
EXTRA = "_row _key _hash _text _id kept keep_id score component_id mix_size _size _source text_sha256 id text2".split()


def documents(spark, rows=None, extra=True):
    rows = ROWS if rows is None else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for i, c in enumerate(EXTRA if extra else []):
        frame = frame.withColumn(c, F.lit(f"mine {i}"))
    return frame


#: Names of extra columns: with dots, quotes, and those that operators give to their own results.
CLASHING = "a.b x`y kept keep_id group_size score mix_size mix_picks doc.id n_shingles component_id".split()


def clashing(spark, rows=None):
    """Documents as the pipeline has them, with extra columns of clashing names."""
    frame = documents(spark, rows, extra=False).selectExpr("*", "cast(length(text) as long) as n_chars")
    for c in CLASHING:
        frame = frame.withColumn(c, F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return frame


def empty(spark):
    return documents(spark, [])
