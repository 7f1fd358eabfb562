"""A small table of documents with every odd case, for all operators."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} turns{i % 13}." for i in range(60_000))


def rows():
    a = "The quick brown fox jumps over the lazy dog and runs far away. It never came back to the old farm house again."
    return [
        (1, a, "en", "x", 1), (2, a, "en", "x", 1), (2, a, "en", "x", 1), (3, a + " So.", "en", "y", 1), (4, None, "en", "y", 1), (5, "", None, "y", 1), (6, " \n\t ", "de", None, None),
        (None, a, "en", "x", 1), (None, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "x", 1), (7, "12 34 !!", "en", "z", 1), (8, LONG, "en", "z", 1),
        (9, "🙂 naïve ▁ marker \x00 日本語", "ja", "z", 1), (10, a.upper(), "en", "z", 1), (2, "same id, another text", "en", "x", 1),
    ]


def frame(spark, parts=3):
    return spark.createDataFrame(rows(), DOC).repartition(parts)


def clashing(spark):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "_d _t _row key fp label score tokens decoded removed_spans shard slot units digest n first a.b".split()
    return frame(spark).withColumns({n: F.lit(n) for n in names if n != "a.b"}).withColumn("a.b", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, many=0):
    rows = [(1, 1, 0), (3, 1, 1), (None, 0, 1), (10, None, None), (3, 0, 0)] + [(100 + i, 1, i % 2) for i in range(many)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
