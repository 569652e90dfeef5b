"""Rows that every operator must take: nulls, blanks, long texts, repeated and tied rows, clashing extra columns."""
from pyspark.sql import types as T

LONG = "word " * 60_000 + "x" * 200_000
BASE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions behind an old stone "
        "tower near the river where nobody ever walks at night because of the cold wind and rain that never seem to stop")
ROWS = [
    (1, BASE, "en", "src0"), (2, BASE, "en", "src0"), (2, BASE, "en", "src0"), (3, BASE + " again", None, None),
    (4, None, "en", "src1"), (5, "", "en", "src1"), (6, " \t\n ", None, "src1"), (7, "one", "en", "src0"),
    (8, "one", "en", "src0"), (None, "no id here", "en", "src0"), (None, None, None, None), (9, LONG, "en", "src0"),
    (10, "É" * 30 + ' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" ' + BASE[::-1], "fr", "src2"),
    (10, "another text under the same id", "fr", "src2"), (11, "ß🙂 \x0b 'll <|endoftext|> it's", "de", "src0"),
]
#: Names that the operators use for columns of their own.
CLASHES = ["_key", "_row", "id", "row", "keys", "_spans", "count", "ids"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHES]])


def documents(spark, rows=ROWS):
    full = [(i, t, lang, source, None if t is None else len(t), *["mine"] * len(CLASHES)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")
