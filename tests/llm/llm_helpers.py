"""Documents for the tests of this folder."""

import zlib

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that the operators use inside.
CLASHING = ["id", "key", "row", "size", "taken", "target", "tie", "top", "ids", "score", "label", "spans", "base", "bands", "_code", "h", "n", "k"]


def docs_of(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); with `extra`, columns with clashing names."""
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    schema = DOCS
    if extra:
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
        rows = [(*r, *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(rows, schema)


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def typed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "plain words stay here", "en", None), (4, "one", "en", "b"),
    (5, "one", "en", "b"), (5, "one", "en", "b"), (6, "w" * 50_000, "en", "b"), (7, "a b c d e f g " * 4000, "en", "a"), (8, "日本 \U0001f600 é ▁ x", None, "c"),
]
