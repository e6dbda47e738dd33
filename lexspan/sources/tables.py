"""Text tables: reviewed drafts, frequency counts and Zipf tables, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.functions.text import strip
from lexspan.operators.fingerprint import texts_digest
from lexspan.session import freeze

# Columns of a draft, in file order.
DRAFT_COLUMNS = ["target", "query", "sense_hint", "zipf", "freq_band", "token_count", "style",
                 "lexical_overlap", "reachable", "acceptable"]
REQUIRED = ["target", "query"]

EVAL_SCHEMA = (
    "id string, query string, target string, source string, meta struct<sense_hint string, zipf double, "
    "token_count string, style string, lexical_overlap string, reachable boolean, "
    "acceptable array<string>, leakage string>"
)
META = ["sense_hint", "zipf", "token_count", "style", "lexical_overlap", "reachable", "acceptable", "leakage"]


def read_numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with their dense number `position`, from 0, in the order of files and of lines in them.

    A file is read in splits, and a split is read front to back by one task. So a line's number is
    the number of lines in earlier files and splits, plus its place in its split: only a row per
    split is sorted. The lines are written once, so that a place cannot move on a retry.
    """
    lines = freeze(spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")))
    splits = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return lines.join(offsets, ["_file", "_start"]).select((F.col("_at") + F.col("_offset")).alias("position"), "line")


def parse_draft(lines: DataFrame) -> DataFrame:
    """Rows of a reviewed table: comments dropped, short rows padded, cells trimmed.

    `lines`: position, line. The first line that is no comment is the header.
    """
    line = F.regexp_replace("line", "\r$", "")
    kept = lines.select("position", line.alias("line")).filter(
        (F.length("line") > 0) & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit('"#')))
    head = kept.orderBy("position").limit(1).collect()
    names = [h.strip() for h in head[0]["line"].split("\t")] if head else []
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}: {' | '.join(names)}")
    cells = F.split("line", "\t")
    return kept.filter(F.col("position") > head[0]["position"]).select(
        "position", *[strip(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)])


def draft_lines(draft: DataFrame) -> Column:
    """One tab-separated line per row; a missing Zipf is empty, a present one has three decimals."""
    cols = dict.fromkeys(DRAFT_COLUMNS, None)
    for name in cols:
        value = F.format_number(F.col(name), 3) if name == "zipf" else F.col(name).cast("string")
        cols[name] = F.coalesce(value, F.lit(""))
    return F.concat_ws("\t", *cols.values())


def write_draft(draft: DataFrame, path: str) -> None:
    cols = [F.coalesce(F.format_number("zipf", 3), F.lit("")).alias(c) if c == "zipf" else F.col(c) for c in DRAFT_COLUMNS]
    draft.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def parse_counts(lines: DataFrame) -> DataFrame:
    """`word count` per line; lines without a space or with no number are skipped."""
    at = F.locate(" ", F.col("line"))
    return lines.filter(at > 0).select(
        F.substring_index("line", " ", 1).alias("word"),
        strip(F.substring(F.col("line"), at + 1, F.length("line"))).try_cast("double").alias("n"),
    ).filter(F.col("n").isNotNull() & ~F.isnan("n") & (F.abs("n") != float("inf")))


def write_zipf(table: DataFrame, path: str) -> None:
    """Lemmas with a Zipf, three decimals; lemmas without one are left out."""
    rows = table.filter("zipf is not null").select(F.concat_ws("\t", "word", F.format_number("zipf", 3)).alias("value"))
    rows.write.mode("overwrite").text(path)


def parse_zipf(lines: DataFrame) -> DataFrame:
    kept = lines.filter((F.length("line") > 0) & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("\t")))
    at = F.locate("\t", F.col("line"))
    return kept.select(F.substring_index("line", "\t", 1).alias("word"),
                       F.substring(F.col("line"), at + 1, F.length("line")).try_cast("double").alias("zipf"))


def nested(rows: DataFrame) -> DataFrame:
    return rows.select("id", "query", "target", "source", F.struct(*META).alias("meta"))


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("id", "query", "target", "source", *[F.col(f"meta.{m}").alias(m) for m in META])


def write_set(rows: DataFrame, path: str) -> None:
    nested(rows).write.mode("errorifexists").json(path)


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; blank lines are skipped by the reader."""
    return flat(spark.read.schema(EVAL_SCHEMA).json(path))


def set_digest(spark: SparkSession, path: str) -> DataFrame:
    """`sha256`, `rows` of a written evaluation set: read back, every field as text, in the order of ids."""
    fields = [F.coalesce(F.array_join(c, ",") if c == "acceptable" else F.format_number(c, 6) if c == "zipf" else F.col(c).cast("string"), F.lit("-"))
              for c in ("id", "query", "target", "source", *META)]
    text = read_set(spark, path).select(F.col("id").alias("row"), F.concat_ws("\x1f", *fields).alias("text"))
    return texts_digest(text).withColumn("rows", text.agg(F.count("*")).scalar())
