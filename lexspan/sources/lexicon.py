"""Lexicon files: index files list lemmas, data files hold synsets with glosses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions.text import strip

# Parts of speech, one index and one data file each.
PARTS_OF_SPEECH = ["noun", "verb", "adj", "adv"]

# A separator that no line holds keeps each line whole; unlike the text reader, the csv
# reader decodes Latin-1.
_WHOLE_LINE = {"sep": "\x01", "quote": "", "encoding": "ISO-8859-1", "header": False}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_WHOLE_LINE).schema("line string").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in Latin-1; the text writer knows UTF-8 only."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "escape": ""}
    lines.select("line").write.options(**_WHOLE_LINE, **kept).csv(path)


def _content(lines: DataFrame) -> DataFrame:
    """Blank lines and licence lines, which start with two spaces, are no content."""
    return lines.filter((F.length("line") > 0) & ~F.startswith("line", F.lit("  ")))


def parse_index(lines: DataFrame) -> DataFrame:
    """Lemmas of an index file: the text before the first space, underscores as spaces."""
    kept = _content(lines).filter(F.contains("line", F.lit(" ")))
    others = [c for c in lines.columns if c != "line"]
    return kept.select(*others, F.translate(F.substring_index("line", " ", 1), "_", " ").alias("lemma"))


def parse_data(lines: DataFrame) -> DataFrame:
    """Synsets of a data file: offset, words, gloss, examples.

    The head holds offset, file, type, a hex word count and then word and id in turn. The
    gloss is cut at semicolons: parts that start with a quote are examples, and unquoted
    parts count as definition only before the first example.
    """
    others = [c for c in lines.columns if c != "line"]
    bar = F.locate("|", F.col("line"))
    rows = _content(lines).filter(bar > 0).select(
        *others,
        F.split(strip(F.substring_index("line", "|", 1)), r"\s+").alias("fields"),
        F.transform(
            F.split(strip(F.substring(F.col("line"), bar + 1, F.length("line"))), ";"), strip
        ).alias("parts"),
    )
    hex_digits = F.regexp_extract(F.coalesce(F.get("fields", F.lit(3)), F.lit("")), "^[0-9a-fA-F]+", 0)
    rows = rows.withColumn("hex", hex_digits).filter("hex <> ''")
    count = F.conv("hex", 16, 10).cast("int")
    slots = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    words = F.filter(
        F.transform(slots, lambda i: F.translate(F.get("fields", i * 2 + 4), "_", " ")),
        lambda w: F.coalesce(w, F.lit("")) != "",
    )
    quoted = lambda p: p.rlike("^[\"']")
    first = F.array_position(F.transform("parts", quoted), True)
    definition = F.filter("parts", lambda p, i: (first == 0) | (i < first - 1))
    examples = F.transform(F.filter("parts", quoted), lambda p: F.regexp_replace(p, "^[\"']|[\"']$", ""))
    return rows.select(
        *others, F.get("fields", F.lit(0)).alias("offset"), words.alias("words"),
        strip(F.array_join(definition, "; ")).alias("gloss"), examples.alias("examples"),
    )


def read_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(index lemmas, synsets) of all parts of speech in a folder."""
    index = synsets = None
    for pos in PARTS_OF_SPEECH:
        tag = F.lit(pos).alias("pos")
        lemmas = parse_index(read_lines(spark, f"{folder}/index.{pos}").select("line", tag))
        data = parse_data(read_lines(spark, f"{folder}/data.{pos}").select("line", tag))
        index = lemmas if index is None else index.unionByName(lemmas)
        synsets = data if synsets is None else synsets.unionByName(data)
    return index, synsets
