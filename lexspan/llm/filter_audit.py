"""Interaction of document filters: what each one removes in every order of applying them.

Every document is reduced to a mask of the filters that it fails, and the documents to mask
cells: counts by part and mask. A recursive query then extends prefixes of filters by the
letters not used yet. Each of its rows is a prefix joined with a mask cell and carries the
bits applied before and after its last letter, so each level of the recursion emits what that
step keeps, removes and would have removed. The walk over prefixes has at most
masks * (5 + 20 + 60 + 120 + 120) rows, whatever the number of documents; the counts of the
cells are joined to it afterwards, and an order of filters reads its steps off its prefixes.

Copies are recognised by a hash of the whole text. Rows of a text are reduced to one per
part and label before they meet, so a text that a third of all rows share is no hot group.

Defined cases: a null text is empty, a null part the empty string; a null id is smaller than
none and larger than none, so its row is no copy and makes none; repeated rows are separate
rows, and rows of one id are not copies of each other; several label rows of an id count
together (any of them good makes it good); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import WORD, landed, query, table

LETTERS = "ABCDE"
_COPY = "E"


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Conditions under which the filters that look at one text reject it."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, key (hash of the text) and mask of the filters that look at one text."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for letter, fails in text_failures(F.col("_text"), F.col("_words")).items():
        mask = mask + F.when(fails, bit(letter)).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("key"), mask.cast("int").alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: documents by the filters they fail, copies included."""
    # The join key of a row without id is its text, so that such rows spread.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("key")))
    counted = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("c")).withColumn("_name", name)
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("_name")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = counted.join(told, "_name", "left").fillna(0, ["good", "toxic"])

    with_id = F.col("doc_id").isNotNull()
    same = known.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(with_id, F.col("c"))), F.lit(0)).alias("ids"),
        F.min(F.when(with_id, F.struct("doc_id", "c"))).alias("first"))
    # At most one row per part and label of a text is left.
    least = F.min("first.doc_id").over(W.partitionBy("key"))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    copies = F.coalesce(F.col("ids") - originals, F.lit(0))
    split = same.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")),
        F.struct((F.col("mask") + bit(_COPY)).alias("mask"), copies.alias("n")))).alias("x")).filter("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("docs"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


_WALK = """
WITH RECURSIVE walk(prefix, step, letter, bit, before, applied, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(prefix, x.letter), step + 1, x.letter, x.bit, applied, applied | x.bit, mask
  FROM (SELECT *, explode(filter({letters}, x -> applied & x.bit = 0)) AS x FROM walk))
SELECT prefix, step, letter, mask,
  CAST(mask & applied = 0 AS INT) AS kept,
  CAST(mask & before = 0 AND mask & bit > 0 AS INT) AS removed,
  CAST(mask & before > 0 AND mask & bit > 0 AS INT) AS redundant,
  CAST(mask = bit AS INT) AS alone
FROM walk WHERE step > 0
"""


def walk(masks: DataFrame) -> DataFrame:
    """What every prefix of filters does at its last letter to each mask, as zeros and ones."""
    letters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {bit(x)})" for x in LETTERS) + ")"
    return masks.sparkSession.sql(_WALK.replace("{letters}", letters), masks=masks)


def audit(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters."""
    # Bounded by the number of masks times that of prefixes: 32 * 325 rows at most.
    steps = landed(walk(counted.select("mask").distinct()), "filter-walk")
    sums = {
        "kept": F.col("kept") * F.col("docs"), "removed": F.col("removed") * F.col("docs"), "redundant": F.col("redundant") * F.col("docs"),
        "unique_fails": F.col("alone") * F.col("docs"), "good_lost": F.col("removed") * F.col("good"), "toxic_lost": F.col("removed") * F.col("toxic"),
    }
    met = counted.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    # An order passes through one prefix of each length; the rest of it can stand in (5 - step)! ways.
    ways = F.element_at(F.array(*[F.lit(math.factorial(len(LETTERS) - s)) for s in range(1, len(LETTERS) + 1)]), F.col("step"))
    met = met.withColumn("shapley", F.sum(F.col("removed") * ways).over(W.partitionBy("part", "letter")))
    orders = steps.filter(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    through = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("_at")).select(
        "filter_order", F.substring("filter_order", F.lit(1), F.col("_at")).alias("prefix"))
    out = met.join(F.broadcast(through), "prefix")
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*sums, "shapley")])


_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM docs d LEFT JOIN told ON d.doc_id = told.doc_id),
cells AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT '' AS filter_order, 0 AS applied UNION ALL
  SELECT filter_order || letter, applied | bit FROM orders, letters WHERE applied & bit = 0),
steps AS (
  SELECT filter_order, step, letter, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5) JOIN letters ON letter = filter_order[step]),
met AS (
  SELECT part, filter_order, step, letter, sum(docs) FILTER (mask & (before | bit) = 0) AS kept,
    sum(docs) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(docs) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(docs) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM met
"""


@query("op13_filter_audit", _SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all orders of the five filters, by language."""
    rows = landed(marked(table(spark, sf_dir, "documents")), "filter-masks")
    return audit(landed(cells(rows, table(spark, sf_dir, "labels")), "filter-cells"))
