"""Mixing sources to target weights by highest quotients (Sainte-Laguë).

Sources are given integer numbers of equal-token blocks. A block of a source covers the next
words of its allotment, and its quotient is the target over twice the middle of these words,
which for whole blocks is target / (2 * held + 1). The blocks with the highest quotients are
awarded. One rule holds for all sources: a block has PARTS-th of the least target that no cap
binds, and where the cap of a source is no multiple of it, its last block is shorter, so a
source that is taken up to its cap is taken whole. The length follows the targets, so there
are at most some thousand blocks per source whatever the corpus.

The sequence of awards is cut into shards of equal numbers of blocks, which gives every shard
an integer quota per source and mixes any run of shards to the weights. Inside a source the
documents stand in a seeded order, which starts again from the front when it has been used
up; shard after shard takes its quota of blocks as the next words of that order. A use of a
document belongs to the shard in which it begins, so only the end of a source cuts one.

Only DataFrame functions are used. Nothing is collected: targets are a table with a row per
source, awards are numbered by a range-partitioned sort, and a hot source is numbered in hash
buckets.

Defined cases: a null text has size 0; null sources form one source, ordered last; a source
without words has target 0; repeated rows are separate rows; an empty table gives no rows;
other columns of the input are ignored by `take`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import SPACE, WORD, landed, query, table
from lexspan.operators.scale import number_by_order

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
PARTS = 2048  # blocks of the least target that no cap binds
SHARDS = 16
_BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, all_words, cap, level (of one weight), target.

    A target is the weighted part of `share` of all words, at most `most` times the source.
    The excess goes to the others by weight until none is above: with the sources in order
    of cap / weight, the capped ones are a prefix, and the rest share what is left.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = total.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = rows.withColumn("all_words", F.sum("source_size").over(everything))
    level = (share * F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(order))
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("at", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(free * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", "all_words", "cap", free.alias("level"), target.alias("target"))


def seats(goals: DataFrame, share: float = SHARE) -> DataFrame:
    """The awarded blocks: source, seat (from 1 in its source), words, place (from 0), blocks (of all sources).

    There are as many blocks as fill the sources that are taken up to their caps, and the
    rest of all words for the others. A source is offered its target and a 64th more.
    """
    rows = goals.withColumn("block", F.greatest(F.lit(1), F.floor(F.col("level") / PARTS)))
    rows = rows.withColumn("room", F.ceil(F.col("cap") / F.col("block")))
    capped, everything = F.col("target") == F.col("cap"), W.partitionBy()
    full = F.coalesce(F.sum(F.when(capped, F.col("cap"))).over(everything), F.lit(0))
    full_room = F.coalesce(F.sum(F.when(capped, F.col("room"))).over(everything), F.lit(0))
    rows = rows.withColumn("blocks", F.floor((share * F.col("all_words") - full) / F.col("block") + 0.5) + full_room)
    offered = F.least(F.col("room"), F.ceil(F.col("target") * 65 / 64 / F.col("block")) + 1)
    rows = rows.withColumn("offered", offered).filter("offered > 0")
    asked = rows.withColumn("seat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("offered"))))
    start, end = (F.col("seat") - 1) * F.col("block"), F.least(F.col("seat") * F.col("block"), F.col("cap"))
    asked = asked.select("source", "seat", "blocks", (end - start).alias("words"), (-F.col("target") / (start + end)).alias("_falling"),
                         F.col("source").isNull().alias("_last"))
    placed = number_by_order(asked, ["_falling", "_last", "source", "seat"], "place")
    return placed.filter("place < blocks").select("source", "seat", "words", "place", "blocks")


def quotas(goals: DataFrame, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """Blocks and words of each source in each shard: shard (from 1), source, quota, words."""
    shard = (F.floor(F.col("place") * shards / F.col("blocks")) + 1).cast("int")
    return seats(goals, share).groupBy(shard.alias("shard"), "source").agg(F.count("*").alias("quota"), F.sum("words").alias("words"))


def owed(goals: DataFrame, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """source, source_size, target, words that the mix takes, and ends: of them, those up to the end of each shard."""
    def up_to(n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("shard") <= n, F.col("words"))), F.lit(0))

    awarded = quotas(goals, share, shards).groupBy(F.col("source").alias("_s")).agg(
        F.sum("words").alias("words"), F.array(*[up_to(n) for n in range(1, shards + 1)]).alias("ends"))
    return goals.join(awarded, F.equal_null("source", F.col("_s")), "left").select(
        "source", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("words"), "ends")


def take(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards of every row of doc_id, source, text.

    `shards` has the shard of each use of the document.
    """
    sized = landed(sizes(docs), "sizes")
    return taken(sized, seed)


def taken(sized: DataFrame, seed: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """As `take`, from rows doc_id, source, size and any others, which are kept.

    Rows of a source with equal id and size are ordered by `ties`.
    """
    plan = owed(targets(sized)).select(
        F.col("source").alias("_source"), "source_size", "target", F.col("words").alias("_words"), F.col("ends").alias("_ends"))

    # Words of the source before each row in the seeded order, by totals of hash buckets.
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = sized.withColumn("_code", code).withColumn("_bucket", F.substring("_code", 1, _BUCKET_DIGITS))
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = totals.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_bucket").orderBy("_code", "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offset, F.equal_null("source", F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    # A row per source, of which there are few beside documents: Spark broadcasts it if small.
    rows = rows.join(plan, F.equal_null("source", F.col("_source")))
    passes = F.coalesce(F.floor(F.col("_words") / F.col("source_size")), F.lit(0))
    rest = F.col("_words") - passes * F.col("source_size")
    begin = F.col("_base") + F.col("_local")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    out = rows.withColumn("taken", F.when(F.col("size") > 0, passes * F.col("size") + part).otherwise(0).cast("long"))
    out = out.withColumn("_begin", begin)
    uses = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)
    ended = F.transform(uses, lambda i: F.size(F.filter("_ends", lambda end: end <= i * F.col("source_size") + F.col("_begin"))) + 1)
    shards = F.when(F.col("taken") > 0, ended).otherwise(F.array().cast("array<int>"))
    return out.select(*sized.columns, "source_size", "target", "taken", shards.alias("shards"))


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, rf"(?<=[^{SPACE}])(?=[{SPACE}])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def mix(docs: DataFrame, seed: int = 0, shard: str | None = None) -> DataFrame:
    """The mixed documents, with the columns of the input: a row for every use of a document.

    With `shard`, a column of that name says which shard the use belongs to.

    A document at the cut of its source is shortened to the words that the mix takes;
    `n_chars`, where present, follows the text. Documents without words are left out.
    """
    if shard in docs.columns:
        raise ValueError(f"the documents have a column {shard}")
    numbered = landed(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "numbered")
    sized = landed(numbered.select(
        "id", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
        word_count(F.col("row.text")).alias("size"), F.md5("row.text").alias("tie")), "sizes")
    plan = taken(sized, seed, ("tie", "id")).filter("taken > 0").select(
        "id", F.floor(F.col("taken") / F.col("size")).cast("int").alias("full"), (F.col("taken") % F.col("size")).cast("int").alias("rest"), "shards")
    used = numbered.join(plan, "id")
    part = F.when(F.col("rest") > 0, F.array(leading_words(F.col("row.text"), F.col("rest")))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("full")), part)
    rows = used.select("row", F.explode(F.arrays_zip(texts.alias("text"), F.col("shards").alias("shard"))).alias("use")).select("row", "use.text", "use.shard")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    kept = [(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.select(*kept, *([F.col("shard").alias(shard)] if shard else []))


_ENDS = ", ".join(f"coalesce(sum(words) FILTER (shard <= {n}), 0)" for n in range(1, SHARDS + 1))
_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS all_words,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * all_words - coalesce(sum(cap) OVER b, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS pos
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(level, pos) AS level FROM levels WHERE cap > level * weight),
goals AS (
  SELECT source, source_size, all_words, cap, free.level AS level,
    least(cap::DOUBLE, coalesce(free.level * weight, cap::DOUBLE)) AS target FROM levels LEFT JOIN free ON true),
house AS (
  SELECT *, greatest(1, floor(level / {PARTS}))::BIGINT AS block, ceil(cap / greatest(1, floor(level / {PARTS}))::BIGINT)::BIGINT AS room FROM goals),
whole AS (
  SELECT *, (floor((1.5::DOUBLE * all_words - coalesce(sum(cap) FILTER (target = cap::DOUBLE) OVER (), 0)::DOUBLE) / block + 0.5)
    + coalesce(sum(room) FILTER (target = cap::DOUBLE) OVER (), 0))::BIGINT AS blocks FROM house),
-- Every block that a source is offered, ranked by its quotient.
offered AS (
  SELECT *, least(seat * block, cap) AS last, (seat - 1) * block AS start
  FROM (SELECT *, unnest(range(1, least(room, ceil(target * 65 / 64 / block)::BIGINT + 1) + 1)) AS seat FROM whole)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY target / (start + last) DESC, source NULLS LAST, seat) - 1 AS place FROM offered),
awarded AS (SELECT source, last - start AS words, place * {SHARDS} // blocks + 1 AS shard FROM ranked WHERE place < blocks),
won AS (SELECT source, sum(words)::BIGINT AS words, [{_ENDS}] AS ends FROM awarded GROUP BY source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || size), size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM sized),
taken AS (
  SELECT p.doc_id, p.size, h.source_size, h.target, p.begin, w.ends,
    CASE WHEN p.size = 0 THEN 0 ELSE coalesce(w.words, 0) // h.source_size * p.size
      + greatest(0, least(p.size, coalesce(w.words, 0) % h.source_size - p.begin)) END::BIGINT AS taken
  FROM placed p JOIN house h ON p.source IS NOT DISTINCT FROM h.source
  LEFT JOIN won w ON p.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN 1 + len(list_filter(ends, lambda e: e <= begin)) END::INT AS shard
FROM taken
"""


@query("op3_mixing", _SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, and the shard of their first use."""
    taken_rows = take(table(spark, sf_dir, "documents"))
    return taken_rows.select("doc_id", "size", "source_size", "target", "taken", F.get("shards", F.lit(0)).alias("shard"))
