"""Acceptable answers: synset mates as candidates, clean-up, merge.

Candidate lists are kept factored. `entries` has one row per target and synset with its
counts, and the member tables have one row per synset and word. A target's list is its
synset's members without the target's own case group, so a large synset with many targets
costs their sum and not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions import text as X


def _distinct_members(glosses: DataFrame) -> DataFrame:
    return glosses.select("sense_key", "word").distinct()


def worklist_entries(glosses: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that share a synset with other pooled words: target, sense_key, pos, mates."""
    members = _distinct_members(glosses)
    sizes = members.groupBy("sense_key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = members.join(targets.select("word").distinct(), "word", "left_semi")
    return mine.join(sizes, "sense_key").select(
        F.col("word").alias("target"), "sense_key", X.pos_name(F.col("sense_key")).alias("pos"),
        (F.col("n") - 1).alias("mates"),
    )


def worklist_order() -> list[Column]:
    return [F.desc("mates"), F.asc("target"), F.asc("sense_key")]


def worklist_members(glosses: DataFrame, entries: DataFrame) -> DataFrame:
    """Members of every listed synset. The mates of an entry are these without its target."""
    return _distinct_members(glosses).join(entries.select("sense_key").distinct(), "sense_key", "left_semi")


def case_groups(members: DataFrame) -> DataFrame:
    """Spellings of one lower case in a synset: the kept spelling, their number, symbol or not.

    The all-lower-case form is kept, else the first in string order. A group of at most
    three letters without any spelling free of capitals is a symbol.
    """
    return members.groupBy("sense_key", F.lower("word").alias("base")).agg(
        F.coalesce(F.max(F.when(F.col("word") == F.lower("word"), F.col("word"))), F.min("word")).alias("kept"),
        F.count("*").alias("variants"),
        F.bool_and(F.col("word").rlike("[A-Z]")).alias("all_capital"),
    ).withColumn("symbol", (F.length("base") <= 3) & F.col("all_capital")).drop("all_capital")


def review_entries(glosses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target and synset: candidates before and after clean-up and what was removed."""
    entries = worklist_entries(glosses, targets)
    groups = case_groups(worklist_members(glosses, entries))
    plain = ~F.col("symbol")
    totals = groups.groupBy("sense_key").agg(
        F.count_if(plain).alias("kept_all"), F.count_if("symbol").alias("symbols_all"),
        F.sum(F.when(plain, F.col("variants") - 1).otherwise(0)).alias("duplicates_all"),
    )
    own = groups.select("sense_key", F.col("base").alias("_b"), "symbol", F.col("variants").alias("own"))
    rows = entries.withColumn("_b", F.lower("target")).join(own, ["sense_key", "_b"]).join(totals, "sense_key")
    mine = F.col("symbol")
    return rows.select(
        "target", "sense_key", F.col("mates").alias("before"),
        (F.col("kept_all") - F.when(mine, 0).otherwise(1)).alias("after"),
        (F.col("own") - 1).alias("target_case_variants"),
        (F.col("duplicates_all") - F.when(mine, 0).otherwise(F.col("own") - 1)).alias("case_duplicates"),
        (F.col("symbols_all") - F.when(mine, 1).otherwise(0)).alias("symbol_forms"),
    )


def review_candidates(glosses: DataFrame, targets: DataFrame) -> DataFrame:
    """Surviving spellings per listed synset; an entry skips the one equal to its target in any case."""
    entries = worklist_entries(glosses, targets)
    groups = case_groups(worklist_members(glosses, entries))
    return groups.filter(~F.col("symbol")).select("sense_key", F.col("kept").alias("candidate"))


def review_removals(glosses: DataFrame, targets: DataFrame) -> DataFrame:
    """Every spelling that clean-up drops from a synset, with the rule that dropped it."""
    members = worklist_members(glosses, worklist_entries(glosses, targets))
    groups = case_groups(members)
    rows = members.withColumn("base", F.lower("word")).join(groups, ["sense_key", "base"])
    rule = F.when(F.col("symbol"), "symbol form").when(F.col("word") != F.col("kept"), "case duplicate")
    return rows.withColumn("rule", rule).filter("rule is not null").select("sense_key", "word", "kept", "rule")


def target_variants(glosses: DataFrame, targets: DataFrame) -> DataFrame:
    """Spellings of the target itself that clean-up drops from its own list: target, sense_key, word."""
    entries = worklist_entries(glosses, targets)
    members = worklist_members(glosses, entries).withColumn("base", F.lower("word"))
    same = entries.select("target", "sense_key", F.lower("target").alias("base"))
    return members.join(same, ["sense_key", "base"]).filter("word <> target").select("target", "sense_key", "word")


def mates_of(glosses: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """One target's worklist: its mates in each synset, in string order."""
    entries = worklist_entries(glosses, targets.filter(F.col("word") == target))
    members = worklist_members(glosses, entries).filter(F.col("word") != target)
    return members.select(F.lit(target).alias("target"), "sense_key", F.col("word").alias("mate")).orderBy("sense_key", "mate")


def candidates_of(glosses: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """One target's review list: surviving candidates of each synset without its own case group, in string order."""
    mine = targets.filter(F.col("word") == target)
    kept = review_candidates(glosses, mine).filter(F.lower("candidate") != target.lower())
    return kept.select(F.lit(target).alias("target"), "sense_key", "candidate").orderBy("sense_key", "candidate")


def report_totals(review: DataFrame) -> DataFrame:
    names = ["before", "after", "target_case_variants", "case_duplicates", "symbol_forms"]
    return review.agg(F.countDistinct("target").alias("targets"), F.count("*").alias("groups"),
                      *[F.sum(n).alias(n) for n in names])


MAX_CELL = 10_000


def merge_entries(draft: DataFrame, proposals: DataFrame, key: str = "position") -> DataFrame:
    """Existing entries of each draft row, then accepted candidates that are new in any case.

    `draft`: a unique `key`, target, acceptable (text). `proposals`: target, position,
    candidate, all accepted. One row per entry: key, part (0 kept, 1 added), place, entry.
    Running the merge on its own result adds nothing.
    """
    names = draft.select(key, X.strip(F.col("target")).alias("target"), "acceptable")
    kept = names.select(
        key, F.lit(0).alias("part"), F.posexplode(X.split_csv(F.col("acceptable"))).alias("place", "entry"))
    first = proposals.groupBy("target", F.lower("candidate").alias("low")).agg(
        F.min(F.struct(F.col("position").alias("place"), "candidate")).alias("p"))
    have = kept.select(key, F.lower("entry").alias("low")).distinct()
    fresh = names.select(key, "target").join(first, "target").join(have, [key, "low"], "left_anti")
    return kept.withColumn("place", F.col("place").cast("long")).unionByName(fresh.select(
        key, F.lit(1).alias("part"), F.col("p.place").cast("long").alias("place"), F.col("p.candidate").alias("entry")))


def merge_accepted(draft: DataFrame, proposals: DataFrame, key: str = "position") -> DataFrame:
    """The draft with merged cells, and how many entries were added and kept per row.

    A cell is one text and holds all merged entries, however many; `overlong_entries` gives
    those of long cells as rows, too.
    """
    entries = merge_entries(draft, proposals, key)
    sizes = entries.groupBy(key).agg(F.count_if(F.col("part") == 1).alias("_added"))
    changed = entries.join(sizes.filter("_added > 0").select(key), key, "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("part", "place", "entry")))
    cells = changed.groupBy(key).agg(F.array_join(F.transform(ordered, lambda e: e["entry"]), ", ").alias("_cell"))
    offered = proposals.select(F.col("target").alias("_t"), F.lit(True).alias("_offered")).distinct()
    rows = (
        draft.withColumn("_t", X.strip(F.col("target"))).join(offered, "_t", "left")
        .join(sizes.select(key, "_added"), key, "left").join(cells, key, "left")
    )
    return rows.select(
        *[c for c in draft.columns if c != "acceptable"], F.coalesce("_cell", "acceptable").alias("acceptable"),
        F.coalesce("_added", F.lit(0)).alias("added"),
        F.when(F.col("_offered"), F.size(X.split_csv(F.col("acceptable")))).otherwise(0).alias("kept"))


def overlong_entries(draft: DataFrame, proposals: DataFrame, key: str = "position") -> DataFrame:
    """Merged entries, as rows, of the draft rows with more than MAX_CELL of them."""
    entries = merge_entries(draft, proposals, key)
    long = entries.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > MAX_CELL).select(key)
    return entries.join(long, key, "left_semi")


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("added") > 0).alias("rows_changed"), F.sum("added").alias("entries_added"),
                      F.sum("kept").alias("entries_kept"))


def unmatched_targets(draft: DataFrame, proposals: DataFrame) -> DataFrame:
    have = draft.select(X.strip(F.col("target")).alias("target"))
    return proposals.select("target").distinct().join(have, "target", "left_anti")
