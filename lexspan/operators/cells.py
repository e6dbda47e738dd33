"""Vector cells: building, collapsing by synset, rounding and truncating, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions import text as X, vectors as V
from lexspan.operators import search as S

SELF_SAMPLES = 60


class RefusedError(RuntimeError):
    """A guard found rows that must not be written."""

    def __init__(self, message: str, rows: DataFrame | None = None):
        super().__init__(message)
        self.rows = rows


def refuse_if_any(rows: DataFrame, message: str) -> None:
    if rows.limit(1).count():
        raise RefusedError(message, rows)


def _two_hashes(vec: Column) -> list[Column]:
    return [F.xxhash64(vec), F.xxhash64(F.lit(1), vec)]


def synset_groups(cell: DataFrame) -> DataFrame:
    """Rows per synset and whether its vectors differ. Two 64-bit hashes stand for a vector,
    so no vector is shuffled to compare it."""
    a, b = _two_hashes(V.as_double(F.col("vec")))
    return cell.select("sense_key", a.alias("a"), b.alias("b")).groupBy("sense_key").agg(
        F.count("*").alias("rows"),
        ((F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))).alias("divergent"),
    )


def divergent_rows(cell: DataFrame) -> DataFrame:
    bad = synset_groups(cell).filter("divergent").select("sense_key")
    return cell.join(bad, "sense_key", "left_semi")


def synset_members(cell: DataFrame) -> DataFrame:
    """Distinct words of each synset; `member_pos` is the row where a word first appears.

    Kept as rows, not as an array: one synset may hold a large part of all words.
    """
    return cell.groupBy("sense_key", "word").agg(F.min("row").alias("member_pos"))


def collapse_synsets(cell: DataFrame, check: bool = True) -> DataFrame:
    """One row per synset: sense_key, row and word of the first member, vec."""
    if check:
        refuse_if_any(synset_groups(cell).filter("divergent"), "synsets with differing vectors")
    first = cell.groupBy("sense_key").agg(F.min("row").alias("row"))
    return first.join(cell.select("sense_key", "row", "word", "vec"), ["sense_key", "row"])


def collapse_report(cell: DataFrame, dim: int, short_dim: int) -> DataFrame:
    """Rows saved and payload sizes in MB for full, half and shortened half vectors."""
    counts = synset_groups(cell).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("synsets"),
        F.count_if(F.col("rows") > 1).alias("multi_row_synsets"),
        F.count_if("divergent").alias("divergent_synsets"),
    )
    rows, synsets = F.col("rows"), F.col("synsets")
    sizes = [
        V.payload_mb(n, d, b).alias(f"{name}_{label}_mb")
        for name, n in (("sense", rows), ("synset", synsets))
        for label, d, b in (("full", dim, 4), ("half", dim, 2), ("half_short", short_dim, 2))
    ]
    return counts.select(
        "*", (rows - synsets).alias("rows_saved"), ((rows - synsets) / rows).alias("saved_share"), *sizes
    )


def derive_vectors(cell: DataFrame, dims: int, half: bool = True) -> DataFrame:
    """Cut to `dims`, renormalise, and for `half` round to 16-bit floats and renormalise.

    `cut` keeps the vector before rounding for the drift report.
    """
    cut = cell.withColumn("cut", V.truncate(F.col("vec"), dims))
    if not half:
        return cut.withColumn("vec", F.col("cut"))
    return cut.withColumn("rounded", V.round_half(F.col("cut"))).withColumn(
        "vec", V.normalise(F.col("rounded"))
    )


def drift(derived: DataFrame) -> DataFrame:
    """How far rounding moved the vectors."""
    cos = V.dot(F.col("vec"), F.col("cut"))
    return derived.agg(
        F.max(V.max_abs_diff(F.col("rounded"), F.col("cut"))).alias("max_component_error"),
        F.avg(cos).alias("mean_cosine"), F.min(cos).alias("min_cosine"), F.count("*").alias("rows"),
    )


def derived_meta(meta: DataFrame, dims: int, half: bool) -> DataFrame:
    """Metadata of a derived cell: provenance carried over, name and precision new."""
    short = f"{'h' if half else 'f'}{dims}"
    return meta.withColumn("source_cell", F.col("cell")).withColumn(
        "cell", F.concat_ws("_", "cell", F.lit(short))
    ).withColumn("precision", F.lit("float16" if half else "float32")).withColumn(
        "dim", F.lit(dims)
    ).withColumn("payload_mb", V.payload_mb(F.col("rows"), dims, 2 if half else 4))


def size_violations(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows whose vector length is not the cell's dimension."""
    return cells.join(meta.select("cell", "dim"), "cell").filter(F.size("vec") != F.col("dim"))


def backfill_verdicts(meta: DataFrame, expected: DataFrame, pool_rows: DataFrame) -> DataFrame:
    """Per cell, what to do with its input fingerprint.

    `expected`: variant, want. `pool_rows`: representation, want_rows.
    """
    joined = meta.join(pool_rows, "representation", "left").join(expected, "variant", "left")
    same_pool = F.coalesce(F.col("rows") == F.col("want_rows"), F.lit(False))
    verdict = (
        F.when(~same_pool, "different pool")
        .when(F.col("want").isNull(), "unknown variant")
        .when(F.col("inputs_sha256").isNull(), "backfilled")
        .when(F.col("inputs_sha256") == F.col("want"), "matches")
        .otherwise("mismatch")
    )
    return joined.withColumn("verdict", verdict)


def apply_backfill(verdicts: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Metadata with input hashes filled in and, from `vectors` (cell, sha256), the hash of the vector bytes.

    A mismatch keeps what it has. The input hash is a check; the vector hash pins the bytes from now on.
    """
    filled = F.when(F.col("verdict").isin("backfilled", "matches"), F.col("want")).otherwise(F.col("inputs_sha256"))
    out = verdicts.withColumn("inputs_sha256", filled)
    if vectors is not None:
        before = F.col("vectors_sha256") if "vectors_sha256" in verdicts.columns else F.lit(None).cast("string")
        found = vectors.select("cell", F.col("sha256").alias("_found"))
        out = out.withColumn("_before", before).join(found, "cell", "left").withColumn(
            "vectors_sha256", F.when(F.col("verdict") == "mismatch", F.col("_before")).otherwise(F.coalesce("_found", "_before"))).drop("_before", "_found")
    return out.drop("want", "want_rows")


def pool_identity(cells: DataFrame, meta: DataFrame, pool: DataFrame, expected: DataFrame) -> DataFrame:
    """Is each cell built from this pool and from the texts it claims?

    `cells`: cell, word. `pool`: word. `expected`: cell, want.
    """
    words = cells.select("cell", "word").distinct()
    in_pool = pool.select("word").distinct().withColumn("pooled", F.lit(1))
    per_cell = words.join(in_pool, "word", "left").groupBy("cell").agg(
        F.count("*").alias("words"), F.count("pooled").alias("pooled")
    )
    joined = (
        meta.select("cell", "inputs_sha256").join(per_cell, "cell", "left").join(expected, "cell", "left")
        .withColumn("pool_words", pool.agg(F.countDistinct("word")).scalar())
    )
    same = (F.col("words") == F.col("pooled")) & (F.col("pooled") == F.col("pool_words"))
    verdict = (
        F.when(F.col("words").isNull(), "missing").when(~same, "stale: different pool")
        .when(F.col("inputs_sha256").isNull(), "stale: no input hash")
        .when(F.col("inputs_sha256") == F.col("want"), "fresh")
        .otherwise("stale: input hash mismatch")
    )
    return joined.select("cell", "words", "pooled", "pool_words", verdict.alias("verdict"))


def targets_present(targets: DataFrame, pool: DataFrame) -> DataFrame:
    known = pool.select("word").distinct().withColumn("_in", F.lit(1))
    return targets.join(known, "word", "left").agg(
        F.count("*").alias("targets"), F.count("_in").alias("present")
    )


def self_retrieval(cell: DataFrame, samples: DataFrame, by_sense: bool) -> DataFrame:
    """Query a cell with its own vectors. A miss at rank 1 means rows and vectors drifted.

    `samples`: word, sense_key, qvec. Sense cells are judged by synset, because the words
    of a synset share one vector.
    """
    keyed = samples.withColumn("qid", F.concat_ws("|", "word", "sense_key"))
    hits = S.exact_rows(keyed.select("qid", "qvec"), cell, 10)
    joined = keyed.select("qid", F.col("word").alias("want_word"), F.col("sense_key").alias("want_key")).join(
        hits, "qid", "left"
    )
    right = (F.col("sense_key") == F.col("want_key")) if by_sense else (F.col("word") == F.col("want_word"))
    exact = F.col("word") == F.col("want_word")
    per_query = joined.groupBy("qid").agg(
        F.max((right & (F.col("rank") == 1)).cast("int")).alias("pass"),
        F.max((exact & (F.col("rank") == 1)).cast("int")).alias("exact"),
        F.max(right.cast("int")).alias("top10"),
    )
    return per_query.agg(
        F.count("*").alias("n"), F.sum("pass").alias("rank1"), F.sum("exact").alias("exact_word_rank1"),
        F.sum("top10").alias("top10"),
    )


def hash_sample(rows: DataFrame, seed: str, n: int = SELF_SAMPLES) -> DataFrame:
    """n rows in seeded hash order of word and sense key."""
    return rows.orderBy(
        F.md5(F.concat_ws("|", F.lit(seed), "word", "sense_key")), "word", "sense_key"
    ).limit(n)
