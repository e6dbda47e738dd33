"""Row numbers, order statistics and rolling counts that do not put a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexspan.session import freeze

_HASH_PREFIX = 5
_POSITION_BITS = 33
_SKETCH = 10_000
# Values that one bracket may order; a wider one is narrowed again, by steps of a grid.
_WINDOW = 1_000_000
_GRID = 256


def number_by_hash(df: DataFrame, hashed: Column, ties: list[str], out: str = "row") -> DataFrame:
    """Dense 0-based numbers in the order of a hex hash.

    Rows are numbered inside the buckets of a hash prefix, and the sizes of the at most
    16 ** 5 buckets give each bucket its offset.
    """
    keyed = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, _HASH_PREFIX))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h", *ties)) - 1
    numbered = keyed.withColumn("_p", place).join(F.broadcast(offsets), "_b")
    return numbered.withColumn(out, (F.col("_o") + F.col("_p")).cast("long")).drop("_h", "_b", "_p", "_o")


def number_by_order(df: DataFrame, order: list[str], out: str = "row") -> DataFrame:
    """Dense 0-based numbers in a total order, by one range-partitioned sort.

    The sorted rows are written once, so a lost executor cannot shift the numbers. End
    `order` with a unique column, and equal values can be split between partitions.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = freeze(
        df.repartitionByRange(slots, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(at, _POSITION_BITS))
        .withColumn("_pos", at.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_o") + F.col("_pos")).drop("_part", "_pos", "_o")


def order_statistics(
    df: DataFrame, groups: list[str], value: str, picks: dict[str, tuple[float, Column]]
) -> DataFrame:
    """Exact values at given positions of each group's sorted values.

    `picks` maps an output name to (fraction, position), the 0-based position being an
    expression of the group size `n`. A quantile sketch with a guaranteed rank error
    brackets each position; a bracket that could hold many values is narrowed by further
    sketches of its inside; only values inside the bracket are counted and ordered.
    """
    eps = 4.0 / _SKETCH
    bounds = [b for f, _ in picks.values() for b in (max(0.0, f - eps), min(1.0, f + eps))]
    key = "_g"
    named = df.filter(F.col(value).isNotNull()).select(
        F.struct(*groups, F.lit(0).alias("_")).alias(key), F.col(value).alias("_v")
    )
    stats = freeze(named.groupBy(key).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, _SKETCH).alias("_q"),
    ))

    def bracket(i: int, name: str, position: Column) -> Column:
        small = F.col("n") <= _SKETCH
        return F.struct(
            F.lit(name).alias("pick"), position.cast("long").alias("position"),
            F.when(small, F.col("_min")).otherwise(F.element_at("_q", 2 * i + 1)).alias("lo"),
            F.when(small, F.col("_max")).otherwise(F.element_at("_q", 2 * i + 2)).alias("hi"),
        )

    wanted = stats.select(key, "n", F.explode(F.array(
        *[bracket(i, name, pos) for i, (name, (_, pos)) in enumerate(picks.items())]
    )).alias("w")).select(key, "n", "w.*")
    # A bracket takes up 2 * eps of its group, and the sketch errs by eps / 4 on both sides.
    if not stats.filter(F.col("n") > max(_SKETCH, _WINDOW / (2.5 * eps))).isEmpty():
        wanted = _narrowed(named, wanted, key)
    marked = named.join(wanted, key)
    below = F.col("_v") < F.col("lo")
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    counted = (
        marked.filter(below | inside)
        .groupBy(key, "n", "pick", "position", F.when(inside, F.col("_v")).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    # The null value stands for everything below the bracket and sorts first.
    running = F.sum("c").over(W.partitionBy(key, "pick").orderBy(F.asc_nulls_first("v")))
    hit = counted.withColumn("_run", running).filter(
        (F.col("_run") > F.col("position")) & (F.col("_run") - F.col("c") <= F.col("position"))
    )
    out = hit.groupBy(key, "n").agg(
        *[F.max(F.when(F.col("pick") == name, F.col("v"))).alias(name) for name in picks]
    )
    # A position that no value hits would be a wrong bracket; that fails instead of losing the group.
    checked = stats.select(key, "n").join(out.drop("n"), key, "left")
    found = [F.coalesce(F.col(name), F.raise_error(F.lit(f"no value at the position of {name}"))).alias(name) for name in picks]
    return checked.select(*[F.col(f"{key}.{g}").alias(g) for g in groups], "n", *found)


def _narrowed(named: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Brackets that hold at most _WINDOW different values each, or one value."""
    inside = F.when((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")), F.col("_v"))
    grid = [i / _GRID for i in range(_GRID + 1)]
    wide = F.col("values") > _WINDOW
    while True:
        seen = named.join(wanted, key).groupBy(key, "pick").agg(
            F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count(inside).alias("inside"),
            F.approx_count_distinct(inside).alias("values"), F.percentile_approx(inside, grid, 10_000).alias("_q"))
        # The rank error of a sketch is far below a step of the grid, so a step on both sides is safe.
        part = (F.col("position") - F.col("below")) / F.col("inside") * _GRID
        low = F.element_at("_q", (F.greatest(F.lit(0), F.floor(part) - 1) + 1).cast("int"))
        high = F.element_at("_q", (F.least(F.lit(_GRID), F.ceil(part) + 1) + 1).cast("int"))
        found = wanted.join(seen, [key, "pick"])
        smaller = wide & ((low > F.col("lo")) | (high < F.col("hi")))
        after = freeze(found.select(key, "n", "pick", "position", F.when(wide, low).otherwise(F.col("lo")).alias("lo"),
                                    F.when(wide, high).otherwise(F.col("hi")).alias("hi"), smaller.alias("smaller")))
        wanted = after.drop("smaller")
        if after.filter("smaller").isEmpty():
            return wanted


def percentile_pick(p: float) -> tuple[float, Column]:
    """Position min(n - 1, floor(p / 100 * n))."""
    return p / 100, F.least(F.col("n") - 1, F.floor(F.lit(p / 100) * F.col("n")))


def part_pick(num: int, den: int) -> tuple[float, Column]:
    """Position floor(num * n / den)."""
    return num / den, F.floor(F.col("n") * num / den)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def counts_in_span(
    events: DataFrame, probes: DataFrame, keys: list[str], span_us: int, bucket_us: int,
    out: str = "in_span",
) -> DataFrame:
    """For each probe, the number of events of its key in (at - span, at].

    Both sides carry `keys` and `at` (microseconds); probes also carry a unique `probe`.
    A count is the difference of two running counts, and a running count is the total of
    the earlier time buckets plus the place inside its own. Work is linear in the rows,
    and a busy key is split by bucket.
    """
    marks = events.select(*keys, "at", F.lit(1).alias("weight"), F.lit(0).alias("sign"),
                          F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    ends = probes.select(
        *keys, "probe",
        F.explode(F.array(
            F.struct(F.col("at").alias("at"), F.lit(1).alias("sign")),
            F.struct((F.col("at") - span_us).alias("at"), F.lit(-1).alias("sign")),
        )).alias("m"),
    ).select(*keys, "m.at", F.lit(0).alias("weight"), "m.sign", "probe")
    both = marks.unionByName(ends).withColumn("bucket", F.floor(F.col("at") / bucket_us))
    # Events come before probes of the same instant: the span includes its right end.
    inside = W.partitionBy(*keys, "bucket").orderBy("at", F.desc("weight")).rowsBetween(W.unboundedPreceding, 0)
    local = both.withColumn("local", F.sum("weight").over(inside)).filter("sign <> 0")
    totals = both.groupBy(*keys, "bucket").agg(F.sum("weight").alias("total"))
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    signed = local.join(base, [*keys, "bucket"]).select(
        "probe", (F.col("sign") * (F.col("base") + F.col("local"))).alias("part")
    )
    return probes.join(signed.groupBy("probe").agg(F.sum("part").alias(out)), "probe")
