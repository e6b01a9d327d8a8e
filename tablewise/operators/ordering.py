"""Exact order statistics and ranks that never sort a whole table in one task.

Quantiles are selected in two scans of the source. The first one sketches, for each wanted position, a value
below and one above it, between which about ``2 * MARGIN / accuracy`` of the rows lie. The second one keeps the distinct
values between them with their counts, and only counts the rest; what is kept is ordered. Nothing is written.

Ranks pre-aggregate the values to (value, count), which is written once, and cut into buckets of about
equal size whose edges come from a mergeable sketch. There is one way for inputs of every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablewise.functions.numeric import accurate_sum, finite
from tablewise.session import reliable_checkpoint, reused

BUCKETS = 256
SKETCH_ACCURACY = 2000
#: A sketch misses a rank by one part in its accuracy at most; brackets are wider, also by what rounding a position adds.
ACCURACY, MARGIN = 10_000, 5


def pack_keys(keys: Sequence[str]) -> Column:
    """Group keys as one struct: struct equality treats nulls as equal."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def value_counts_of(df: DataFrame, value: Column, keys: Sequence[str], count: Column | None = None) -> DataFrame:
    """(_k, _v, _n), written once. A null value is kept with a count of zero, so that no group is lost."""
    return reliable_checkpoint(
        df.select(pack_keys(keys).alias("_k"), value.alias("_v"), (F.lit(1) if count is None else count).cast("long").alias("_n"))
        .groupBy("_k", "_v").agg(F.sum("_n").alias("_n"))
        .withColumn("_n", F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n")))
    )


def _with_bucket(counts: DataFrame, edge_key: Column, buckets: int) -> DataFrame:
    """Bucket every value; edges are sketched per ``edge_key``, which must have few values."""
    steps = [i / buckets for i in range(1, buckets)]
    keyed = counts.withColumn("_e", edge_key)
    edges = keyed.groupBy("_e").agg(
        F.percentile_approx("_v", steps, SKETCH_ACCURACY).alias("_edges"), F.max("_n").alias("_max_n")
    ).where(F.col("_max_n") > 0).select("_e", "_edges")
    return (
        keyed.join(F.broadcast(edges), "_e")
        .withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_v"))))
        .drop("_edges", "_e")
    )


def _bucket_offsets(bucketed: DataFrame) -> DataFrame:
    """Rows before each bucket and in total, per key; at most ``buckets`` rows per key."""
    running = Window.partitionBy("_k").orderBy("_b")
    per_bucket = bucketed.groupBy("_k", "_b").agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_bd"), F.max("_v").alias("_top"))
    return per_bucket.select(
        "_k",
        "_b",
        "_bn",
        "_top",
        (F.sum("_bn").over(running) - F.col("_bn")).alias("_before"),
        (F.sum("_bd").over(running) - F.col("_bd")).alias("_distinct_before"),
        F.sum("_bn").over(Window.partitionBy("_k")).alias("_total"),
    )


def _marks(probabilities: Sequence[float], accuracy: int) -> list[float]:
    """For each probability one below and one above it."""
    apart = MARGIN / accuracy
    return [q for p in probabilities for q in (max(0.0, p - apart), min(1.0, p + apart))]


def _cell(value: Column, brackets: Sequence[tuple[Column, Column]]) -> Column:
    """Where a value lies: ``_b``, the number of brackets below it, and ``_w``, the value if it is inside of one."""
    inside, below = F.lit(False), F.lit(0)
    for low, high in brackets:
        inside, below = inside | ((value >= low) & (value <= high)), below + (value > high).cast("int")
    return F.struct(below.alias("_b"), F.when(inside, value).alias("_w"), value.alias("_v"))


def _counted(cells: DataFrame) -> DataFrame:
    """Rows (_k, _c) of cells as (_k, _b, _w, _v, _n): kept values one by one, those between two brackets as one row."""
    return cells.where(F.col("_c._v").isNotNull()).groupBy("_k", "_c._b", "_c._w").agg(F.max("_c._v").alias("_v"), F.count(F.lit(1)).alias("_n"))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), *, lower: bool = False, accuracy: int = ACCURACY
) -> DataFrame:
    """Exact quantiles per key as ``keys..., n, quantiles ARRAY<DOUBLE>``.

    Linear interpolation between neighbours by default; ``lower=True`` takes the element at
    index ``floor((n-1)·q)``. A group without values, and without keys an empty input, gives
    ``n`` 0 and null quantiles. The input is read twice; one that stands on several is materialised first.
    """
    rows = reused(df).select(pack_keys(keys).alias("_k"), finite(F.col(value)).alias("_v"))
    sketch = [F.count("_v").alias("n"), F.percentile_approx("_v", _marks(probabilities, accuracy), accuracy).alias("_m")]
    groups = rows.groupBy("_k").agg(*sketch) if keys else rows.agg(*sketch).select(pack_keys(()).alias("_k"), "*")
    # A group of few values keeps them all.
    few = F.col("n") <= accuracy
    bound = lambda at, all_: F.when(few, F.lit(all_)).otherwise(F.col("_m")[at])
    brackets = groups.select("_k", *[
        bound(2 * i + high, float("inf") if high else float("-inf")).alias(f"_{i}_{high}") for i in range(len(probabilities)) for high in (0, 1)])
    met = rows.join(brackets, "_k") if keys else rows.crossJoin(F.broadcast(brackets.drop("_k")))
    cell = _cell(F.col("_v"), [(F.col(f"_{i}_0"), F.col(f"_{i}_1")) for i in range(len(probabilities))])
    slots = _picked(_counted(met.select("_k", cell.alias("_c"))), probabilities)
    found = groups.join(slots, groups["_k"].eqNullSafe(slots["_k"]), "left")
    return found.select(
        *[groups[f"_k.{k}"].alias(k) for k in keys], F.col("n"), F.when(F.col("n") > 0, F.array(*_between(probabilities, lower))).alias("quantiles"))


def column_quantiles(
    df: DataFrame, values: dict[str, Column], probabilities: Sequence[float], extra: Sequence[Column] = (), accuracy: int = ACCURACY
) -> tuple[dict[str, list[float] | None], Row]:
    """Exact quantiles of several columns, by name, from two scans for all; with the row of ``extra`` aggregates from the first scan.

    The results are few numbers and come back to the driver. A column without values has none.
    """
    names = list(values)
    marks = _marks(probabilities, accuracy)
    sketches = [c for i, n in enumerate(names) for c in (F.count(values[n]).alias(f"_n{i}"), F.percentile_approx(values[n], marks, accuracy).alias(f"_m{i}"))]
    first = df.agg(*extra, *sketches).first()
    wide, known = (float("-inf"), float("inf")), []
    for i in range(len(names)):
        count, found = first[f"_n{i}"], first[f"_m{i}"]
        if count:
            ends = [wide] * len(probabilities) if count <= accuracy else list(zip(found[::2], found[1::2]))
            known.append(F.struct(F.lit(i).alias("_i"), *[F.lit(e).alias(f"_{p}_{high}") for p, pair in enumerate(ends) for high, e in enumerate(pair)]))
    if not known:
        return dict.fromkeys(names), first
    # One value a row before the comparisons: for all columns in one row, they would be too long a method to compile.
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), values[n].alias("_v")) for i, n in enumerate(names)])).alias("_x")).select("_x.*")
    brackets = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*known)).alias("_x")).select("_x.*")
    met = long.where(F.col("_v").isNotNull()).join(F.broadcast(brackets), "_i")
    cell = _cell(F.col("_v"), [(F.col(f"_{p}_0"), F.col(f"_{p}_1")) for p in range(len(probabilities))])
    rows = met.select(F.struct(F.col("_i").alias("i")).alias("_k"), cell.alias("_c"))
    slots = _picked(_counted(rows), probabilities)
    counts = F.element_at(F.array(*[F.lit(first[f"_n{i}"]).cast("long") for i in range(len(names))]), F.col("_k.i") + 1)
    picked = {r.i: list(r.q) for r in slots.withColumn("n", counts).select("_k.i", F.array(*_between(probabilities, False)).alias("q")).collect()}
    return {name: picked.get(i) for i, name in enumerate(names)}, first


def _between(probabilities: Sequence[float], lower: bool) -> list[Column]:
    """Each quantile from the two elements beside its place among ``n``."""
    values = []
    for index, probability in enumerate(probabilities):
        position = F.lit(float(probability)) * (F.col("n") - 1)
        low, high = F.col(f"_s{2 * index}"), F.col(f"_s{2 * index + 1}")
        values.append(low if lower else low + (high - low) * (position - F.floor(position)))
    return values


def _picked(bucketed: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(_k, _s0, _s1, ...) of (_k, _b, _w, _v, _n): the elements at and after each wanted place."""
    offsets = _bucket_offsets(bucketed)
    position = F.lit(0.0)
    targets = []
    for index, probability in enumerate(probabilities):
        position = F.lit(float(probability)) * (F.col("_total") - 1)
        targets.append(F.struct(F.lit(2 * index).alias("slot"), F.floor(position).alias("at")))
        targets.append(F.struct(F.lit(2 * index + 1).alias("slot"), F.ceil(position).alias("at")))
    wanted = offsets.select(
        "_k",
        "_b",
        "_before",
        "_top",
        F.filter(
            F.array(*targets),
            lambda t: (t["at"] >= F.col("_before")) & (t["at"] < F.col("_before") + F.col("_bn")),
        ).alias("_targets"),
    ).where(F.size("_targets") > 0)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v"))
    # Both sides of the join read all columns of the counts, so that Spark makes them once.
    picked = (
        bucketed.join(wanted, ["_k", "_b"])
        .where(F.col("_v") <= F.col("_top"))
        .withColumn("_upto", upto)
        .withColumn(
            "_hits",
            F.filter(
                "_targets",
                lambda t: (t["at"] >= F.col("_upto") - F.col("_n")) & (t["at"] < F.col("_upto")),
            ),
        )
        .select("_k", "_w", F.explode("_hits.slot").alias("_slot"))
    )
    value = F.coalesce("_w", F.raise_error(F.lit("a wanted place lies outside its bracket: the sketch missed it")).cast("double"))
    return picked.groupBy("_k").agg(*[
        F.max(F.when(F.col("_slot") == s, value)).alias(f"_s{s}") for s in range(2 * len(probabilities))
    ])


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), *, count: str | None = None, edge_key: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per distinct value: ``keys..., value, n, average_rank, dense_rank``.

    ``count`` names a column that says for how many rows a row stands.
    """
    counts = value_counts_of(df, finite(F.col(value)), keys, F.col(count) if count else None).where(F.col("_v").isNotNull())
    bucketed = _with_bucket(counts, F.col(f"_k.{edge_key}") if edge_key else F.lit(0), buckets)
    offsets = _bucket_offsets(bucketed).select("_k", "_b", "_before", "_distinct_before")
    inside = Window.partitionBy("_k", "_b").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(inside)
    dense = F.col("_distinct_before") + F.row_number().over(inside)
    return (
        bucketed.join(offsets, ["_k", "_b"])
        .select(
            *[F.col(f"_k.{k}").alias(k) for k in keys],
            F.col("_v").alias(value),
            F.col("_n").alias("n"),
            (upto - (F.col("_n") - 1) / 2.0).alias("average_rank"),
            dense.cast("bigint").alias("dense_rank"),
        )
    )


def row_numbers(
    df: DataFrame,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    *,
    output: str = "rank",
) -> DataFrame:
    """``row_number`` per key that holds up when one key, or no key, owns all the rows.

    The rows are range-partitioned on (keys, order), the partitions pinned with a written table,
    rows numbered inside each partition and the rows of earlier partitions added. ``order_by``
    must be a total order. An input behind joins is materialised first, since the sampling of
    range boundaries would otherwise compute it again.
    """
    named = reused(df).withColumn("_k", pack_keys(keys))
    sorted_parts = reliable_checkpoint(
        named.repartitionByRange(F.col("_k"), *order_by).withColumn("_part", F.spark_partition_id())
    )
    per_part = sorted_parts.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_part")
    offsets = per_part.select("_k", "_part", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_k", "_part").orderBy(*order_by)
    numbered = sorted_parts.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(offsets, ["_k", "_part"])
        .withColumn(output, (F.col("_before") + F.col("_row")).cast("bigint"))
        .drop("_k", "_part", "_before", "_row")
    )


def lag_in_chunks(
    df: DataFrame, keys: Sequence[str], order: str, value: str, output: str, chunk_width: int = 100_000
) -> DataFrame:
    """Previous ``value`` per key in ``order`` (an integer), computed chunk by chunk.

    Rows are windowed per (key, chunk of ``order``); the first row of a chunk takes the last
    value of the key's previous chunk, so no task sees a whole hot key.
    """
    chunked = df.withColumn("_c", F.floor(F.col(order) / chunk_width))
    inside = Window.partitionBy(*keys, "_c").orderBy(order)
    rows = chunked.withColumn("_prev", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    lasts = chunked.groupBy(*keys, "_c").agg(F.max_by(value, order).alias("_last"))
    carry = lasts.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_c"))
    ).drop("_last")
    return (
        rows.join(carry, [*keys, "_c"], "left")
        .withColumn(output, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_c", "_prev", "_first", "_carry")
    )


def top_share_sum(df: DataFrame, order: str, value: str, take: Column) -> DataFrame:
    """Sum and count of ``value`` over the last ``take`` rows by (order, value), and the rest.

    ``take`` is computed from ``n``. Rows are counted per distinct (moment, value); one looks for the moment where the count from the end is reached, and orders only the values of
    that one moment, so neither the table nor a tie on one moment ends up in one task.
    """
    rows = df.select(F.col(order).alias("_t"), F.col(value).alias("_x")).where(
        F.col("_t").isNotNull() & F.col("_x").isNotNull()
    )
    moments = rows.withColumn("_t", F.unix_micros(F.col("_t").cast("timestamp")).cast("double"))
    cells = reliable_checkpoint(moments.groupBy("_t", "_x").agg(F.count(F.lit(1)).alias("_n")))
    per_moment = reliable_checkpoint(
        cells.groupBy("_t").agg(F.sum("_n").alias("_n"), accurate_sum(F.col("_n") * F.col("_x")).alias("_sx"))
    )
    totals = per_moment.agg(
        F.sum("_n").alias("n"), accurate_sum(F.col("_sx")).alias("sum_all"), F.max("_t").alias("_t_last")
    ).withColumn("take", take.cast("bigint"))
    boundary = reliable_checkpoint(_kth_from_end(per_moment, "_t", totals.select(F.col("take").alias("_want"))))
    after = per_moment.crossJoin(F.broadcast(boundary.select(F.col("_t").alias("_edge")))).agg(
        accurate_sum(F.when(F.col("_t") > F.col("_edge"), F.col("_sx"))).alias("_after"), F.max("_edge").alias("_edge")
    )
    ties = reliable_checkpoint(
        cells.join(F.broadcast(boundary.select("_t")), "_t", "left_semi").select("_x", "_n", (F.col("_n") * F.col("_x")).alias("_sx"))
    )
    cut = reliable_checkpoint(_kth_from_end(ties, "_x", boundary.select(F.col("_rest").alias("_want"))))
    tied = ties.crossJoin(F.broadcast(cut.select(F.col("_x").alias("_cut"), F.col("_rest").alias("_at_cut")))).agg(
        accurate_sum(F.when(F.col("_x") > F.col("_cut"), F.col("_sx"))).alias("_above"),
        F.max(F.col("_cut") * F.col("_at_cut")).alias("_at"),
    )
    recent_sum = F.coalesce("_after", F.lit(0.0)) + F.coalesce("_above", F.lit(0.0)) + F.coalesce("_at", F.lit(0.0))

    def moment(name: str) -> Column:
        return F.timestamp_micros(F.col(name).cast("bigint")).cast(df.schema[order].dataType)

    return (
        totals.crossJoin(F.broadcast(after))
        .crossJoin(F.broadcast(tied))
        .where(F.col("n") > 0)
        .select(
            "n", "take", recent_sum.alias("recent_sum"), (F.col("sum_all") - recent_sum).alias("baseline_sum"),
            moment("_edge").alias("recent_from"), moment("_t_last").alias("recent_to"),
        )
    )


def _kth_from_end(counts: DataFrame, value: str, want: DataFrame) -> DataFrame:
    """The value at which the count from the top reaches ``_want``; ``_rest`` still needed there."""
    base = counts.select(F.struct(F.lit(0).alias("_all")).alias("_k"), F.col(value).alias("_v"), "_n")
    bucketed = _with_bucket(base, F.lit(0), BUCKETS)
    offsets = (
        _bucket_offsets(bucketed)
        .crossJoin(F.broadcast(want))
        .withColumn("_at", F.col("_total") - F.col("_want"))
        .where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_bn")))
    )
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v"))
    return (
        bucketed.join(F.broadcast(offsets), ["_k", "_b"])
        .withColumn("_upto", upto)
        .where((F.col("_at") >= F.col("_upto") - F.col("_n")) & (F.col("_at") < F.col("_upto")))
        .select(F.col("_v").alias(value), (F.col("_upto") - F.col("_at")).alias("_rest"))
    )
