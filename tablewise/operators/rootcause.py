"""Root-cause candidates: related anomalies grouped, scored and ranked, for one analysis or for many.

Two anomalies of an analysis are related when they share a column, a period or a type, when their
severities are at most one step apart, or when both are trend-like. Equal severity alone relates two
anomalies, so all anomalies of one severity fall in the same component, and the components of
any number of anomalies are the components of a graph on the four severities.

One aggregation reads the anomalies: for each analysis and each property that can relate anomalies it
keeps how many have it and at which severities, as bits. It combines before the shuffle, so an
analysis that holds most anomalies sends a row for each property and task, and the rest works on that
small table. ``keys`` name the columns that tell analyses apart (a run, a tenant, a table); null is a
value of its own. Without keys all anomalies are one analysis.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.dates import period_key, period_range_key
from tablewise.functions.numeric import clamp, severity_name, severity_rank
from tablewise.operators.ordering import row_numbers
from tablewise.session import reliable_checkpoint

TREND_TERMS = ("trend", "spike", "change", "degradation", "drift")
LEVELS = (1, 2, 3, 4)
# Pairs of severities, one bit each.
PAIRS = tuple(combinations(LEVELS, 2))
# Relationship reasons in reporting order.
REASONS = (
    "same_column", "same_or_similar_period", "same_anomaly_type", "similar_severity", "trend_or_degradation_signal",
)


def normalized_anomalies(anomalies: DataFrame) -> DataFrame:
    """Adds severity rank, period key and trend flag to anomaly records; a missing type is ``unknown``."""
    period = F.coalesce(F.col("affected_period"), F.lit(""))
    parts = F.split(period, "/")
    key = F.when(F.size(parts) == 2, period_range_key(parts[0], parts[1])).otherwise(period_key(period))
    kind = F.coalesce(F.nullif(F.col("anomaly_type"), F.lit("")), F.lit("unknown"))
    return (
        anomalies.withColumn("anomaly_type", kind)
        .withColumn("_level", severity_rank(F.col("severity")))
        .withColumn("_period_key", key)
        .withColumn("_column", F.trim(F.coalesce("affected_column", F.lit(""))))
        .withColumn("_trend", F.col("anomaly_type").rlike("|".join(TREND_TERMS)))
    )


def _by_bits(value, bits: Column, size: int) -> Column:
    """``value(number)`` of a number below ``size``, from a table of constants."""
    return F.element_at(F.array(*[value(number) for number in range(size)]), bits.cast("int") + 1)


def _levels_in(mask: int) -> list[int]:
    return [level for level in LEVELS if mask >> (level - 1) & 1]


def _pairs_of(mask: int, near: bool = False) -> int:
    """Bits of the pairs among the severities of a mask; only of neighbouring ones if ``near``."""
    present = set(_levels_in(mask))
    return sum(1 << i for i, (a, b) in enumerate(PAIRS) if {a, b} <= present and (b - a == 1 or not near))


def _component_labels(pairs: int) -> list[int]:
    """For each severity the smallest one that the given pairs connect it to."""
    label = {level: level for level in LEVELS}
    for _ in LEVELS:
        for i, (a, b) in enumerate(PAIRS):
            if pairs >> i & 1:
                label[a] = label[b] = min(label[a], label[b])
    return [label[level] for level in LEVELS]


def _properties(anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, reason, key, members, levels`` of every property that can relate anomalies of an analysis.

    ``levels`` has a bit for each severity. Rows of ``similar_severity``, one for each severity present, also carry
    sums over their anomalies: of confidence, and of hashes of ids.
    """
    def entry(reason: str, key: Column, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(reason).alias("reason"), key.cast("string").alias("key")))

    entries = F.array_compact(F.array(
        entry("same_column", F.col("_column"), F.col("_column") != ""),
        entry("same_or_similar_period", F.col("_period_key"), F.col("_period_key") != ""),
        entry("same_anomaly_type", F.col("anomaly_type"), F.lit(True)),
        entry("similar_severity", F.col("_level"), F.lit(True)),
        entry("trend_or_degradation_signal", F.lit("trend"), F.col("_trend")),
    ))
    own = lambda value: F.when(F.col("_e.reason") == "similar_severity", value)
    identity = F.xxhash64("anomaly_id")
    rows = normalized_anomalies(anomalies)
    if "confidence_score" not in anomalies.columns:
        rows = rows.withColumn("confidence_score", F.lit(0.0))
    return (
        rows.select(*keys, "_level", "anomaly_id", "confidence_score", F.explode(entries).alias("_e"))
        .groupBy(*keys, F.col("_e.reason").alias("reason"), F.col("_e.key").alias("key"))
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.bit_or(F.element_at(F.array(*[F.lit(1 << level - 1) for level in LEVELS]), F.col("_level"))).alias("levels"),
            F.sum(own(F.coalesce("confidence_score", F.lit(0.0)))).alias("confidence"),
            F.sum(own(identity.cast("decimal(38,0)"))).alias("id_sum"),
            F.bit_xor(own(identity)).alias("id_xor"),
        )
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys, nulls included, with the columns of both sides once."""
    right = right.select(*[F.col(f"`{k}`").alias(f"_same_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    equal = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_same_{i}")) for i, k in enumerate(keys)])
    return left.join(right, equal, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def _with_labels(rows: DataFrame, properties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_labels``: for each severity of their analysis the lowest one of its component."""
    near = F.col("reason") == "similar_severity"
    size = 1 << len(LEVELS)
    met = properties.groupBy(*keys).agg(
        F.bit_or(F.when(~near, _by_bits(lambda m: F.lit(_pairs_of(m)), F.col("levels"), size))).alias("_met"),
        F.bit_or(F.when(near, F.col("levels"))).alias("_present"),
    )
    pairs = F.col("_met").bitwiseOR(_by_bits(lambda m: F.lit(_pairs_of(m, near=True)), F.col("_present"), size))
    constants = lambda p: F.array(*[F.lit(label) for label in _component_labels(p)])
    labels = met.select(*keys, _by_bits(constants, pairs, 1 << len(PAIRS)).alias("_labels"))
    # Without keys there is one analysis and so one row of labels.
    return _same(rows, labels, keys) if keys else rows.crossJoin(F.broadcast(labels))


def rca_members(anomalies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every anomaly with ``component``, the lowest severity level its group reaches.

    The anomalies are read twice. An analysis of very many is left to the adaptive skew join.
    """
    labelled = _with_labels(normalized_anomalies(anomalies), _properties(anomalies, keys), keys)
    return labelled.withColumn("component", F.element_at("_labels", F.col("_level"))).drop("_labels")


def rca_components(anomalies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group of related anomalies; an analysis has at most four.

    Lists hold distinct columns, months, types and reasons. Member ids stay in
    ``rca_members``; the group id is a hash of the keys, of the members' count and order-free hash sums. The
    anomalies are read once, and their reduction is written.
    """
    properties = reliable_checkpoint(_properties(anomalies, keys))
    lowest = _by_bits(lambda m: F.lit(min(_levels_in(m), default=1)), F.col("levels"), 1 << len(LEVELS))
    labelled = _with_labels(properties, properties, keys).withColumn("component", F.element_at("_labels", lowest))
    of = lambda reason, value: F.when(F.col("reason") == reason, value)
    severity, distinct = "similar_severity", lambda reason: F.array_sort(F.collect_set(of(reason, F.col("key"))))
    present = F.bit_or(of(severity, F.col("levels")))
    repeated = {r: F.coalesce(F.max(of(r, F.col("members") > 1)), F.lit(False)) for r in REASONS}
    repeated[severity] = repeated[severity] | (present.bitwiseAND(F.shiftright(present, 1)) != 0)
    count = F.sum(of(severity, F.col("members")))
    identity = F.concat_ws(
        "|", *([F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"})] if keys else []),
        F.col("anomaly_count").cast("string"), F.col("_id_sum").cast("string"), F.col("_id_xor").cast("string"),
    )
    return labelled.groupBy(*keys, "component").agg(
        count.alias("anomaly_count"),
        severity_name(F.max(of(severity, F.col("key").cast("int")))).alias("severity"),
        F.round(F.sum("confidence") / count, 4).alias("confidence_score"),
        distinct("same_column").alias("affected_metrics"),
        distinct("same_or_similar_period").alias("affected_periods"),
        distinct("same_anomaly_type").alias("anomaly_types"),
        F.array_compact(F.array(*[F.when(repeated[r], r) for r in REASONS])).alias("relationship_reasons"),
        F.sum("id_sum").alias("_id_sum"), F.bit_xor("id_xor").alias("_id_xor"),
    ).withColumn("group_id", F.concat(F.lit("rca-group-"), F.substring(F.sha1(identity), 1, 10))).drop("_id_sum", "_id_xor")


def cause_title(types: Column, metrics: Column) -> Column:
    """Title by the most telling anomaly type of the group."""
    named = F.when(F.size(metrics) > 0, F.array_join(metrics, ", ")).otherwise("unspecified metric")
    temporary = F.array_contains(types, "time_series_spike") | F.array_contains(types, "sudden_change")
    return (
        F.when(F.array_contains(types, "performance_degradation"), F.concat(F.lit("Possible operational degradation on "), named))
        .when(F.array_contains(types, "sla_violation"), F.concat(F.lit("Possible systematic SLA breach on "), named))
        .when(temporary, F.concat(F.lit("Possible temporary operational event on "), named))
        .when(F.array_contains(types, "numeric_outlier"), F.concat(F.lit("Possible extreme value on "), named))
        .otherwise(F.concat(F.lit("Possible common cause on "), named))
    )


def cause_actions(types: Column) -> Column:
    """Checks suggested by the anomaly types, then the general ones."""
    def when_type(name: str, action: str) -> Column:
        return F.when(F.array_contains(types, name), F.lit(action))

    return F.array_compact(F.array(
        when_type("numeric_outlier", "Separate data errors from real extreme values"),
        when_type("time_series_spike", "Compare the peak with capacity, backlog and external events"),
        when_type("sudden_change", "Compare with the previous period and check for process changes"),
        when_type("performance_degradation", "Compare the recent decline with volume, capacity and releases"),
        when_type("baseline_drift", "Check whether the drift is expected from the population"),
        when_type("sla_violation", "Review the records beyond the threshold and their priority"),
        F.lit("Validate the evidence with the process and data owners"),
        F.lit("Compare the anomalous window with the historical baseline"),
        F.lit("Keep evidence, hypothesis and recommendation apart"),
    ))


def rca_causes(
    anomalies: DataFrame, profiled_columns: DataFrame | None = None, extra_evidence: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """A cause per group with its evidence count and confidence, the columns of ``keys`` first.

    Every anomaly is one piece of evidence; so is every affected column present in
    ``profiled_columns`` (``column``), plus ``extra_evidence`` context items (thresholds,
    strategy steps, patterns).
    """
    groups = rca_components(anomalies, keys)
    evidence = F.col("anomaly_count") + F.lit(extra_evidence)
    if profiled_columns is not None:
        groups = reliable_checkpoint(groups)
        profiled = profiled_columns.select("column").distinct()
        known = (
            groups.select(*keys, "component", F.explode("affected_metrics").alias("column"))
            .join(profiled, "column", "left_semi")
            .groupBy(*keys, "component")
            .agg(F.count(F.lit(1)).alias("_profiled"))
        )
        groups = _same(groups, known, [*keys, "component"], "left")
        evidence = evidence + F.coalesce("_profiled", F.lit(0))
    bonus = F.least(F.lit(0.2), F.greatest(F.lit(0), F.col("evidence_count") - 1) * 0.03)
    confidence = clamp(F.col("confidence_score") + bonus + severity_rank(F.col("severity")) * 0.03, 0.0, 0.99)
    return groups.withColumn("evidence_count", evidence).select(
        *keys,
        F.concat(F.lit("cause-"), F.substring(F.sha1(F.concat_ws("|", "group_id", "evidence_count")), 1, 10)).alias("cause_id"),
        "group_id",
        cause_title(F.col("anomaly_types"), F.col("affected_metrics")).alias("title"),
        "severity",
        F.round(confidence, 4).alias("confidence_score"),
        "affected_metrics",
        "anomaly_types",
        "relationship_reasons",
        "anomaly_count",
        "evidence_count",
        cause_actions(F.col("anomaly_types")).alias("recommended_actions"),
    )


def rca_rank(causes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Causes by severity, confidence and evidence, ranked per ``keys`` (a run or tenant)."""
    order = [
        severity_rank(F.col("severity")).desc(), F.desc("confidence_score"), F.desc("evidence_count"), F.col("cause_id"),
    ]
    return row_numbers(causes, order, keys or [])


def rca_related(anomalies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How strongly anomalies of an analysis hang together: per shared property, members and related pairs.

    Pairs are counted from the group sizes, never listed.
    """
    properties = reliable_checkpoint(_properties(anomalies, keys))
    near = F.col("reason") == "similar_severity"
    per_level = properties.where(near).groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("key") == str(level), F.col("members"))), F.lit(0)).alias(f"_n{level}") for level in LEVELS
    ])
    pairs = sum((F.expr(f"_n{level} * (_n{level} - 1) div 2") for level in LEVELS), F.lit(0))
    for level in LEVELS[:-1]:
        pairs = pairs + F.col(f"_n{level}") * F.col(f"_n{level + 1}")
    severity_pairs = per_level.select(
        *keys, F.lit("similar_severity").alias("reason"), F.lit("adjacent").alias("key"),
        sum((F.col(f"_n{level}") for level in LEVELS[1:]), F.col("_n1")).alias("members"), pairs.cast("bigint").alias("related_pairs"),
    )
    shared = properties.where(~near & (F.col("members") > 1))
    return shared.select(*keys, "reason", "key", "members", F.expr("members * (members - 1) div 2").alias("related_pairs")).unionByName(severity_pairs)
