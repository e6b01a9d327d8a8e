"""Recommendation candidates, recommendation ranking and decision ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.numeric import clamp
from tablewise.operators.joins import lookup_join
from tablewise.operators.ordering import row_numbers

# Weights, penalties and priorities of the ranking policies.
CONFIDENCE_WEIGHT, EVIDENCE_WEIGHT, URGENCY_WEIGHT = 0.5, 0.3, 0.2
DECISION_BASE, DECISION_EVIDENCE, DECISION_SOURCE = 0.35, 0.5, 0.15
RISKS = ("low", "medium", "high", "critical")
RISK_PENALTY = {"low": 0.0, "medium": 0.08, "high": 0.2, "critical": 0.4}
SOURCE_PRIORITY = {"strategy": 0.55, "anomaly": 0.65, "root_cause": 0.85, "recommendation": 1.0}
CANDIDATE_URGENCY = {"high": 0.9, "medium": 0.55, "low": 0.25}
STEP_URGENCY = {"high": 0.9, "medium": 0.5, "low": 0.2}
MINIMUM_CONFIDENCE = 0.35
MINIMUM_DECISION_SCORE = 0.4
ANOMALY_CONFIDENCE, CAUSE_CONFIDENCE, STEP_CONFIDENCE = 0.72, 0.68, 0.65


def _lookup(values: dict[str, float], key: Column, default: float = 0.0) -> Column:
    table = F.create_map(*[F.lit(item) for pair in values.items() for item in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def _risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk)


def _candidates(df: DataFrame, source: str, action: Column, priority: Column, confidence: Column, risk: str, urgency: dict) -> DataFrame:
    """Candidates with an id hashed over source and action."""
    identifier = F.concat(F.lit(f"{source}:"), F.substring(F.sha2(F.concat(F.lit(f"{source}|"), F.col("action")), 256), 1, 16))
    return df.select(action.alias("action"), priority.alias("_p"), clamp(confidence.cast("double")).alias("confidence")).where(
        F.coalesce(F.trim("action"), F.lit("")) != ""
    ).select(
        identifier.alias("candidate_id"), "action", "confidence", F.col("confidence").alias("evidence_strength"),
        _lookup(urgency, F.col("_p"), urgency["medium"]).alias("urgency"), F.lit(risk).alias("risk"),
        F.lit("general").alias("domain"), F.lit(source).alias("source"),
    )


def candidate_build(
    steps: DataFrame | None = None, strategy: DataFrame | None = None, anomalies: DataFrame | None = None,
    causes: DataFrame | None = None,
) -> DataFrame:
    """Candidates of experience steps (``step, priority, confidence``), strategy steps (same),
    anomaly records and causes; equal ids collapse to the most confident, most urgent one."""
    parts = []
    if steps is not None:
        parts.append(_candidates(steps, "experience", F.trim("step"), F.col("priority"), F.col("confidence"), "low", STEP_URGENCY))
    if strategy is not None:
        parts.append(_candidates(
            strategy, "strategy", F.trim("step"), F.col("priority"), F.coalesce("confidence", F.lit(STEP_CONFIDENCE)), "low", CANDIDATE_URGENCY
        ))
    if anomalies is not None:
        action = F.concat(F.lit("Validate anomaly "), F.col("anomaly_type"), F.lit(" on "), F.coalesce("affected_column", F.lit("metric")))
        priority = F.when(F.col("severity").isin("high", "critical"), "high").otherwise("medium")
        parts.append(_candidates(anomalies, "anomaly", action, priority, F.lit(ANOMALY_CONFIDENCE), "medium", CANDIDATE_URGENCY))
    if causes is not None:
        action = F.concat(F.lit("Investigate root cause: "), F.col("title"))
        parts.append(_candidates(causes, "root_cause", action, F.lit("high"), F.lit(CAUSE_CONFIDENCE), "medium", CANDIDATE_URGENCY))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    rest = [c for c in united.columns if c != "candidate_id"]
    best = united.groupBy("candidate_id").agg(F.max_by(F.struct(*rest), F.struct("confidence", "urgency")).alias("_b"))
    return best.select("candidate_id", "_b.*")


def recommend_rank(
    candidates: DataFrame, *, domain: str = "general", context: str | None = None, minimum_confidence: float = MINIMUM_CONFIDENCE,
    maximum_risk: str = "critical", limit: int = 5, keys: Sequence[str] = (),
) -> DataFrame:
    """Admissible candidates by score: ``rank, candidate_id, action, score, priority, ...``.

    ``keys`` (a tenant or run) ranks separately; only the best ``limit`` per key leave a task.
    """
    fits = (
        (F.col("confidence") >= minimum_confidence)
        & (_risk_rank(F.col("risk")) <= RISKS.index(maximum_risk) + 1)
        & F.col("domain").isin("general", domain)
    )
    if "contexts" in candidates.columns:
        anywhere = F.col("contexts").isNull() | (F.size("contexts") == 0)
        fits = fits & (anywhere | (F.array_contains("contexts", context) if context else F.lit(False)))
    score = F.round(clamp(
        F.col("confidence") * CONFIDENCE_WEIGHT + F.col("evidence_strength") * EVIDENCE_WEIGHT + F.col("urgency") * URGENCY_WEIGHT
        - _lookup(RISK_PENALTY, F.col("risk"))
    ), 4)
    best = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("score"), "risk", "candidate_id")
    ranked = candidates.where(fits).withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    priority = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.45, "medium").otherwise("low")
    return ranked.withColumn("priority", priority)


def decision_evidence(options: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per option: listed, present and missing evidence, and the mean evidence score.

    ``options``: ``option_id, evidence_ids``; ``evidence``: ``evidence_id, strength, reliability, confidence``.
    """
    listed = options.select("option_id", F.explode_outer("evidence_ids").alias("_eid"))
    scored = evidence.select("evidence_id", (F.col("strength") * F.col("reliability") * F.col("confidence")).alias("_score"))
    joined = lookup_join(listed, scored, "_eid", "evidence_id", "left")
    return joined.groupBy("option_id").agg(
        F.count("_eid").alias("listed"), F.count("_score").alias("present"),
        F.count_if(F.col("_eid").isNotNull() & F.col("_score").isNull()).alias("missing"),
        F.round(F.avg("_score"), 4).alias("evidence_score"),
    )


def decision_scores(options: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every option with its score and whether it is kept."""
    judged = options.join(decision_evidence(options, evidence), "option_id")
    adjusted = F.col("evidence_score") * F.col("present") / F.col("listed")
    score = F.round(clamp(
        F.col("base_confidence") * DECISION_BASE + adjusted * DECISION_EVIDENCE
        + _lookup(SOURCE_PRIORITY, F.col("source")) * DECISION_SOURCE - _lookup(RISK_PENALTY, F.col("risk"))
    ), 4)
    kept = (F.col("present") > 0) & (F.col("score") >= MINIMUM_DECISION_SCORE)
    return judged.withColumn("score", F.when(F.col("present") > 0, score)).withColumn("kept", F.coalesce(kept, F.lit(False)))


def decision_rank(
    options: DataFrame, evidence: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Kept options by score, source and id; empty means abstain. Ranks every option, however many."""
    kept = decision_scores(options, evidence).where("kept").drop("kept", "evidence_ids")
    return row_numbers(kept, [F.desc("score"), F.col("source"), F.col("option_id")], keys)
