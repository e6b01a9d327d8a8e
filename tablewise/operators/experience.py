"""Similar runs, recurring patterns and reusable experience mined from run lineage.

Experience is kept as two tables so that no record has to hold an unbounded list:
``headers`` (experience_id, kind, key, confidence, evidence_count, updated_at) and ``items``
(experience_id, item_kind, value) with item kinds metric, column, anomaly, root_cause, step
and tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.jsonfn import property_value
from tablewise.functions.numeric import clamp, shape_similarity
from tablewise.functions.text import keyword_tokens, label_slug
from tablewise.operators.graph import lineage
from tablewise.operators.joins import lookup_join
from tablewise.operators.ordering import row_numbers
from tablewise.session import reliable_checkpoint

# Words ignored in run keywords.
KEYWORD_STOPWORDS = (
    "a", "ad", "agli", "ai", "al", "alla", "alle", "analisi", "analizza", "analysis", "anche", "che", "col",
    "come", "con", "da", "dato", "dati", "dei", "del", "della", "delle", "di", "ed", "e", "gli", "ha", "hanno", "i",
    "il", "in", "la", "le", "lo", "metric", "nel", "nella", "nelle", "non", "o", "per", "piu", "quale", "quali", "su",
    "the", "this", "tra", "un", "una",
)
# Insights that describe strategies and reports.
STRATEGY_LABELS = (
    "operational_recommendations", "trend_analysis", "anomaly_analysis", "segmentation_analysis", "knowledge_analysis_steps",
)
REPORT_LABELS = ("analysis_report", "local_final_report")
# Weights of run similarity and of experience matching.
SIMILARITY_WEIGHTS = {
    "columns": 0.26, "primary_metric": 0.20, "time_axis": 0.12, "source_type": 0.10, "roles": 0.14, "shape": 0.10,
    "keywords": 0.08,
}
MATCH_WEIGHTS = {"metric": 0.35, "column": 0.2, "anomaly": 0.2, "root_cause": 0.15, "tag": 0.1}
# Words that make a root cause an infrastructure matter.
INFRASTRUCTURE_TERMS = ("performance", "degradation", "degrad", "infrastr", "backlog", "capacity", "laten")
# Step texts.
STEP_TREND = "Analizzare il trend temporale di {metric} su {time_axis}"
STEP_PERCENTILES = "Calcolare percentili e distribuzione di {metric}"
STEP_OUTLIERS = "Eseguire un controllo outlier sulla metrica primaria"
STEP_SEGMENTS = "Applicare una segmentazione per isolare i cluster anomali"
STEP_INFRASTRUCTURE = "Eseguire una verifica infrastrutturale mirata"
STEP_COMPARE = "Confrontare distribuzione, segmentazione e segnali ricorrenti emersi nelle analisi"
# Confidence of an experience from n runs: base and increment per kind.
EXPERIENCE_CONFIDENCE = {"metric": (0.45, 0.12), "anomaly": (0.40, 0.15), "root_cause": (0.42, 0.15)}


def _clean(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def _prop(name: str) -> Column:
    return property_value(F.col("properties"), name)


def run_table(nodes: DataFrame) -> DataFrame:
    """Runs with the properties the miners use as columns."""
    return nodes.where(F.col("type") == "analysis_run").select(
        F.col("id").alias("run_id"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce(_prop("created_at"), F.lit("")).alias("created_at"),
        F.trim(F.coalesce(_prop("primary_metric"), F.lit(""))).alias("primary_metric"),
        F.trim(F.coalesce(_prop("time_axis"), F.lit(""))).alias("time_axis"),
        _clean(_prop("source_type")).alias("source_type"), F.coalesce(_prop("user_input"), F.lit("")).alias("user_input"),
        _prop("row_count").try_cast("bigint").alias("row_count"), _prop("column_count").try_cast("bigint").alias("column_count"),
    )


def _overlaps(values: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Jaccard of each run's distinct values of a part (``run_id, part, value``) with a fixed list for it, from two counts for each part."""
    counts, scores = [], []
    for part, listed in wanted.items():
        chosen = sorted({w.strip().lower() for w in listed if w and w.strip()})
        of_part = F.col("part") == part
        hit = F.count_if(of_part & F.col("value").isin(*chosen)) if chosen else F.lit(0)
        counts += [F.count_if(of_part).alias(f"_n_{part}"), hit.alias(f"_h_{part}")]
        union = F.col(f"_n_{part}") + F.lit(len(chosen)) - F.col(f"_h_{part}")
        scores.append((F.col(f"_h_{part}") / union if chosen else F.lit(0.0)).alias(part))
    return values.where(F.col("value") != "").distinct().groupBy("run_id").agg(*counts).select("run_id", *scores)


def run_similarity(nodes: DataFrame, edges: DataFrame, profile: dict, limit: int | None = None) -> DataFrame:
    """``run_id, label, score``: runs by their likeness to a profile, the first ``limit`` of them if it is given.

    ``profile``: columns, primary_metric, time_axis, source_type, roles, row_count,
    column_count, keywords. Every part is a count per run, never a set per run.
    """
    runs = run_table(nodes)
    rows = lineage(nodes, edges).where(F.col("bucket").isin("columns", "anomalies", "root_causes"))
    # The linked elements are walked once: their columns, roles and keywords come out of the same row.
    found = F.array(
        F.struct(F.lit("columns").alias("part"), F.when(F.col("bucket") == "columns", _clean(F.col("label"))).alias("value")),
        F.struct(F.lit("roles").alias("part"), F.when(F.col("bucket") == "columns", _clean(_prop("semantic_role"))).alias("value")),
    )
    texts = F.concat_ws(" ", "label", "user_input", "primary_metric", "time_axis")
    words = lambda text: F.transform(
        F.coalesce(keyword_tokens(text, KEYWORD_STOPWORDS), F.array().cast("array<string>")), lambda w: F.struct(F.lit("keywords").alias("part"), w.alias("value")))
    values = rows.select("run_id", F.explode(F.concat(found, words(_clean(F.col("label"))))).alias("_v")).unionByName(
        runs.select("run_id", F.explode(words(texts)).alias("_v"))).select("run_id", "_v.*")
    joined = lookup_join(runs, _overlaps(values, {n: profile.get(n, ()) for n in ("columns", "roles", "keywords")}), "run_id", "run_id", "left")

    def exact(name: str) -> Column:
        wanted = str(profile.get(name) or "").strip().lower()
        return F.when(F.lit(wanted != "") & (F.lower(name) == wanted), 1.0).otherwise(0.0)

    shape = shape_similarity(
        F.lit(profile.get("row_count")).cast("bigint"), F.lit(profile.get("column_count")).cast("bigint"),
        F.col("row_count"), F.col("column_count"),
    )
    parts = {
        **{n: F.coalesce(n, F.lit(0.0)) for n in ("columns", "roles", "keywords")},
        **{n: exact(n) for n in ("primary_metric", "time_axis", "source_type")}, "shape": shape,
    }
    score = F.lit(0.0)
    for name, weight in SIMILARITY_WEIGHTS.items():
        score = score + parts[name] * weight
    scored = joined.select("run_id", "label", "created_at", F.round(clamp(score), 4).alias("score")).where("score > 0")
    ordered = scored.orderBy(F.desc("score"), F.desc("created_at"), F.desc("run_id"))
    return (ordered.limit(limit) if limit else ordered).drop("created_at")


def pattern_values(nodes: DataFrame, edges: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    """``kind, value`` once per occurrence in the chosen runs (``run_ids: run_id``)."""
    runs, rows = run_table(nodes), lineage(nodes, edges)
    if run_ids is not None:
        chosen = run_ids.select("run_id").distinct()
        runs, rows = runs.join(chosen, "run_id", "left_semi"), rows.join(chosen, "run_id", "left_semi")
    label = _clean(F.col("label"))
    parts = [runs.select(F.lit("metrics").alias("kind"), F.lower("primary_metric").alias("value"))]
    for bucket, kind in (("columns", "columns"), ("anomalies", "anomalies"), ("root_causes", "root_causes"), ("reports", "reports")):
        parts.append(rows.where(F.col("bucket") == bucket).select(F.lit(kind).alias("kind"), label.alias("value")))
    parts.append(rows.where((F.col("bucket") == "columns") & (F.lower(_prop("is_primary_metric")) == "true")).select(
        F.lit("metrics").alias("kind"), _clean(F.coalesce(_prop("name"), F.col("label"))).alias("value")))
    parts.append(rows.where(F.col("bucket") == "root_causes").select(
        F.lit("metrics").alias("kind"), F.explode(F.split(_clean(_prop("affected_metrics")), ",")).alias("value")))
    insights = rows.where(F.col("bucket") == "insights")
    summary = _clean(_prop("summary"))
    parts.append(insights.where(label.isin(*STRATEGY_LABELS)).select(
        F.lit("strategies").alias("kind"), F.when(summary != "", summary).otherwise(label).alias("value")))
    parts.append(insights.where(label.isin(*REPORT_LABELS)).select(F.lit("reports").alias("kind"), label.alias("value")))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.where(F.col("value") != "")


def _ranked(rows: DataFrame, kind: str, order: list[Column], limit: int | None) -> DataFrame:
    """``rank`` within each kind; kinds are few, so that only a rank that ends at ``limit`` is left to one task a kind."""
    if limit is None:
        return row_numbers(rows, order, [kind])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("rank") <= limit)


def recurring_patterns(
    nodes: DataFrame, edges: DataFrame, run_ids: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """``kind, value, occurrences, rank, confidence``: values seen at least twice (once for one run)."""
    chosen = run_table(nodes).select("run_id") if run_ids is None else run_ids.select("run_id")
    support = chosen.agg(F.count_distinct("run_id").alias("_runs"))
    counted = pattern_values(nodes, edges, run_ids).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    kept = counted.crossJoin(F.broadcast(support)).where(
        F.col("occurrences") >= F.when(F.col("_runs") <= 1, 1).otherwise(2)
    )
    top = _ranked(kept, "kind", [F.desc("occurrences"), F.col("value")], limit)
    kinds = top.agg(F.count_distinct("kind").alias("_kinds"))
    confidence = F.round(clamp(0.45 * F.least(F.lit(1.0), F.col("_runs") / 5.0) + 0.55 * F.col("_kinds") / 6), 4)
    return top.crossJoin(F.broadcast(kinds)).select("kind", "value", "occurrences", "rank", confidence.alias("confidence"))


def is_infrastructure(cause: Column) -> Column:
    return F.lower(F.coalesce(cause, F.lit(""))).rlike("|".join(INFRASTRUCTURE_TERMS))


def experience_steps(metric: Column, time_axis: Column, has_anomalies: Column, has_infrastructure: Column) -> Column:
    """Recommended steps in order, from what the runs have in common."""
    def text(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{metric}"), metric), F.lit("{time_axis}"), time_axis)

    named = F.coalesce(metric, F.lit("")) != ""
    steps = F.array_compact(F.array(
        F.when(named & (F.coalesce(time_axis, F.lit("")) != ""), text(STEP_TREND)),
        F.when(named, text(STEP_PERCENTILES)),
        F.when(has_anomalies, F.lit(STEP_OUTLIERS)),
        F.when(has_anomalies, F.lit(STEP_SEGMENTS)),
        F.when(has_infrastructure, F.lit(STEP_INFRASTRUCTURE)),
    ))
    return F.when(F.size(steps) > 0, F.array_distinct(steps)).otherwise(F.array(F.lit(STEP_COMPARE)))


def _run_values(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs, and ``run_id, item_kind, value`` for their metric, columns, anomalies and causes.

    The values are the base of every experience kind, so the lineage behind them is walked
    once, into a checkpoint.
    """
    runs = run_table(nodes)
    buckets = F.create_map(*[F.lit(v) for v in ("columns", "column", "anomalies", "anomaly", "root_causes", "root_cause")])
    # Of the properties only one is used, so that the others need not travel.
    lean = nodes.withColumn("properties", F.map_filter("properties", lambda k, _v: k == "anomaly_type"))
    rows = lineage(lean, edges)
    value = F.coalesce(F.when(F.trim("label") != "", F.trim("label")), F.when(F.col("bucket") == "anomalies", _prop("anomaly_type")))
    linked = rows.select("run_id", F.try_element_at(buckets, F.col("bucket")).alias("item_kind"), value.alias("value"))
    metrics = runs.select("run_id", F.lit("metric").alias("item_kind"), F.col("primary_metric").alias("value"))
    values = linked.unionByName(metrics).where(F.col("item_kind").isNotNull() & (F.coalesce("value", F.lit("")) != ""))
    return runs, reliable_checkpoint(values.distinct())


def experience_build(
    nodes: DataFrame, edges: DataFrame, kind: str
) -> tuple[DataFrame, DataFrame]:
    """Headers and items of one kind (metric, anomaly, root_cause) shared by at least two runs."""
    if kind not in EXPERIENCE_CONFIDENCE:
        raise ValueError(f"unknown experience kind: {kind}")
    return _build(*_run_values(nodes, edges), [kind])


def _build(runs: DataFrame, values: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Headers and items of the kinds, which are built side by side: every step takes the rows of all of them."""
    def by_kind(choices: dict[str, Column]) -> Column:
        chosen = F.when(F.lit(False), next(iter(choices.values())))
        for kind, value in choices.items():
            chosen = chosen.when(F.col("kind") == kind, value)
        return chosen

    experience_id = F.concat(F.lit("experience."), F.col("kind"), F.lit("."), label_slug(F.col("key")))
    # The values are distinct, and so are their parts.
    members = values.where(F.col("item_kind").isin(*kinds)).select("run_id", F.col("item_kind").alias("kind"), F.col("value").alias("key"))
    facts = lookup_join(members, runs.withColumnRenamed("run_id", "_run"), "run_id", "_run").groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.max("created_at").alias("updated_at"),
        F.min(F.when(F.col("primary_metric") != "", F.col("primary_metric"))).alias("_metric"),
        F.min_by("time_axis", F.when(F.col("time_axis") != "", F.col("run_id"))).alias("_axis"),
    ).where(F.col("evidence_count") >= 2)
    facts = reliable_checkpoint(facts)
    # Members of one kind meet values of the other kinds only, each once for a run.
    here = members.join(facts.select("kind", "key"), ["kind", "key"], "left_semi").withColumn("_h", F.xxhash64("run_id"))
    there = values.select("run_id", "item_kind", "value").withColumn("_h", F.xxhash64("run_id"))
    shared = here.join(there, ["_h", "run_id"]).where(F.col("item_kind") != F.col("kind")).select("kind", "key", "item_kind", "value")
    items = shared.unionByName(facts.select("kind", "key", F.col("kind").alias("item_kind"), F.col("key").alias("value"))).distinct()
    items = reliable_checkpoint(items)
    flags = items.groupBy("kind", "key").agg(
        F.max(F.col("item_kind") == "anomaly").alias("_anomalies"),
        F.max((F.col("item_kind") == "root_cause") & is_infrastructure(F.col("value"))).alias("_infrastructure"),
    )
    full = facts.join(flags, ["kind", "key"], "left")
    steps = experience_steps(
        F.when(F.col("kind") == "metric", F.col("key")).otherwise(F.coalesce("_metric", F.lit(""))), F.coalesce("_axis", F.lit("")),
        F.coalesce("_anomalies", F.lit(False)), F.coalesce("_infrastructure", F.lit(False)),
    )
    tags = by_kind({
        "metric": F.array(F.lit("metric"), F.col("key"), F.coalesce("_axis", F.lit(""))),
        "anomaly": F.array(F.lit("anomaly"), F.col("key"), F.lit("recurring")),
        "root_cause": F.array(F.lit("root-cause"), F.lit("recurring"), F.when(is_infrastructure(F.col("key")), "infrastructure").otherwise("general")),
    })
    extra = full.select("kind", "key", F.explode(F.concat(
        F.transform(steps, lambda v: F.struct(F.lit("step").alias("k"), v.alias("v"))),
        F.transform(tags, lambda v: F.struct(F.lit("tag").alias("k"), v.alias("v"))),
    )).alias("_x")).select("kind", "key", F.col("_x.k").alias("item_kind"), F.col("_x.v").alias("value")).where(F.col("value") != "")
    sure = by_kind({kind: F.lit(base) + F.col("evidence_count") * increment for kind, (base, increment) in EXPERIENCE_CONFIDENCE.items()})
    headers = facts.select(
        experience_id.alias("experience_id"), "kind", "key", F.round(F.least(F.lit(1.0), sure), 2).alias("confidence"),
        "evidence_count", "updated_at",
    )
    all_items = items.unionByName(extra.distinct()).select(experience_id.alias("experience_id"), "item_kind", "value")
    return headers, all_items


def experience_all(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric, anomaly and root-cause experience together."""
    return _build(*_run_values(nodes, edges), list(EXPERIENCE_CONFIDENCE))


def experience_signatures(headers: DataFrame, items: DataFrame) -> DataFrame:
    """``experience_id, signature``: the anomaly set, else the cause set, else the metric set, else the id.

    A set is identified by its size and order-free hash sums, so it is never collected.
    """
    def part(kind: str) -> list[Column]:
        hashed = F.when(F.col("item_kind") == kind, F.xxhash64(F.lower("value")))
        return [
            F.count(hashed).alias(f"n_{kind}"), F.sum(hashed.cast("decimal(38,0)")).alias(f"s_{kind}"),
            F.bit_xor(hashed).alias(f"x_{kind}"),
        ]

    kinds = ("anomaly", "root_cause", "metric")
    lowered = items.select("experience_id", "item_kind", F.lower("value").alias("value")).where(F.col("item_kind").isin(*kinds)).distinct()
    sets = lowered.groupBy("experience_id").agg(*[c for kind in kinds for c in part(kind)])
    signature = None
    for kind in kinds:
        text = F.concat_ws(":", F.lit(kind), f"n_{kind}", F.col(f"s_{kind}").cast("string"), f"x_{kind}")
        found = F.col(f"n_{kind}") > 0
        signature = F.when(found, text) if signature is None else signature.when(found, text)
    return headers.select("experience_id").join(sets, "experience_id", "left").select(
        "experience_id", signature.otherwise(F.concat(F.lit("id:"), F.lower("experience_id"))).alias("signature")
    )


def experience_upsert(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers left after records with one signature collapse; the greatest id, written last, stays."""
    signed = headers.join(experience_signatures(headers, items), "experience_id")
    kept = signed.groupBy("signature").agg(F.max("experience_id").alias("experience_id"))
    return headers.join(kept, "experience_id", "left_semi")


def experience_find(headers: DataFrame, items: DataFrame, item_kind: str, value: str) -> DataFrame:
    """Experience that holds a metric, anomaly, root_cause or tag, ignoring case."""
    hits = items.where((F.col("item_kind") == item_kind) & (F.lower("value") == value.strip().lower())).select("experience_id").distinct()
    return headers.join(hits, "experience_id", "left_semi")


def experience_match(headers: DataFrame, items: DataFrame, profile: dict[str, Sequence[str]], limit: int | None = None) -> DataFrame:
    """``experience_id, score, confidence, evidence_count``; profile keys are item kinds."""
    score = F.lit(0.0)
    measures = []
    for kind, weight in MATCH_WEIGHTS.items():
        wanted = [v.strip() for v in profile.get(kind, ()) if v and v.strip()]
        hit = (F.col("item_kind") == kind) & F.col("value").isin(*wanted) if wanted else F.lit(False)
        measures.append(F.max(hit.cast("int")).alias(f"_{kind}"))
        score = score + F.col(f"_{kind}") * weight
    scored = items.groupBy("experience_id").agg(*measures).select("experience_id", F.round(clamp(score), 4).alias("score"))
    found = scored.where("score > 0").join(headers, "experience_id").select("experience_id", "score", "confidence", "evidence_count")
    ordered = found.orderBy(F.desc("score"), F.desc("confidence"), F.desc("evidence_count"), F.desc("experience_id"))
    return ordered.limit(limit) if limit else ordered


def step_priority(step: Column) -> Column:
    text = F.lower(step)
    return (
        F.when(F.contains(text, F.lit("verifica infrastrutturale")), "high")
        .when(F.contains(text, F.lit("outlier")) | F.contains(text, F.lit("segmentazione")), "medium")
        .otherwise("low")
    )


def experience_recommend(headers: DataFrame, items: DataFrame, profile: dict[str, Sequence[str]], limit: int | None = None) -> DataFrame:
    """``step, priority, confidence, sources``: steps of all matching experience, the first ``limit`` of them if it is given."""
    matched = experience_match(headers, items, profile)
    steps = items.where(F.col("item_kind") == "step").join(matched, "experience_id")
    confidence = F.round(F.least(F.lit(1.0), F.col("score") * 0.6 + F.col("confidence") * 0.4), 4)
    grouped = steps.groupBy(F.col("value").alias("step")).agg(
        F.max(confidence).alias("confidence"), F.count_distinct("experience_id").alias("sources")
    )
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    ordered = grouped.withColumn("priority", step_priority(F.col("step"))).orderBy(rank, F.desc("confidence"), "step")
    return (ordered.limit(limit) if limit else ordered).select("step", "priority", "confidence", "sources")


def experience_tops(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Metrics, anomalies, causes and tags by how common they are: ``item_kind, value, frequency, rank, confidence``."""
    counted = items.where(F.col("item_kind").isin("metric", "anomaly", "root_cause", "tag")).groupBy("item_kind", "value").agg(
        F.count(F.lit(1)).alias("frequency")
    )
    ranked = _ranked(counted, "item_kind", [F.desc("frequency"), F.col("value")], limit)
    return ranked.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + F.col("frequency") * 0.12), 2))
