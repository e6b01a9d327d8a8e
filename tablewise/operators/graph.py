"""Lookups, lineage, search and comparison on a node/edge graph of analyses.

``nodes``: ``id, type, label, properties MAP<STRING,STRING>``.
``edges``: ``source, target, relationship, properties MAP<STRING,STRING>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.jsonfn import drop_secrets, properties_match, property_value
from tablewise.functions.text import search_tokens, slug, stable_hash
from tablewise.operators.joins import latest_per_key, lookup_join
from tablewise.operators.shape import distinct_counts, is_missing, row_to_long

# Relationship to lineage bucket.
LINEAGE_BUCKETS = {
    "ANALYZED_DATASET": "dataset",
    "USES_DATASET": "dataset",
    "HAS_COLUMN": "columns",
    "PRODUCED_INSIGHT": "insights",
    "GENERATED_INSIGHT": "insights",
    "DETECTED_ANOMALY": "anomalies",
    "IDENTIFIED_ROOT_CAUSE": "root_causes",
    "PROPOSED_ROOT_CAUSE": "root_causes",
    "GENERATED_REPORT": "reports",
    "USED_DOMAIN_PACK": "domain_packs",
}
ANALYSIS_TYPES = ("analysis_run", "dataset", "dataframe_column", "insight", "anomaly", "root_cause", "report")
PROPERTIES = T.MapType(T.StringType(), T.StringType())


def _mapping(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[item for k, v in values.items() for item in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, key)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key; rows with an empty key are ignored."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    for key in keys:
        both = both.where(F.col(key).isNotNull() & (F.col(key) != ""))
    rest = [F.to_json(F.struct(*[c for c in existing.columns if c not in keys]))]
    return latest_per_key(both, keys, [F.col("_batch"), *rest]).drop("_batch")


def upsert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["id"])


def upsert_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["source", "target", "relationship"])


def find_nodes(
    nodes: DataFrame, node_type: str | None = None, label_contains: str | None = None,
    property_filters: dict[str, str] | None = None, limit: int | None = None,
) -> DataFrame:
    found = nodes
    if node_type:
        found = found.where(F.col("type") == node_type)
    if label_contains:
        found = found.where(F.contains(F.lower("label"), F.lit(label_contains.lower())))
    if property_filters:
        found = found.where(properties_match(F.col("properties"), property_filters))
    return found.orderBy("id").limit(limit) if limit else found


def find_edges(
    edges: DataFrame, relationship: str | None = None, source: str | None = None, target: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    found = edges
    for column, wanted in (("relationship", relationship), ("source", source), ("target", target)):
        if wanted:
            found = found.where(F.col(column) == wanted)
    return found.orderBy("source", "target", "relationship").limit(limit) if limit else found


def neighbors(
    nodes: DataFrame, edges: DataFrame, node_id: str | None = None, direction: str = "both",
    relationship: str | None = None, limit: int | None = None
) -> DataFrame:
    """``id, neighbor_id, neighbor_type, neighbor_label, relationship, direction``.

    For one node, or for every node at once.
    """
    if direction not in ("both", "in", "out"):
        raise ValueError("direction must be 'both', 'in' or 'out'")
    used = edges.where(F.col("relationship") == relationship) if relationship else edges
    sides = []
    for name, here, there in (("out", "source", "target"), ("in", "target", "source")):
        if direction in ("both", name):
            side = used.where(F.col(here) == node_id) if node_id else used
            sides.append(side.select(
                F.col(here).alias("id"), F.col(there).alias("neighbor_id"), "relationship", F.lit(name).alias("direction")
            ))
    united = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    info = nodes.select("id", F.col("type").alias("neighbor_type"), F.col("label").alias("neighbor_label"))
    found = lookup_join(united, info, "neighbor_id", "id")
    return found.orderBy("id", "neighbor_id", "relationship", "direction").limit(limit) if limit else found


def lineage(nodes: DataFrame, edges: DataFrame, run_id: str | None = None) -> DataFrame:
    """``run_id, bucket, node_id, label, properties``: everything linked to each run, once per bucket."""
    links = edges.withColumn("bucket", _mapping(LINEAGE_BUCKETS, F.col("relationship"))).where(F.col("bucket").isNotNull())
    runs = nodes.where(F.col("type") == "analysis_run").select(F.col("id").alias("_run"))
    if run_id:
        links = links.where(F.col("source") == run_id)
    hashed = links.select(F.col("source").alias("run_id"), "bucket", F.col("target").alias("node_id"), F.xxhash64("source").alias("_h"))
    known = (F.col("_h") == F.col("_rh")) & (F.col("run_id") == F.col("_run"))
    # The hash stays until equal links are one, which then needs no shuffle of its own.
    of_runs = hashed.join(runs.withColumn("_rh", F.xxhash64("_run")), known, "left_semi").distinct().drop("_h")
    info = nodes.select(F.col("id").alias("_id"), "label", "properties")
    return lookup_join(of_runs, info, "node_id", "_id")


def lineage_counts(lineage_rows: DataFrame) -> DataFrame:
    """Linked elements per run and bucket."""
    return lineage_rows.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("elements"))


def _haystack() -> Column:
    properties = F.coalesce(F.to_json("properties"), F.lit(""))
    return F.lower(F.concat_ws(" ", "id", "type", "label", properties))


def search(nodes: DataFrame, text: str, types: Sequence[str] = ANALYSIS_TYPES, limit: int | None = None) -> DataFrame:
    """Nodes by the number of expanded query tokens their text holds: ``id, type, label, score``."""
    score = F.size(F.filter(search_tokens(F.lit(text)), lambda token: F.contains(_haystack(), token)))
    if text:
        score = F.when((score == 0) & F.contains(_haystack(), F.lit(text.lower())), 1).otherwise(score)
    found = nodes.where(F.col("type").isin(*types)).select("id", "type", "label", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), F.lower("label"), "id").limit(limit) if limit else found


def runs_with_anomaly(
    nodes: DataFrame, edges: DataFrame, question: str, limit: int | None = None
) -> DataFrame:
    """Runs that detected one of the anomalies found by the question."""
    anomalies = search(nodes, question, ["anomaly"]).select("id")
    detected = edges.where(F.col("relationship") == "DETECTED_ANOMALY")
    hits = detected.join(anomalies, F.col("target") == F.col("id"), "left_semi")
    runs = nodes.where(F.col("type") == "analysis_run").select("id", "label")
    matched = hits.groupBy("source").agg(F.max("target").alias("matched_anomaly"))
    found = lookup_join(matched, runs, "source", "id").select(F.col("source").alias("run_id"), "label", "matched_anomaly")
    return found.orderBy("run_id").limit(limit) if limit else found


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target is not a node: ``source, target, relationship, missing_end``."""
    ids = nodes.select("id")
    keep = ["source", "target", "relationship"]
    missing = [
        lookup_join(edges.select(*keep), ids, end, "id", "left_anti").select(*keep, F.lit(end).alias("missing_end"))
        for end in ("source", "target")
    ]
    return missing[0].unionByName(missing[1])


def endpoint_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types of both ends."""
    source_types = nodes.select("id", F.col("type").alias("source_type"))
    target_types = nodes.select("id", F.col("type").alias("target_type"))
    typed = lookup_join(edges, source_types, "source", "id")
    return lookup_join(typed, target_types, "target", "id")


def induced_edges(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the visible nodes."""
    ids = visible.select("id")
    kept = lookup_join(edges, ids, "source", "id", "left_semi")
    return lookup_join(kept, ids, "target", "id", "left_semi")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per type and edges per relationship: ``kind, name, count``."""
    return (
        nodes.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("node"))
        .unionByName(
            edges.groupBy(F.col("relationship").alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("edge"))
        )
    )


def latest_runs(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest runs by ``created_at``, ties by id."""
    created = F.coalesce(property_value(F.col("properties"), "created_at"), F.lit(""))
    found = nodes.where(F.col("type") == "analysis_run").withColumn("created_at", created).orderBy(F.desc("created_at"), F.desc("id"))
    return found.limit(limit) if limit else found


def _labels(rows: DataFrame) -> DataFrame:
    """Comparison labels: anomalies and causes carry what they affect."""
    base = F.coalesce("label", "node_id")
    affected = (
        F.when(F.col("bucket") == "anomalies", property_value(F.col("properties"), "affected_column"))
        .when(F.col("bucket") == "root_causes", property_value(F.col("properties"), "affected_metrics"))
    )
    label = F.when(F.coalesce(affected, F.lit("")) != "", F.concat_ws(":", base, affected)).otherwise(base)
    return rows.select("run_id", F.col("bucket").alias("kind"), label.alias("label"))


def _diff(labels_a: DataFrame, labels_b: DataFrame) -> DataFrame:
    both = labels_a.select("kind", "label", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        labels_b.select("kind", "label", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    merged = both.groupBy("kind", "label").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    state = F.when(F.col("_a") + F.col("_b") == 2, "common").when(F.col("_b") == 1, "added").otherwise("removed")
    return merged.select("kind", "label", state.alias("state"))


def run_diff(nodes: DataFrame, edges: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """``kind, label, state``: what two runs share, what ``run_b`` added, what it lost.

    For anomalies and causes, added means new and removed means resolved.
    """
    kinds = ("dataset", "columns", "insights", "anomalies", "root_causes")
    rows = [
        _labels(lineage(nodes, edges, run)).where(F.col("kind").isin(*kinds)) for run in (run_a, run_b)
    ]
    return _diff(rows[0], rows[1])


def run_changes(nodes: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """``field, run_a, run_b, changed`` for metric and time axis, and the confidence delta."""
    pair = nodes.where((F.col("type") == "analysis_run") & F.col("id").isin(run_a, run_b))

    def side(run: str, name: str) -> Column:
        return F.max(F.when(F.col("id") == run, property_value(F.col("properties"), name)))

    fields = ("primary_metric", "time_axis", "confidence_score")
    row = pair.agg(*[side(run, f).alias(f"{f}__{tag}") for f in fields for tag, run in (("run_a", run_a), ("run_b", run_b))])
    long = row_to_long(row, fields, ["run_a", "run_b"], name="field")
    left, right = (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("run_a", "run_b"))
    return long.select(
        "field", "run_a", "run_b", (~F.col("run_a").eqNullSafe(F.col("run_b"))).alias("changed"),
        F.when(F.col("field") == "confidence_score", F.round(right - left, 4)).alias("delta"),
    )


def latest_run_diff(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_diff`` of the two newest runs (older first); empty below two runs."""
    newest = latest_runs(nodes, 2).select("id", "created_at")
    ends = newest.agg(
        F.max_by("id", F.struct("created_at", "id")).alias("b"), F.min_by("id", F.struct("created_at", "id")).alias("a"),
    ).where(F.col("a") != F.col("b"))
    rows = lineage(
        nodes, edges.join(F.broadcast(newest.select("id")), F.col("source") == F.col("id"), "left_semi")
    )
    labels = _labels(rows).where(F.col("kind").isin("dataset", "columns", "insights", "anomalies", "root_causes"))
    tagged = labels.crossJoin(F.broadcast(ends))
    return _diff(tagged.where(F.col("run_id") == F.col("a")), tagged.where(F.col("run_id") == F.col("b")))


def run_identity(created_at: str, request: str, source_type: str) -> Column:
    """Stable run id over creation time, request and source."""
    return F.concat(F.lit("analysis_run:"), stable_hash(F.lit("|".join([created_at, request, source_type])), 16))


def graph_from_run(
    df: DataFrame,
    *,
    created_at: str,
    request: str,
    source_type: str,
    dataset_name: str,
    primary_metric: str | None = None,
    time_axis: str | None = None,
    confidence_score: float = 0.0,
    semantics: DataFrame | None = None,
    insights: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    causes: DataFrame | None = None,
    cause_members: DataFrame | None = None,
    report: str | None = None,
    pack_id: str | None = None,
    metadata: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one analysed table, canonical and legacy relationships both.

    Optional result tables: ``insights (name, summary)``, ``anomalies`` (anomaly records),
    ``causes`` (``rca_causes``), ``cause_members (cause_id, anomaly_id)``,
    ``semantics (column, semantic_type)``.
    """
    spark: SparkSession = df.sparkSession
    one = spark.range(1)
    run, names = run_identity(created_at, request, source_type), df.columns
    dataset = F.concat(F.lit("dataset:"), run)

    def properties(**values: Column) -> Column:
        present = F.create_map(*[p for k, v in values.items() for p in (F.lit(k), v.cast("string"))]).cast(PROPERTIES)
        return F.map_filter(present, lambda _k, v: v.isNotNull())

    def node(frame: DataFrame, node_id: Column, kind: str, label: Column, props: Column) -> DataFrame:
        return frame.select(node_id.alias("id"), F.lit(kind).alias("type"), label.alias("label"), props.alias("properties"))

    def edge(frame: DataFrame, source: Column, target: Column, *relationships: str) -> DataFrame:
        empty = F.create_map().cast(PROPERTIES)
        names_column = F.explode(F.array(*[F.lit(r) for r in relationships]))
        return frame.select(source.alias("source"), target.alias("target"), names_column.alias("relationship"), empty.alias("properties"))

    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    extra = F.create_map(*[p for k, v in (metadata or {}).items() for p in (F.lit(k), F.lit(str(v)))]).cast(PROPERTIES)
    run_node = node(
        rows, run, "analysis_run", F.lit(request or "Analysis"),
        F.map_concat(drop_secrets(extra), properties(
            created_at=F.lit(created_at), user_input=F.lit(request), source_type=F.lit(source_type),
            row_count=F.col("rows"), column_count=F.lit(len(names)), primary_metric=F.lit(primary_metric),
            time_axis=F.lit(time_axis), confidence_score=F.lit(confidence_score),
        )),
    )
    dataset_node = node(rows, dataset, "dataset", F.lit(dataset_name), properties(
        source_type=F.lit(source_type), row_count=F.col("rows"), column_count=F.lit(len(names)),
    ))
    facts = row_to_long(
        df.agg(
            *[F.count_if(is_missing(df, c)).alias(f"{c}__null_count") for c in names],
            *[F.count(F.lit(1)).alias(f"{c}__rows") for c in names],
            *[F.lit(df.schema[c].dataType.simpleString()).alias(f"{c}__dtype") for c in names],
        ), names, ["null_count", "rows", "dtype"],
    )
    distinct = distinct_counts(df, names).withColumnRenamed("distinct_values", "cardinality")
    columns = facts.join(F.broadcast(distinct), "column", "left")
    if semantics is not None:
        columns = columns.join(F.broadcast(semantics.select("column", "semantic_type")), "column", "left")
    else:
        columns = columns.withColumn("semantic_type", F.lit(None).cast("string"))
    column_id = F.concat(F.lit("dataframe_column:"), run, F.lit(":"), slug(F.col("column")))
    share = F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), 4), F.lit(0.0))
    column_nodes = node(columns, column_id, "dataframe_column", F.col("column"), properties(
        name=F.col("column"), dtype=F.col("dtype"), semantic_role=F.col("semantic_type"),
        is_primary_metric=F.col("column") == F.lit(primary_metric or ""), is_time_axis=F.col("column") == F.lit(time_axis or ""),
        null_count=F.col("null_count"), null_percentage=share, cardinality=F.coalesce("cardinality", F.lit(0)),
    ))
    column_ids = facts.select("column")
    nodes = [run_node, dataset_node, column_nodes]
    edges = [
        edge(one, run, dataset, "ANALYZED_DATASET", "USES_DATASET"),
        edge(column_ids, run, column_id, "HAS_COLUMN"),
        edge(column_ids, dataset, column_id, "HAS_COLUMN"),
    ]
    if insights is not None:
        insight_id = F.concat(F.lit("insight:"), run, F.lit(":"), slug(F.col("name")))
        nodes.append(node(insights, insight_id, "insight", F.col("name"), properties(summary=F.col("summary"))))
        edges.append(edge(insights, run, insight_id, "PRODUCED_INSIGHT", "GENERATED_INSIGHT"))
    anomaly_id = F.concat(F.lit("anomaly:"), F.col("anomaly_id"))
    if anomalies is not None:
        picked = ("anomaly_type", "severity", "confidence_score", "affected_column", "affected_period", "method")
        nodes.append(node(anomalies, anomaly_id, "anomaly", F.col("anomaly_type"), properties(**{c: F.col(c) for c in picked})))
        edges.append(edge(anomalies, run, anomaly_id, "DETECTED_ANOMALY"))
        edges.append(edge(anomalies, anomaly_id, dataset, "OBSERVED_IN_DATASET"))
    if causes is not None:
        cause_id = F.concat(F.lit("root_cause:"), F.col("cause_id"))
        nodes.append(node(causes, cause_id, "root_cause", F.col("title"), properties(
            severity=F.col("severity"), confidence_score=F.col("confidence_score"),
            affected_metrics=F.array_join("affected_metrics", ","),
        )))
        edges.append(edge(causes, run, cause_id, "IDENTIFIED_ROOT_CAUSE", "PROPOSED_ROOT_CAUSE"))
        if cause_members is not None:
            edges.append(edge(cause_members, cause_id, anomaly_id, "EXPLAINS_ANOMALY"))
    if report:
        report_id = F.concat(F.lit("report:"), run)
        nodes.append(node(one, report_id, "report", F.lit("final_report"), properties(
            length_chars=F.lit(len(report)), line_count=F.lit(len(report.splitlines())), sha1=stable_hash(F.lit(report)),
        )))
        edges.append(edge(one, run, report_id, "GENERATED_REPORT"))
    if pack_id:
        pack = F.lit(f"domain_pack:{pack_id}")
        nodes.append(node(one, pack, "domain_pack", F.lit(pack_id), properties(pack_id=F.lit(pack_id))))
        edges.append(edge(one, run, pack, "USED_DOMAIN_PACK"))
    return _union(nodes), _union(edges)


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
