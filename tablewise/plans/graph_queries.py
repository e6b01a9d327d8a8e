"""Graph lookups, lineage, comparison and validation on a graph derived from the shared tables.

Orders are analysis runs, customers their datasets, brands the columns, deeply discounted
lines the anomalies and suppliers the root causes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewise.operators import graph, graph_quality
from tablewise.operators.graph import PROPERTIES
from tablewise.operators.store import BucketStore
from tablewise.plans.registry import QuerySet, table
from tablewise.session import reliable_checkpoint, shared_folder

SET = QuerySet()

ANOMALY_LABELS = ("numeric_outlier", "sla_violation", "sudden_change")


def _props(**values):
    items = [p for k, v in values.items() for p in (F.lit(k), v.cast("string"))]
    return F.create_map(*items).cast(PROPERTIES)


def _node(df, node_id, kind, label, properties):
    return df.select(node_id.alias("id"), F.lit(kind).alias("type"), label.alias("label"), properties.alias("properties"))


def _edge(df, source, target, relationship):
    relationship = F.lit(relationship) if isinstance(relationship, str) else relationship
    empty = F.create_map().cast(PROPERTIES)
    return df.select(source.alias("source"), target.alias("target"), relationship.alias("relationship"), empty.alias("properties"))


def _run(key):
    return F.concat(F.lit("analysis_run:"), F.col(key).cast("string"))


def _order(column, *letters):
    """2i + 1 for the i-th of the ordered letters, even numbers for what lies between them: a maximum of numbers is hashed, not sorted."""
    return F.when(F.col(column).isNotNull(), sum((F.when(F.col(column) > x, 2).when(F.col(column) == x, 1).otherwise(0) for x in letters), F.lit(0)))


def analysis_graph(spark, folder):
    """Nodes and edges; both free of repeated keys."""
    orders, lines, part, supplier, customer = (
        table(spark, folder, t) for t in ("orders", "lineitem", "part", "supplier", "customer")
    )
    status = F.lower("o_orderstatus")
    runs = _node(
        orders, _run("o_orderkey"), "analysis_run", F.concat(F.lit("order "), (F.col("o_orderkey") % 100).cast("string")),
        _props(
            created_at=F.date_format("o_orderdate", "yyyy-MM-dd"), primary_metric=F.lower("o_orderpriority"),
            time_axis=F.when(status == "o", "o_orderdate").otherwise("l_shipdate"), source_type=status,
            row_count=F.col("o_custkey"), column_count=F.col("o_orderkey") % 9 + 1,
            confidence_score=F.round(F.col("o_totalprice") / 500000, 4),
        ),
    )
    dataset = F.concat(F.lit("dataset:"), F.col("c_custkey").cast("string"))
    datasets = _node(customer, dataset, "dataset", F.col("c_mktsegment"), _props(
        source_type=F.lit("table"), row_count=F.col("c_custkey"), column_count=F.lit(5)))
    brand = F.concat(F.lit("dataframe_column:"), F.col("p_brand"))
    columns = _node(part.select("p_brand").distinct(), brand, "dataframe_column", F.lower("p_brand"), _props(
        name=F.lower("p_brand"), dtype=F.lit("double"), semantic_role=F.lit("metric")))
    deep = lines.where("l_discount >= 0.09").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    ).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(
        F.max(_order("l_returnflag", "A", "N")).alias("flag"), F.max(_order("l_linestatus", "O")).alias("status"))
    anomaly = F.concat_ws("-", F.concat(F.lit("anomaly:"), F.col("l_orderkey").cast("string")), "l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("flag") == 1, ANOMALY_LABELS[0]).when(F.col("flag") == 3, ANOMALY_LABELS[1]).otherwise(ANOMALY_LABELS[2])
    anomalies = _node(deep, anomaly, "anomaly", kind, _props(
        severity=F.when(F.col("status") == 1, "high").otherwise("low"), affected_column=F.lit("l_discount")))
    cause = F.concat(F.lit("root_cause:"), F.col("s_suppkey").cast("string"))
    causes = _node(supplier, cause, "root_cause", F.concat(F.lit("backlog nation "), F.col("s_nationkey").cast("string")), _props(
        affected_metrics=F.lit("l_discount"), confidence_score=F.lit("0.7")))
    filed = orders.where("o_orderstatus = 'F'")
    report = F.concat(F.lit("report:"), F.col("o_orderkey").cast("string"))
    reports = _node(filed, report, "report", F.lit("final_report"), _props(length_chars=F.lit(10)))
    nodes = runs
    for frame in (datasets, columns, anomalies, causes, reports):
        nodes = nodes.unionByName(frame)

    line_cause = F.concat(F.lit("root_cause:"), F.col("l_suppkey").cast("string"))
    brands = lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "p_brand").distinct()
    edges = [
        _edge(orders, _run("o_orderkey"), F.concat(F.lit("dataset:"), F.col("o_custkey").cast("string")),
              F.when(F.col("o_orderkey") % 2 == 0, "USES_DATASET").otherwise("ANALYZED_DATASET")),
        _edge(brands, _run("l_orderkey"), brand, "HAS_COLUMN"),
        _edge(deep, _run("l_orderkey"), anomaly, "DETECTED_ANOMALY"),
        _edge(deep.select("l_orderkey", "l_suppkey").distinct(), _run("l_orderkey"), line_cause, "IDENTIFIED_ROOT_CAUSE"),
        _edge(deep, line_cause, anomaly, "EXPLAINS_ANOMALY"),
        _edge(filed.where("o_orderkey % 3 <> 0"), _run("o_orderkey"), report, "GENERATED_REPORT"),
    ]
    united = edges[0]
    for frame in edges[1:]:
        united = united.unionByName(frame)
    return nodes, united


def stored_graph(spark, folder, build=analysis_graph):
    """The derived graph written out as two tables, as a kept graph would be."""
    nodes, edges = build(spark, folder)
    return reliable_checkpoint(nodes), reliable_checkpoint(edges)


GRAPH_SQL = """
WITH deep AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag) AS flag, max(l_linestatus) AS status
   FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2, 3, 4),
 deepid AS (SELECT *, 'anomaly:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS aid FROM deep),
 nodes AS (
  SELECT 'analysis_run:' || o_orderkey AS id, 'analysis_run' AS type, 'order ' || (o_orderkey % 100) AS label,
    strftime(o_orderdate, '%Y-%m-%d') AS created_at, lower(o_orderpriority) AS primary_metric,
    CASE WHEN o_orderstatus = 'O' THEN 'o_orderdate' ELSE 'l_shipdate' END AS time_axis, lower(o_orderstatus) AS source_type,
    o_custkey AS row_count, o_orderkey % 9 + 1 AS column_count, round(o_totalprice / 500000, 4) AS confidence_score,
    NULL AS severity, NULL AS affected FROM orders
  UNION ALL SELECT 'dataset:' || c_custkey, 'dataset', c_mktsegment, NULL, NULL, NULL, 'table', c_custkey, 5, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'dataframe_column:' || p_brand, 'dataframe_column', lower(p_brand), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT aid, 'anomaly', CASE flag WHEN 'A' THEN 'numeric_outlier' WHEN 'N' THEN 'sla_violation' ELSE 'sudden_change' END,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE status WHEN 'O' THEN 'high' ELSE 'low' END, 'l_discount' FROM deepid
  UNION ALL SELECT 'root_cause:' || s_suppkey, 'root_cause', 'backlog nation ' || s_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, 0.7, NULL, 'l_discount' FROM supplier
  UNION ALL SELECT 'report:' || o_orderkey, 'report', 'final_report', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'F'),
 edges AS (
  SELECT 'analysis_run:' || o_orderkey AS source, 'dataset:' || o_custkey AS target,
    CASE WHEN o_orderkey % 2 = 0 THEN 'USES_DATASET' ELSE 'ANALYZED_DATASET' END AS relationship FROM orders
  UNION ALL SELECT DISTINCT 'analysis_run:' || l_orderkey, 'dataframe_column:' || p_brand, 'HAS_COLUMN' FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'analysis_run:' || l_orderkey, aid, 'DETECTED_ANOMALY' FROM deepid
  UNION ALL SELECT DISTINCT 'analysis_run:' || l_orderkey, 'root_cause:' || l_suppkey, 'IDENTIFIED_ROOT_CAUSE' FROM deepid
  UNION ALL SELECT 'root_cause:' || l_suppkey, aid, 'EXPLAINS_ANOMALY' FROM deepid
  UNION ALL SELECT 'analysis_run:' || o_orderkey, 'report:' || o_orderkey, 'GENERATED_REPORT' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0),
 bucket AS (SELECT source AS run_id, target AS node_id, CASE WHEN relationship IN ('USES_DATASET', 'ANALYZED_DATASET') THEN 'dataset'
   WHEN relationship = 'HAS_COLUMN' THEN 'columns' WHEN relationship = 'DETECTED_ANOMALY' THEN 'anomalies'
   WHEN relationship = 'IDENTIFIED_ROOT_CAUSE' THEN 'root_causes' WHEN relationship = 'GENERATED_REPORT' THEN 'reports' END AS bucket FROM edges),
 lineage AS (SELECT DISTINCT b.run_id, b.bucket, b.node_id, n.label, n.affected FROM bucket b
   JOIN nodes r ON r.id = b.run_id AND r.type = 'analysis_run' JOIN nodes n ON n.id = b.node_id WHERE b.bucket IS NOT NULL)
"""


@SET.add("graph_counts", GRAPH_SQL + """
SELECT 'node' AS kind, type AS name, count(*) AS count FROM nodes GROUP BY 2
UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY 2""")
def _(spark, folder):
    return graph.graph_counts(*analysis_graph(spark, folder))


@SET.add("graph_find_nodes", GRAPH_SQL + """
SELECT id, type, label FROM nodes WHERE type = 'analysis_run' AND label LIKE '%7%' AND source_type = 'f' ORDER BY id LIMIT 50""")
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    return graph.find_nodes(nodes, "analysis_run", "7", {"source_type": "F"}, 50).drop("properties")


@SET.add("graph_find_edges", GRAPH_SQL + """
SELECT source, target, relationship FROM edges WHERE relationship = 'GENERATED_REPORT' ORDER BY source, target LIMIT 20""")
def _(spark, folder):
    _nodes, edges = analysis_graph(spark, folder)
    return graph.find_edges(edges, "GENERATED_REPORT", limit=20).drop("properties")


@SET.add("graph_neighbors", GRAPH_SQL + """
, b AS (SELECT source AS id, target AS other, relationship, 'out' AS direction FROM edges
  UNION ALL SELECT target, source, relationship, 'in' FROM edges)
SELECT b.id, b.other AS neighbor_id, n.type AS neighbor_type, n.label AS neighbor_label, b.relationship, b.direction FROM b JOIN nodes n ON n.id = b.other""")
def _(spark, folder):
    return graph.neighbors(*stored_graph(spark, folder)).select("id", "neighbor_id", "neighbor_type", "neighbor_label", "relationship", "direction")


@SET.add("graph_lineage", GRAPH_SQL + "SELECT run_id, bucket, node_id, label FROM lineage")
def _(spark, folder):
    return graph.lineage(*stored_graph(spark, folder)).select("run_id", "bucket", "node_id", "label")


@SET.add("graph_runs_with_anomaly", GRAPH_SQL + """
, hit AS (SELECT id FROM nodes WHERE type = 'anomaly' AND (label LIKE '%sudden_change%' OR lower(severity) LIKE '%sudden_change%')
)
SELECT e.source AS run_id, n.label, max(e.target) AS matched_anomaly FROM edges e JOIN hit ON e.target = hit.id JOIN nodes n ON n.id = e.source
WHERE e.relationship = 'DETECTED_ANOMALY' AND n.type = 'analysis_run' GROUP BY 1, 2""")
def _(spark, folder):
    return graph.runs_with_anomaly(*analysis_graph(spark, folder), "sudden_change")


@SET.add("graph_search", GRAPH_SQL + """
, s AS (SELECT id, type, label, (contains(lower(id || ' ' || type || ' ' || label), 'nation'))::INT
   + (contains(lower(id || ' ' || type || ' ' || label), 'backlog'))::INT + (contains(lower(id || ' ' || type || ' ' || label), 'order'))::INT AS score FROM nodes
   WHERE type IN ('root_cause', 'report', 'dataset'))
SELECT id, type, label, score FROM s WHERE score > 0 ORDER BY score DESC, lower(label), id LIMIT 30""")
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    return graph.search(nodes, "quali backlog della nation order?", ["root_cause", "report", "dataset"], 30)


@SET.add("latest_runs", GRAPH_SQL + """
SELECT id, label, created_at FROM nodes WHERE type = 'analysis_run' ORDER BY created_at DESC, id DESC LIMIT 5""")
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    return graph.latest_runs(nodes, 5).select("id", "label", "created_at")


_DIFF_SQL = """
, d AS (SELECT run_id, bucket AS kind, label || CASE WHEN bucket IN ('anomalies', 'root_causes') THEN ':' || affected ELSE '' END AS label FROM lineage
  WHERE bucket <> 'reports'),
 m AS (SELECT kind, label, max((run_id = {a})::INT) AS a, max((run_id = {b})::INT) AS b FROM d WHERE run_id IN ({a}, {b}) GROUP BY 1, 2)
SELECT kind, label, CASE WHEN a = 1 AND b = 1 THEN 'common' WHEN b = 1 THEN 'added' ELSE 'removed' END AS state FROM m"""


@SET.add("run_diff", GRAPH_SQL + _DIFF_SQL.format(a="'analysis_run:7'", b="'analysis_run:32'"))
def _(spark, folder):
    return graph.run_diff(*stored_graph(spark, folder), "analysis_run:7", "analysis_run:32")


@SET.add("run_changes", GRAPH_SQL + """
, a AS (SELECT * FROM nodes WHERE id = 'analysis_run:7'), b AS (SELECT * FROM nodes WHERE id = 'analysis_run:32')
SELECT 'primary_metric' AS field, a.primary_metric AS run_a, b.primary_metric AS run_b, a.primary_metric IS DISTINCT FROM b.primary_metric AS changed, NULL::DOUBLE AS delta FROM a, b
UNION ALL SELECT 'time_axis', a.time_axis, b.time_axis, a.time_axis IS DISTINCT FROM b.time_axis, NULL FROM a, b
UNION ALL SELECT 'confidence_score', a.confidence_score::VARCHAR, b.confidence_score::VARCHAR, a.confidence_score IS DISTINCT FROM b.confidence_score,
  round(b.confidence_score - a.confidence_score, 4) FROM a, b""")
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    return graph.run_changes(nodes, "analysis_run:7", "analysis_run:32")


@SET.add("latest_run_diff", GRAPH_SQL + _DIFF_SQL.format(
    a="(SELECT id FROM nodes WHERE type = 'analysis_run' ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 1)",
    b="(SELECT id FROM nodes WHERE type = 'analysis_run' ORDER BY created_at DESC, id DESC LIMIT 1)"))
def _(spark, folder):
    return graph.latest_run_diff(*stored_graph(spark, folder))


UPSERT_SQL = GRAPH_SQL + """
, incoming AS (SELECT id, type, 'renamed' AS label FROM nodes WHERE type = 'dataset' UNION ALL SELECT 'dataset:new', 'dataset', 'new' UNION ALL SELECT '', 'dataset', 'x'),
 merged AS (SELECT id, type, label FROM nodes WHERE type <> 'dataset' UNION ALL SELECT * FROM incoming WHERE id <> '')
SELECT type, label, count(*) AS nodes FROM merged WHERE type IN ('dataset', 'root_cause') GROUP BY 1, 2"""


def _incoming(spark, nodes):
    renamed = nodes.where("type = 'dataset'").withColumn("label", F.lit("renamed"))
    added = spark.range(1).select(
        F.explode(F.array(F.struct(F.lit("dataset:new").alias("id"), F.lit("new").alias("label")),
                          F.struct(F.lit("").alias("id"), F.lit("x").alias("label")))).alias("_n")
    ).select("_n.id", F.lit("dataset").alias("type"), "_n.label", F.create_map().cast(PROPERTIES).alias("properties"))
    return renamed.unionByName(added)


def _labels_of_two_types(nodes):
    return nodes.where("type in ('dataset', 'root_cause')").groupBy("type", "label").agg(F.count(F.lit(1)).alias("nodes"))


@SET.add("graph_upsert", UPSERT_SQL)
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    return _labels_of_two_types(graph.upsert_nodes(nodes, _incoming(spark, nodes)))


@SET.add("graph_store", UPSERT_SQL)
def _(spark, folder):
    nodes, _edges = analysis_graph(spark, folder)
    stored = BucketStore.create(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", nodes.schema, ["id"], buckets=32)
    stored.upsert(nodes)
    stored.upsert(_incoming(spark, nodes))
    return _labels_of_two_types(stored.rows())


@SET.add("graph_from_run", """
SELECT 'analysis_run' AS type, 1::BIGINT AS nodes, 0::BIGINT AS columns_with_nulls, NULL::BIGINT AS cardinality
UNION ALL SELECT 'dataset', 1, 0, NULL
UNION ALL SELECT 'dataframe_column', 6, 0, (SELECT count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus)
  + count(DISTINCT o_totalprice) + count(DISTINCT o_orderdate) + count(DISTINCT o_orderpriority) FROM orders)
UNION ALL SELECT 'report', 1, 0, NULL""")
def _(spark, folder):
    nodes, _edges = graph.graph_from_run(
        table(spark, folder, "orders"), created_at="2026-01-01T00:00:00", request="overview", source_type="parquet",
        dataset_name="orders", primary_metric="o_totalprice", time_axis="o_orderdate", report="done",
        metadata={"password": "x", "team": "a"},
    )
    value = lambda name: F.try_element_at("properties", F.lit(name)).try_cast("bigint")
    return nodes.groupBy("type").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(value("null_count") > 0).alias("columns_with_nulls"),
        F.sum(value("cardinality")).alias("cardinality"),
    )


@SET.add("graph_induced_edges", GRAPH_SQL + """
, v AS (SELECT id FROM nodes WHERE type IN ('analysis_run', 'dataset', 'root_cause'))
SELECT relationship, count(*) AS edges FROM edges WHERE source IN (FROM v) AND target IN (FROM v) GROUP BY 1""")
def _(spark, folder):
    nodes, edges = stored_graph(spark, folder)
    kept = graph.induced_edges(nodes.where("type in ('analysis_run', 'dataset', 'root_cause')"), edges)
    return kept.groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"))


def dirty_graph(spark, folder):
    """The graph with defects: repeated and empty ids, unknown types, wrong ends, missing nodes."""
    nodes, edges = analysis_graph(spark, folder)
    orders = table(spark, folder, "orders")
    bad_nodes = [
        _node(orders.where("o_orderkey % 50 = 1"), _run("o_orderkey"), "analysis_run", F.lit("again"), _props(created_at=F.lit("x"))),
        _node(orders.where("o_orderkey % 70 = 3"), F.lit(""), "dataset", F.lit("no id"), F.lit(None).cast(PROPERTIES)),
        _node(orders.where("o_orderkey % 90 = 5"), F.concat(F.lit("odd:"), F.col("o_orderkey").cast("string")), "OddType", F.lit(""),
              _props(**{"Bad Key": F.lit("1")})),
        _node(orders.where("o_orderkey % 90 = 7"), F.concat(F.lit("file:"), F.col("o_orderkey").cast("string")), "python_file", F.lit("f"), _props(size=F.lit("1"))),
    ]
    gone = F.concat(F.lit("dataset:gone"), F.col("o_orderkey").cast("string"))
    bad_edges = [
        _edge(orders.where("o_orderkey % 60 = 2"), _run("o_orderkey"), gone, "ANALYZED_DATASET"),
        _edge(orders.where("o_orderkey % 60 = 4"), _run("o_orderkey"), _run("o_orderkey"), "LOOPS"),
        _edge(orders.where("o_orderkey % 60 = 6"), F.concat(F.lit("dataset:"), F.col("o_custkey").cast("string")), _run("o_orderkey"), "HAS_COLUMN"),
        _edge(orders.where("o_orderkey % 60 = 8"), _run("o_orderkey"), F.concat(F.lit("dataset:"), F.pmod(F.col("o_custkey") + 1, F.lit(2)).cast("string")), "ANALYZED_DATASET"),
    ]
    for frame in bad_nodes:
        nodes = nodes.unionByName(frame)
    for frame in bad_edges:
        edges = edges.unionByName(frame)
    return nodes, edges


DIRTY_SQL = GRAPH_SQL + """
, dn AS (SELECT id, type, label, 'ok' AS why FROM nodes
  UNION ALL SELECT 'analysis_run:' || o_orderkey, 'analysis_run', 'again', 'again' FROM orders WHERE o_orderkey % 50 = 1
  UNION ALL SELECT '', 'dataset', 'no id', 'noid' FROM orders WHERE o_orderkey % 70 = 3
  UNION ALL SELECT 'odd:' || o_orderkey, 'OddType', '', 'odd' FROM orders WHERE o_orderkey % 90 = 5
  UNION ALL SELECT 'file:' || o_orderkey, 'python_file', 'f', 'file' FROM orders WHERE o_orderkey % 90 = 7),
 dc AS (SELECT id, count(*) AS c FROM dn WHERE id <> '' GROUP BY 1),
 ns AS (SELECT dn.*, coalesce(c, 0) > 1 AS dup, NOT (dn.id = '' OR coalesce(c, 0) > 1 OR type = 'python_file') AS accepted FROM dn LEFT JOIN dc ON dn.id = dc.id),
 de AS (SELECT source, target, relationship FROM edges
  UNION ALL SELECT 'analysis_run:' || o_orderkey, 'dataset:gone' || o_orderkey, 'ANALYZED_DATASET' FROM orders WHERE o_orderkey % 60 = 2
  UNION ALL SELECT 'analysis_run:' || o_orderkey, 'analysis_run:' || o_orderkey, 'LOOPS' FROM orders WHERE o_orderkey % 60 = 4
  UNION ALL SELECT 'dataset:' || o_custkey, 'analysis_run:' || o_orderkey, 'HAS_COLUMN' FROM orders WHERE o_orderkey % 60 = 6
  UNION ALL SELECT 'analysis_run:' || o_orderkey, 'dataset:' || ((o_custkey + 1) % 2), 'ANALYZED_DATASET' FROM orders WHERE o_orderkey % 60 = 8),
 ec AS (SELECT source, target, relationship, count(*) AS c FROM de GROUP BY 1, 2, 3),
 es AS (SELECT de.*, ec.c > 1 AS dup, s.type AS st, t.type AS tt FROM de JOIN ec USING (source, target, relationship)
   LEFT JOIN ns s ON s.id = de.source AND s.accepted LEFT JOIN ns t ON t.id = de.target AND t.accepted),
 ef AS (SELECT *, source = target AS loop, relationship = 'HAS_COLUMN' AND st = 'dataset' AND tt = 'analysis_run' AS mismatch FROM es),
 eg AS (SELECT *, NOT (dup OR st IS NULL OR tt IS NULL OR loop OR coalesce(mismatch, false)) AS accepted FROM ef)
"""


@SET.add("graph_dangling", DIRTY_SQL + """
SELECT missing_end, relationship, count(*) AS edges FROM (SELECT 'source' AS missing_end, relationship FROM de WHERE source NOT IN (SELECT id FROM dn)
UNION ALL SELECT 'target', relationship FROM de WHERE target NOT IN (SELECT id FROM dn)) GROUP BY 1, 2""")
def _(spark, folder):
    found = graph.dangling_edges(*stored_graph(spark, folder, dirty_graph))
    return found.groupBy("missing_end", "relationship").agg(F.count(F.lit(1)).alias("edges"))


@SET.add("graph_endpoint_types", GRAPH_SQL + """
SELECT source, target, relationship, s.type AS source_type, t.type AS target_type FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target""")
def _(spark, folder):
    return graph.endpoint_types(*stored_graph(spark, folder)).select("source", "target", "relationship", "source_type", "target_type")


_NODE_ISSUES = """
 SELECT 'identity.node_id_missing_or_empty' AS code, 'error' AS severity, count(*) AS issues FROM ns WHERE id = ''
 UNION ALL SELECT 'uniqueness.duplicate_node_id', 'error', count(*) FROM ns WHERE dup
 UNION ALL SELECT 'naming.node_type_not_lower_snake_case', 'warning', count(*) FROM ns WHERE why = 'odd'
 UNION ALL SELECT 'schema.unknown_node_type', 'warning', count(*) FROM ns WHERE why = 'odd'
 UNION ALL SELECT 'property.node_label_missing_or_empty', 'warning', count(*) FROM ns WHERE why = 'odd'
 UNION ALL SELECT 'naming.property_key_not_lower_snake_case', 'warning', count(*) FROM ns WHERE why = 'odd'
 UNION ALL SELECT 'property.node_properties_missing', 'warning', count(*) FROM ns WHERE why = 'noid'
 UNION ALL SELECT 'property.required_node_property_missing', 'error', count(*) FROM ns WHERE why = 'file'
 UNION ALL SELECT 'property.recommended_node_property_missing', 'warning', 3 * (count(*) FILTER (why = 'noid') + count(*) FILTER (why = 'again')) FROM ns"""


@SET.add("kg_validate_nodes", DIRTY_SQL + _NODE_ISSUES)
def _(spark, folder):
    nodes, _edges = dirty_graph(spark, folder)
    issues = graph_quality.node_issues(graph_quality.checked_nodes(nodes))
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


_EDGE_ISSUES = """
 SELECT 'uniqueness.duplicate_edge' AS code, 'error' AS severity, count(*) AS issues FROM eg WHERE dup HAVING count(*) > 0
 UNION ALL SELECT 'schema.unknown_relationship', 'warning', count(*) FROM eg WHERE relationship = 'LOOPS'
 UNION ALL SELECT 'schema.legacy_relationship_alias', 'warning', count(*) FROM eg WHERE relationship = 'USES_DATASET'
 UNION ALL SELECT 'referential.dangling_source', 'error', count(*) FROM eg WHERE st IS NULL
 UNION ALL SELECT 'referential.dangling_target', 'error', count(*) FROM eg WHERE tt IS NULL
 UNION ALL SELECT 'referential.self_loop_not_allowed', 'error', count(*) FROM eg WHERE loop
 UNION ALL SELECT 'referential.endpoint_type_mismatch', 'error', count(*) FROM eg WHERE mismatch"""


@SET.add("kg_validate_edges", DIRTY_SQL + _EDGE_ISSUES)
def _(spark, folder):
    nodes, edges = stored_graph(spark, folder, dirty_graph)
    checked = graph_quality.checked_edges(edges, graph_quality.checked_nodes(nodes))
    return graph_quality.edge_issues(checked).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


_MANY = """SELECT 'ANALYZED_DATASET' AS relationship, source, count(DISTINCT target) AS actual, 1 AS maximum FROM {e}
 WHERE relationship IN ('ANALYZED_DATASET', 'USES_DATASET') GROUP BY source HAVING count(DISTINCT target) > 1"""


@SET.add("kg_cardinality", DIRTY_SQL + _MANY.format(e="de"))
def _(spark, folder):
    _nodes, edges = dirty_graph(spark, folder)
    return graph_quality.cardinality_issues(edges)


@SET.add("kg_isolated", GRAPH_SQL + """
SELECT type, 'warning' AS severity, count(*) AS nodes FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges) GROUP BY 1""")
def _(spark, folder):
    found = graph_quality.isolated_nodes(*stored_graph(spark, folder))
    return found.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("nodes"))


@SET.add("kg_property_keys", "SELECT 'odd:' || o_orderkey AS id, 'Bad Key' AS property FROM orders WHERE o_orderkey % 90 = 5")
def _(spark, folder):
    nodes, _edges = dirty_graph(spark, folder)
    return graph_quality.property_key_issues(nodes)


_DIMENSION_COUNTS = f"""
, i AS ({_NODE_ISSUES} UNION ALL {_EDGE_ISSUES}
 UNION ALL SELECT 'cardinality', 'error', count(*) FROM ({_MANY.format(e='(SELECT * FROM eg WHERE accepted)')})
 UNION ALL SELECT 'coverage', CASE type WHEN 'python_file' THEN 'info' ELSE 'warning' END, count(*) FROM ns WHERE accepted
   AND id NOT IN (SELECT source FROM eg WHERE accepted) AND id NOT IN (SELECT target FROM eg WHERE accepted) GROUP BY 2),
 c AS (SELECT CASE WHEN code LIKE 'identity%' THEN 'identity' WHEN code LIKE 'uniqueness%' THEN 'uniqueness' WHEN code LIKE 'naming%' THEN 'naming'
   WHEN code LIKE 'schema%' THEN 'schema_compatibility' WHEN code LIKE 'property%' THEN 'property_completeness' WHEN code LIKE 'coverage%' THEN 'graph_coverage'
   ELSE 'referential_integrity' END AS dimension, severity, issues FROM i),
 d AS (SELECT unnest(['document_structure', 'identity', 'naming', 'uniqueness', 'referential_integrity', 'schema_compatibility', 'property_completeness', 'graph_coverage']) AS dimension),
 t AS (SELECT d.dimension, coalesce(sum(issues) FILTER (severity = 'error'), 0)::BIGINT AS errors, coalesce(sum(issues) FILTER (severity = 'warning'), 0)::BIGINT AS warnings,
   coalesce(sum(issues) FILTER (severity = 'info'), 0)::BIGINT AS infos FROM d LEFT JOIN c ON d.dimension = c.dimension GROUP BY 1)"""
_OF_DIMENSION = "".join(f""",
 CASE WHEN {d}_errors > 0 THEN 'fail' WHEN {d}_warnings + {d}_infos > 0 THEN 'warn' ELSE 'pass' END AS {d}, {d}_errors, {d}_warnings, {d}_infos""" for d in graph_quality.DIMENSIONS)


@SET.add("kg_report", DIRTY_SQL + _DIMENSION_COUNTS + f"""
, a AS (SELECT (SELECT count(*) FILTER (accepted) FROM ns) AS accepted_nodes, (SELECT count(*) FILTER (accepted) FROM eg) AS accepted_edges,
  (SELECT count(*) FILTER (NOT accepted) FROM ns) AS quarantined_nodes, (SELECT count(*) FILTER (NOT accepted) FROM eg) AS quarantined_edges,
  (SELECT count(*) FROM ns) AS node_records_total, (SELECT count(*) FROM eg) AS edge_records_total,
  (SELECT round(count(*) FILTER (accepted) / count(*), 6) FROM ns) AS node_acceptance_ratio,
  (SELECT round(count(*) FILTER (accepted) / count(*), 6) FROM eg) AS edge_acceptance_ratio),
 p AS (SELECT sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos, {', '.join(
    f"max({n}) FILTER (dimension = '{d}') AS {d}_{n}" for d in graph_quality.DIMENSIONS for n in ('errors', 'warnings', 'infos'))} FROM t)
SELECT CASE WHEN errors > 0 THEN 'invalid' WHEN accepted_nodes + accepted_edges = 0 THEN 'empty' WHEN warnings + infos > 0 THEN 'degraded' ELSE 'valid' END AS status,
 a.*, accepted_nodes + accepted_edges > 0 OR errors = 0 AS can_consume, errors = 0 AND quarantined_nodes + quarantined_edges = 0 AS can_write,
 errors, warnings, infos{_OF_DIMENSION} FROM a, p""")
def _(spark, folder):
    return graph_quality.quality_report(graph_quality.validate_graph(*stored_graph(spark, folder, dirty_graph)))


@SET.add("kg_dimensions", DIRTY_SQL + _DIMENSION_COUNTS + """
SELECT *, CASE WHEN errors > 0 THEN 'fail' WHEN warnings + infos > 0 THEN 'warn' ELSE 'pass' END AS status FROM t""")
def _(spark, folder):
    return graph_quality.quality_dimensions(graph_quality.validate_graph(*stored_graph(spark, folder, dirty_graph)).issues)


@SET.add("kg_governed_read", GRAPH_SQL + "SELECT type, count(*) AS nodes FROM nodes GROUP BY 1")
def _(spark, folder):
    nodes, _edges, _report = graph_quality.governed_read(*stored_graph(spark, folder), mode="enforce")
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))


@SET.add("kg_consistency", GRAPH_SQL + """
SELECT 'consistency.confidence_out_of_range' AS code, 'error' AS severity, count(*) AS issues FROM nodes WHERE type = 'analysis_run' AND confidence_score > 1 HAVING count(*) > 0
UNION ALL SELECT 'consistency.analysis_timestamp_invalid', 'error', count(*) FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT 'consistency.root_cause_without_anomaly_evidence', 'warning', count(*) FROM nodes WHERE type = 'root_cause'
  AND id NOT IN (SELECT source FROM edges WHERE relationship = 'EXPLAINS_ANOMALY') HAVING count(*) > 0""")
def _(spark, folder):
    nodes, edges = stored_graph(spark, folder, dirty_graph)
    issues = graph_quality.consistency_issues(nodes, edges)
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


@SET.add("kg_migrate", GRAPH_SQL + """
SELECT CASE relationship WHEN 'USES_DATASET' THEN 'ANALYZED_DATASET' ELSE relationship END AS relationship, count(*) AS edges FROM edges GROUP BY 1""")
def _(spark, folder):
    nodes, edges = analysis_graph(spark, folder)
    steps = [graph_quality.Migration(1, 2, edges=graph_quality.canonical_relationships)]
    _nodes, migrated = graph_quality.migrate(nodes, edges, steps, 1, 2)
    return migrated.groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"))
