"""Graph lookups, validation, experience, ranking and learning on small records."""

import difflib

import pytest
from pyspark.sql import functions as F

from tablewise.operators import experience, graph, graph_quality, learning, ranking

NODE = "id string, type string, label string, properties map<string,string>"
EDGE = "source string, target string, relationship string, properties map<string,string>"
RUN = {"created_at": "2026-01-01", "source_type": "csv", "row_count": "3", "column_count": "2"}
DATASET = {"source_type": "csv", "row_count": "3", "column_count": "2"}


def build(spark, nodes=(), edges=()):
    base_nodes = [("run", "analysis_run", "Run", RUN), ("data", "dataset", "Data", DATASET), *nodes]
    base_edges = [("run", "data", "ANALYZED_DATASET", {}), *edges]
    return spark.createDataFrame(base_nodes, NODE), spark.createDataFrame(base_edges, EDGE)


def codes(graph_):
    return sorted({r.code for r in graph_.issues.collect()})


def test_valid_graph(spark):
    checked = graph_quality.validate_graph(*build(spark))
    report = graph_quality.quality_report(checked).first()
    assert (report.status, report.accepted_nodes, report.accepted_edges, report.can_write) == ("valid", 2, 1, True)
    assert {r.status for r in graph_quality.quality_dimensions(checked.issues).collect()} == {"pass"}


def test_alias_is_a_warning(spark):
    nodes, edges = build(spark)
    edges = edges.withColumn("relationship", F.lit("USES_DATASET"))
    checked = graph_quality.validate_graph(nodes, edges)
    assert codes(checked) == ["schema.legacy_relationship_alias"]
    assert graph_quality.quality_report(checked).first().status == "degraded"


def test_each_defect_is_named(spark):
    nodes = [
        ("dup", "dataset", "x", DATASET), ("dup", "dataset", "y", DATASET), ("", "dataset", "z", DATASET), ("odd", "Strange", "", {"Bad Key": "1"}),
        ("file", "python_file", "f", {}), ("alone", "anomaly", "a", {"severity": "low", "affected_column": "c"}), ("bare", "report", "r", None),
        ("data2", "dataset", "d2", DATASET),
    ]
    edges = [
        ("run", "gone", "ANALYZED_DATASET", {}), ("run", "run", "SELF", {}), ("data", "run", "HAS_COLUMN", {}), ("run", "data2", "USES_DATASET", None),
        ("", "data", "has_column", {}), ("run", "bare", "GENERATED_REPORT", {}), ("run", "bare", "GENERATED_REPORT", {}),
    ]
    checked = graph_quality.validate_graph(*build(spark, nodes, edges))
    assert codes(checked) == sorted([
        "uniqueness.duplicate_node_id", "identity.node_id_missing_or_empty", "naming.node_type_not_lower_snake_case", "schema.unknown_node_type",
        "property.node_label_missing_or_empty", "naming.property_key_not_lower_snake_case", "property.required_node_property_missing",
        "property.node_properties_missing", "property.recommended_node_property_missing", "coverage.isolated_node", "referential.dangling_target",
        "schema.unknown_relationship", "referential.self_loop_not_allowed", "referential.endpoint_type_mismatch", "schema.legacy_relationship_alias",
        "property.edge_properties_missing", "structure.edge_source_missing_or_empty", "naming.relationship_not_upper_snake_case",
        "uniqueness.duplicate_edge", "cardinality.max_per_source_exceeded",
    ])
    report = graph_quality.quality_report(checked, "strict").first()
    assert (report.status, report.can_consume, report.can_write) == ("invalid", False, False)
    assert {r.id for r in checked.accepted_nodes.collect()} == {"run", "data", "odd", "alone", "bare", "data2"}


def test_governed_read(spark):
    nodes, edges = build(spark, [("", "dataset", "bad", {})])
    assert graph_quality.governed_read(nodes, edges)[0].count() == 3
    assert graph_quality.governed_read(nodes, edges, "observe")[2].first().status == "invalid"
    with pytest.raises(graph_quality.GraphBlocked):
        graph_quality.governed_read(nodes, edges, "enforce")


def test_consistency(spark):
    nodes, edges = build(spark, [
        ("r2", "analysis_run", "x", {"created_at": "yesterday", "confidence_score": "1.5"}), ("c1", "root_cause", "c", {}),
        ("c2", "root_cause", "c", {"related_anomalies": "a"}),
    ])
    issues = graph_quality.consistency_issues(nodes, edges, [lambda n, e: n.where("false").select(
        F.col("id").alias("record_id"), F.lit("x").alias("code"), F.lit("error").alias("severity"))])
    assert sorted((r.record_id, r.code.split(".")[1]) for r in issues.collect()) == [
        ("c1", "root_cause_without_anomaly_evidence"), ("r2", "analysis_timestamp_invalid"), ("r2", "confidence_out_of_range")]
    assert graph_quality.consistency_status(issues).first().status == "inconsistent"


def test_migration_takes_the_shortest_path(spark):
    steps = [graph_quality.Migration(1, 2), graph_quality.Migration(2, 3), graph_quality.Migration(1, 3, edges=graph_quality.canonical_relationships)]
    assert [(s.from_version, s.to_version) for s in graph_quality.migration_steps(steps, 1, 3)] == [(1, 3)]
    with pytest.raises(ValueError):
        graph_quality.migration_steps(steps, 3, 4)


def test_lookups(spark):
    nodes, edges = build(spark, [("col", "dataframe_column", "price", {"name": "price", "dtype": "double"})],
                         [("run", "col", "HAS_COLUMN", {}), ("data", "col", "HAS_COLUMN", {}), ("run", "data", "USES_DATASET", {})])
    around = graph.neighbors(nodes, edges, "col", "in").collect()
    assert sorted(r.neighbor_id for r in around) == ["data", "run"]
    assert {(r.bucket, r.elements) for r in graph.lineage_counts(graph.lineage(nodes, edges)).collect()} == {("dataset", 1), ("columns", 1)}
    with pytest.raises(ValueError):
        graph.neighbors(nodes, edges, "col", "up")
    assert graph.find_nodes(nodes, property_filters={"SOURCE_TYPE": "csv"}).count() == 0
    assert graph.find_nodes(nodes, property_filters={"source_type": "CSV"}).count() == 2


def history(spark):
    nodes, edges = [], []
    for i in (1, 2):
        nodes += [
            (f"run{i}", "analysis_run", f"Run {i}", {"created_at": f"2026-01-0{i}", "primary_metric": "response_time", "time_axis": "created_at", "source_type": "csv"}),
            (f"col{i}", "dataframe_column", "response_time" if i == 1 else "queue", {}), (f"an{i}", "anomaly", "sla_violation", {"affected_column": "response_time"}),
            (f"rc{i}", "root_cause", "Performance Degradation infrastrutturale", {}),
        ]
        edges += [(f"run{i}", f"col{i}", "HAS_COLUMN", {}), (f"run{i}", f"an{i}", "DETECTED_ANOMALY", {}), (f"run{i}", f"rc{i}", "IDENTIFIED_ROOT_CAUSE", {})]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_experience(spark):
    nodes, edges = history(spark)
    headers, items = experience.experience_all(nodes, edges)
    ids = {r.experience_id: r.confidence for r in headers.collect()}
    assert ids == {
        "experience.metric.response_time": 0.69, "experience.anomaly.sla_violation": 0.7,
        "experience.root_cause.performance_degradation_infrastrutturale": 0.72,
    }
    metric = {(r.item_kind, r.value) for r in items.where("experience_id = 'experience.metric.response_time'").collect()}
    assert ("column", "queue") in metric and ("step", experience.STEP_INFRASTRUCTURE) in metric and ("tag", "created_at") in metric
    best = experience.experience_recommend(headers, items, {"metric": ["response_time"], "anomaly": ["sla_violation"]}, 3).collect()
    assert best[0].priority == "high" and best[0].step == experience.STEP_INFRASTRUCTURE
    diff = {(r.kind, r.label, r.state) for r in graph.latest_run_diff(nodes, edges).collect()}
    assert ("columns", "queue", "added") in diff and ("columns", "response_time", "removed") in diff
    assert ("anomalies", "sla_violation:response_time", "common") in diff
    back = {(r.kind, r.label, r.state) for r in graph.run_diff(nodes, edges, "run2", "run1").collect()}
    swap = {"added": "removed", "removed": "added", "common": "common"}
    assert back == {(k, v, swap[s]) for k, v, s in diff}


def test_same_signature_keeps_the_greatest_id(spark):
    headers, items = experience.experience_all(*history(spark))
    kept = {r.experience_id for r in experience.experience_upsert(headers, items).collect()}
    assert kept == {"experience.root_cause.performance_degradation_infrastrutturale"}


def test_recommendations(spark):
    rows = [("safe", 0.8, 0.8, 0.6, "low"), ("medium", 0.9, 0.9, 0.8, "medium"), ("weak", 0.4, 0.3, 0.1, "low"), ("faint", 0.2, 0.9, 0.9, "low")]
    df = spark.createDataFrame([(*r, "general", r[0]) for r in rows],
                               "candidate_id string, confidence double, evidence_strength double, urgency double, risk string, domain string, action string")
    ranked = ranking.recommend_rank(df).orderBy("rank").collect()
    assert [r.candidate_id for r in ranked] == ["medium", "safe", "weak"] and ranked[0].score == 0.8 and ranked[0].priority == "high"
    assert [r.candidate_id for r in ranking.recommend_rank(df, maximum_risk="low", limit=1).collect()] == ["safe"]


def test_decisions(spark):
    options = spark.createDataFrame(
        [(s, s, 0.7, "low", ["e1", "e2"] if s != "anomaly" else ["e1", "lost"]) for s in ("strategy", "anomaly", "root_cause", "recommendation")]
        + [("none", "strategy", 0.9, "low", ["lost"])], "option_id string, source string, base_confidence double, risk string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", 0.9, 0.9, 0.9), ("e2", 0.8, 0.9, 0.9)], "evidence_id string, strength double, reliability double, confidence double")
    ranked = ranking.decision_rank(options, evidence).orderBy("rank").collect()
    assert [r.option_id for r in ranked] == ["recommendation", "root_cause", "strategy", "anomaly"]
    assert ranked[-1].missing == 1
    assert ranking.decision_rank(options, evidence.limit(0)).count() == 0


def test_learning(spark):
    rows = [("good", kind, text) for _ in range(3) for kind, text in (("usage", None), ("feedback", "positive"))]
    rows += [("bad", "feedback", "negative")] * 2 + [("new", "usage", None)]
    df = spark.createDataFrame(rows, "pattern_id string, event_type string, feedback string")
    found = {r.pattern_id: (r.confidence, r.status) for r in learning.learning_confidence(df).collect()}
    assert found["good"] == (round(4 / 5 * 0.86 + 0.06, 4), "promoted") and found["bad"][1] == "demoted" and found["new"] == (0.45, "candidate")


def test_history_and_actions(spark):
    rows = [(1, "count orders per month", "csv", 0.9, 3, None), (2, "something else entirely", "csv", 0.9, 3, None), (3, "count orders per month", "sql", 0.9, 3, None)]
    df = spark.createDataFrame(rows, "id int, description string, source_type string, feedback_score double, success_count int, embedding array<double>")
    found = learning.history_similarity(df, "Count  orders per months", "csv", vector=[1.0, 0.0]).collect()
    expected = difflib.SequenceMatcher(None, "count orders per months", "count orders per month").ratio()
    assert [(r.id, r.method) for r in found] == [(1, "text")] and found[0].similarity == pytest.approx(expected)
    entries = spark.createDataFrame([(1, ["sales"], ["Call", "Ship"], 0.5), (2, ["other"], ["call ", ""], 0.9)], "id int, tags array<string>, recommendations array<string>, score double")
    assert [(r.action, r.weight) for r in learning.next_actions(entries, "sales plan").collect()] == [("Ship", 3.4), ("call", 1.9)]


def test_gates_fail_on_missing_evidence(spark):
    names = ("cases_total", "cases_domains", "feedback_total", "feedback_correct", "load_concurrency", "load_error_rate", "tenant_isolation_passed",
             "unsupported_requests_passed", "backup_restore_passed", "retention_delete_passed", "monitoring_passed", "open_critical_bugs")
    empty = spark.range(1).select(*[F.lit(None).alias(n) for n in names])
    assert {r.passed for r in learning.readiness_gates(empty).collect()} == {False}


def leaves(frame):
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_lookups_read_their_inputs_once(spark, tmp_path):
    for name, schema in (("nodes", "id string, type string, label string, properties map<string,string>"),
                         ("edges", "source string, target string, relationship string, properties map<string,string>")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    nodes, edges = (spark.read.parquet(str(tmp_path / name)) for name in ("nodes", "edges"))
    assert leaves(graph.lineage(nodes, edges)) == 3
    assert leaves(graph.endpoint_types(nodes, edges)) == 3
    assert leaves(graph.induced_edges(nodes, edges)) == 3
    assert leaves(graph.dangling_edges(nodes, edges)) == 4
    assert leaves(graph_quality.checked_edges(edges, graph_quality.checked_nodes(nodes))) <= 12


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_by_text_sort_by_a_hash(spark):
    nodes, edges = build(spark, edges=[(None, "data", "ANALYZED_DATASET", {}), ("run", "gone", "HAS_COLUMN", {})])
    found = graph.dangling_edges(nodes, edges)
    assert sorted(map(tuple, found.collect()), key=str) == [("run", "gone", "HAS_COLUMN", "target"), (None, "data", "ANALYZED_DATASET", "source")]
    assert "xxhash64" in plan(found) and "Aggregate" not in plan(found)


def test_repeats_are_found_by_digests(spark):
    twice = [("a", "dataset", "A", DATASET)] * 3 + [("", "dataset", "B", DATASET)] * 2 + [(None, "dataset", "C", DATASET)] * 2
    nodes, edges = build(spark, twice, [("run", "a", "HAS_COLUMN", {})] * 2 + [("run", None, "HAS_COLUMN", {})] * 2)
    checked = graph_quality.checked_nodes(nodes)
    repeated = lambda frame, code: sorted(r.detail for r in frame.where(F.col("code") == code).collect())
    assert repeated(graph_quality.node_issues(checked), "uniqueness.duplicate_node_id") == ["3"] * 3
    found = graph_quality.edge_issues(graph_quality.checked_edges(edges, checked))
    assert repeated(found, "uniqueness.duplicate_edge") == ["2"] * 2
    # All records are only looked up: the repeated ids are counted apart and written.
    assert "Aggregate" not in plan(checked)


def test_equal_edges_collapse_and_others_stay(spark):
    rows = [("r", "d", "USES_DATASET", {"b": "1"}), ("r", "d", "ANALYZED_DATASET", {"a": "1"}), ("r", None, "HAS_COLUMN", None), ("r", None, "HAS_COLUMN", None), ("r", "x", "HAS_COLUMN", {"k": "v"})]
    found = graph_quality.canonical_relationships(spark.createDataFrame(rows, EDGE))
    assert sorted(map(tuple, found.collect()), key=str) == [("r", "d", "ANALYZED_DATASET", {"a": "1"}), ("r", "x", "HAS_COLUMN", {"k": "v"}), ("r", None, "HAS_COLUMN", None)]
    assert "xxhash64" in plan(found)


def test_kinds_are_built_in_one_pass(spark):
    headers, items = experience.experience_all(*history(spark))
    assert leaves(headers) == 1
    apart = [experience.experience_build(*history(spark), kind) for kind in experience.EXPERIENCE_CONFIDENCE]
    assert sorted(map(tuple, headers.collect())) == sorted(tuple(r) for h, _ in apart for r in h.collect())
    assert sorted(map(tuple, items.collect())) == sorted(tuple(r) for _, i in apart for r in i.collect())


def test_similar_runs_walk_the_lineage_once(spark, tmp_path):
    nodes, edges = build(spark)
    nodes.write.parquet(str(tmp_path / "nodes"))
    edges.write.parquet(str(tmp_path / "edges"))
    found = experience.run_similarity(spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "edges")), {"source_type": "csv", "keywords": ["run"]})
    assert leaves(found) == 5
    assert [r.run_id for r in found.collect()] == ["run"]


def test_report_has_all_dimensions(spark):
    nodes, edges = build(spark, [("odd", "Strange", "", {"Bad Key": "1"}), ("file", "python_file", "f", {}), ("alone", "python_file", "g", {"path": "g"})], [("run", "gone", "HAS_COLUMN", {})])
    checked = graph_quality.validate_graph(nodes, edges)
    report = graph_quality.quality_report(checked).first()
    apart = {r.dimension: r for r in graph_quality.quality_dimensions(checked.issues).collect()}
    assert set(apart) == set(graph_quality.DIMENSIONS)
    for name, row in apart.items():
        assert (report[name], report[f"{name}_errors"], report[f"{name}_warnings"], report[f"{name}_infos"]) == (row.status, row.errors, row.warnings, row.infos), name
    assert (report.property_completeness, report.naming, report.uniqueness, report.referential_integrity) == ("fail", "warn", "pass", "fail")
    assert (report.graph_coverage_infos, report.graph_coverage_warnings) == (1, 1)
    assert (report.errors, report.infos) == (2, 1) and report.warnings == sum(r.warnings for r in apart.values())
    assert (report.node_records_total, report.edge_records_total, report.quarantined_nodes, report.quarantined_edges) == (5, 2, 1, 1)


@pytest.mark.parametrize("version, status, consume, code", [
    (None, "degraded", True, "schema.version_missing_assumed_v1"), (2, "unsupported", False, "schema.future_version"), (0, "invalid", False, "schema.version_invalid")])
def test_report_states_the_version(spark, version, status, consume, code):
    checked = graph_quality.validate_graph(*build(spark), version=version)
    report = graph_quality.quality_report(checked).first()
    assert codes(checked) == [code] and (report.status, report.can_consume, report.can_write) == (status, consume, consume)
    assert (report.quarantined_nodes, report.schema_compatibility) == (0, "fail" if not consume else "warn")
    assert report.naming == ("pass" if consume else "not_evaluated")
