"""Similar runs, experience, recommendations, decisions and learning over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import numeric
from tablewise.operators import experience, learning, ranking
from tablewise.plans.graph_queries import GRAPH_SQL, stored_graph
from tablewise.plans.registry import QuerySet, table
from tablewise.streaming import monitors

SET = QuerySet()

PROFILE = {
    "columns": ["brand#1", "brand#7", "brand#12", "other"], "primary_metric": "1-URGENT", "time_axis": "o_orderdate",
    "source_type": "f", "roles": ["metric", "key"], "row_count": 100, "column_count": 5, "keywords": ["order", "urgent", "brand"],
}


@SET.add("run_similarity", GRAPH_SQL + """
, col AS (SELECT run_id, count(DISTINCT label) AS n, count(DISTINCT label) FILTER (label IN ('brand#1', 'brand#7', 'brand#12', 'other')) AS h
   FROM lineage WHERE bucket = 'columns' GROUP BY 1),
 txt AS (SELECT id AS run_id, lower(label || ' ' || primary_metric || ' ' || time_axis) AS t FROM nodes WHERE type = 'analysis_run'
   UNION ALL SELECT run_id, lower(label) FROM lineage WHERE bucket IN ('columns', 'anomalies', 'root_causes')),
 tok AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(t, '([a-z0-9_]{3,})')) AS w FROM txt),
 kw AS (SELECT run_id, count(*) AS n, count(*) FILTER (w IN ('order', 'urgent', 'brand')) AS h FROM tok GROUP BY 1),
 s AS (SELECT r.id AS run_id, r.label, r.created_at, 0.26 * coalesce(col.h / (col.n + 4 - col.h), 0) + 0.20 * (primary_metric = '1-urgent')::INT
   + 0.12 * (time_axis = 'o_orderdate')::INT + 0.10 * (source_type = 'f')::INT + 0.14 * CASE WHEN col.n > 0 THEN 0.5 ELSE 0 END
   + 0.10 * ((1 - least(abs(ln(1 + 100) - ln(1 + row_count)) / 6, 1)) + (1 - abs(5 - column_count) / greatest(5, column_count, 1))) / 2
   + 0.08 * coalesce(kw.h / (kw.n + 3 - kw.h), 0) AS score FROM nodes r LEFT JOIN col ON col.run_id = r.id LEFT JOIN kw ON kw.run_id = r.id
   WHERE r.type = 'analysis_run')
SELECT run_id, label, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY round(score, 4) DESC, created_at DESC, run_id DESC LIMIT 20""")
def _(spark, folder):
    return experience.run_similarity(*stored_graph(spark, folder), PROFILE, 20)


@SET.add("recurring_patterns", GRAPH_SQL + """
, v AS (SELECT 'metrics' AS kind, primary_metric AS value FROM nodes WHERE type = 'analysis_run'
  UNION ALL SELECT bucket, lower(label) FROM lineage WHERE bucket IN ('columns', 'anomalies', 'root_causes', 'reports')
  UNION ALL SELECT 'metrics', affected FROM lineage WHERE bucket = 'root_causes'),
 c AS (SELECT kind, value, count(*) AS occurrences FROM v GROUP BY 1, 2 HAVING count(*) >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY occurrences DESC, value) AS rank FROM c)
SELECT kind, value, occurrences, rank, round(0.45 + 0.55 * (SELECT count(DISTINCT kind) FROM r) / 6, 4) AS confidence FROM r""")
def _(spark, folder):
    return experience.recurring_patterns(*stored_graph(spark, folder))


_EXPERIENCE = GRAPH_SQL + """
, rv AS (SELECT DISTINCT run_id, CASE bucket WHEN 'columns' THEN 'column' WHEN 'anomalies' THEN 'anomaly' ELSE 'root_cause' END AS item_kind, label AS value
   FROM lineage WHERE bucket IN ('columns', 'anomalies', 'root_causes')
   UNION ALL SELECT id, 'metric', primary_metric FROM nodes WHERE type = 'analysis_run'),
 hd AS (SELECT item_kind AS kind, value AS key, count(*) AS evidence_count, max(created_at) AS updated_at FROM rv JOIN nodes n ON n.id = rv.run_id
   WHERE item_kind <> 'column' GROUP BY 1, 2 HAVING count(*) >= 2),
 heads AS (SELECT *, 'experience.' || kind || '.' || regexp_replace(lower(key), '[ /-]', '_', 'g') AS experience_id,
   round(least(1.0, CASE kind WHEN 'metric' THEN 0.45 + 0.12 * evidence_count WHEN 'anomaly' THEN 0.4 + 0.15 * evidence_count ELSE 0.42 + 0.15 * evidence_count END), 2)::DOUBLE AS confidence FROM hd),
 own AS (SELECT experience_id, kind AS item_kind, key AS value FROM heads),
 it AS (SELECT DISTINCT h.experience_id, x.item_kind, x.value FROM heads h JOIN rv m ON m.item_kind = h.kind AND m.value = h.key
   JOIN rv x ON x.run_id = m.run_id WHERE x.item_kind <> h.kind UNION ALL SELECT * FROM own),
 st AS (SELECT h.experience_id, (SELECT min(value) FROM it WHERE it.experience_id = h.experience_id AND item_kind = 'metric') AS metric,
   (SELECT arg_min(n.time_axis, n.id) FROM rv m JOIN nodes n ON n.id = m.run_id WHERE m.item_kind = h.kind AND m.value = h.key) AS axis,
   (SELECT count(*) FROM it WHERE it.experience_id = h.experience_id AND item_kind = 'anomaly') > 0 AS an,
   (SELECT count(*) FROM it WHERE it.experience_id = h.experience_id AND item_kind = 'root_cause' AND value LIKE '%backlog%') > 0 AS inf, h.kind, h.key FROM heads h),
 steps AS (SELECT experience_id, 'step' AS item_kind, 'Analizzare il trend temporale di ' || metric || ' su ' || axis AS value FROM st
   UNION ALL SELECT experience_id, 'step', 'Calcolare percentili e distribuzione di ' || metric FROM st
   UNION ALL SELECT experience_id, 'step', 'Eseguire un controllo outlier sulla metrica primaria' FROM st WHERE an
   UNION ALL SELECT experience_id, 'step', 'Applicare una segmentazione per isolare i cluster anomali' FROM st WHERE an
   UNION ALL SELECT experience_id, 'step', 'Eseguire una verifica infrastrutturale mirata' FROM st WHERE inf),
 tags AS (SELECT experience_id, 'tag' AS item_kind, unnest(CASE kind WHEN 'metric' THEN ['metric', key, axis] WHEN 'anomaly' THEN ['anomaly', key, 'recurring']
   ELSE ['root-cause', 'recurring', 'infrastructure'] END) AS value FROM st),
 items AS (SELECT * FROM it UNION ALL SELECT * FROM steps UNION ALL SELECT * FROM tags)
"""


def _heads_sql(kind):
    return _EXPERIENCE + f"SELECT experience_id, kind, key, confidence, evidence_count, updated_at FROM heads WHERE kind = '{kind}'"


def _heads(kind):
    def run(spark, folder):
        return experience.experience_build(*stored_graph(spark, folder), kind)[0]

    return run


for _name, _kind in (("experience_metric", "metric"), ("experience_anomaly", "anomaly"), ("experience_cause", "root_cause")):
    SET.add(_name, _heads_sql(_kind))(_heads(_kind))


@SET.add("experience_steps", _EXPERIENCE + "SELECT experience_id, value AS step FROM items WHERE item_kind = 'step'")
def _(spark, folder):
    _heads_table, items = experience.experience_all(*stored_graph(spark, folder))
    return items.where("item_kind = 'step'").select("experience_id", F.col("value").alias("step"))


@SET.add("experience_items", _EXPERIENCE + "SELECT item_kind, count(*) AS items, count(DISTINCT value) AS distinct_values FROM items GROUP BY 1")
def _(spark, folder):
    _heads_table, items = experience.experience_all(*stored_graph(spark, folder))
    return items.groupBy("item_kind").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("value").alias("distinct_values"))


MATCH_PROFILE = {
    "metric": ["1-urgent"], "column": ["brand#3"], "anomaly": ["sla_violation"], "root_cause": ["backlog nation 4"], "tag": ["recurring"],
}
_SCORED = """
, sc AS (SELECT experience_id, round(0.35 * max((item_kind = 'metric' AND value = '1-urgent')::INT) + 0.2 * max((item_kind = 'column' AND value = 'brand#3')::INT)
   + 0.2 * max((item_kind = 'anomaly' AND value = 'sla_violation')::INT) + 0.15 * max((item_kind = 'root_cause' AND value = 'backlog nation 4')::INT)
   + 0.1 * max((item_kind = 'tag' AND value = 'recurring')::INT), 4)::DOUBLE AS score FROM items GROUP BY 1),
 mt AS (SELECT experience_id, score, confidence, evidence_count FROM sc JOIN heads USING (experience_id) WHERE score > 0)"""


@SET.add("experience_match", _EXPERIENCE + _SCORED + "SELECT * FROM mt")
def _(spark, folder):
    return experience.experience_match(*experience.experience_all(*stored_graph(spark, folder)), MATCH_PROFILE)


@SET.add("experience_recommend", _EXPERIENCE + _SCORED + """
, g AS (SELECT value AS step, max(round(least(1.0, score * 0.6 + confidence * 0.4), 4))::DOUBLE AS confidence, count(DISTINCT experience_id) AS sources
   FROM items JOIN mt USING (experience_id) WHERE item_kind = 'step' GROUP BY 1),
 p AS (SELECT *, CASE WHEN lower(step) LIKE '%verifica infrastrutturale%' THEN 'high' WHEN lower(step) LIKE '%outlier%' OR lower(step) LIKE '%segmentazione%' THEN 'medium' ELSE 'low' END AS priority FROM g)
SELECT step, priority, confidence, sources FROM p""")
def _(spark, folder):
    return experience.experience_recommend(*experience.experience_all(*stored_graph(spark, folder)), MATCH_PROFILE)


@SET.add("experience_find", _EXPERIENCE + """
SELECT experience_id, kind, key, confidence, evidence_count, updated_at FROM heads WHERE experience_id IN (
  SELECT experience_id FROM items WHERE item_kind = 'anomaly' AND value = 'sudden_change')""")
def _(spark, folder):
    built = experience.experience_all(*stored_graph(spark, folder))
    return experience.experience_find(*built, "anomaly", "SUDDEN_change")


@SET.add("experience_tops", _EXPERIENCE + """
, c AS (SELECT item_kind, value, count(*) AS frequency FROM items WHERE item_kind IN ('metric', 'anomaly', 'root_cause', 'tag') GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_kind ORDER BY frequency DESC, value) AS rank FROM c)
SELECT item_kind, value, frequency, rank, round(least(1.0, 0.3 + frequency * 0.12), 2)::DOUBLE AS confidence FROM r""")
def _(spark, folder):
    return experience.experience_tops(experience.experience_all(*stored_graph(spark, folder))[1])


@SET.add("exp_upsert", _EXPERIENCE + """
, sg AS (SELECT h.experience_id, coalesce(
   (SELECT 'a' || string_agg(DISTINCT lower(value), '|' ORDER BY lower(value)) FROM items i WHERE i.experience_id = h.experience_id AND item_kind = 'anomaly'),
   (SELECT 'c' || string_agg(DISTINCT lower(value), '|' ORDER BY lower(value)) FROM items i WHERE i.experience_id = h.experience_id AND item_kind = 'root_cause'),
   (SELECT 'm' || string_agg(DISTINCT lower(value), '|' ORDER BY lower(value)) FROM items i WHERE i.experience_id = h.experience_id AND item_kind = 'metric')) AS sig FROM heads h)
SELECT experience_id, kind, key, confidence, evidence_count, updated_at FROM heads WHERE experience_id IN (SELECT max(experience_id) FROM sg GROUP BY sig)""")
def _(spark, folder):
    return experience.experience_upsert(*experience.experience_all(*stored_graph(spark, folder)))


CANDIDATES_SQL = """
WITH cand AS (SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS candidate_id, 'act ' || l_shipdate::DATE AS action,
   l_discount * 10 AS confidence, l_quantity / 50 AS evidence_strength, l_tax * 10 AS urgency,
   ['low', 'medium', 'high', 'critical'][1 + l_linenumber % 4] AS risk, CASE l_returnflag WHEN 'A' THEN 'general' WHEN 'N' THEN 'sales' ELSE 'ops' END AS domain,
   l_suppkey AS tenant, l_orderkey, l_linenumber, l_partkey FROM lineitem),
 sc AS (SELECT DISTINCT *, round(least(1.0, greatest(0.0, confidence * 0.5 + evidence_strength * 0.3 + urgency * 0.2 - CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 0.08 WHEN 'high' THEN 0.2 ELSE 0.4 END)), 4) AS score FROM cand
   WHERE confidence >= 0.35 AND risk <> 'critical' AND domain IN ('general', 'sales'))
"""


def candidates(spark, folder):
    risk = F.element_at(F.array(*[F.lit(r) for r in ranking.RISKS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    domain = F.when(F.col("l_returnflag") == "A", "general").when(F.col("l_returnflag") == "N", "sales").otherwise("ops")
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.concat(F.lit("c"), F.col("l_orderkey").cast("string")), "l_linenumber", "l_partkey").alias("candidate_id"),
        F.concat(F.lit("act "), F.col("l_shipdate").cast("date").cast("string")).alias("action"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_quantity") / 50).alias("evidence_strength"),
        (F.col("l_tax") * 10).alias("urgency"), risk.alias("risk"), domain.alias("domain"), F.col("l_suppkey").alias("tenant"),
    )


@SET.add("recommend_rank", CANDIDATES_SQL + """
SELECT tenant, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS priority, rank::INT AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, risk, candidate_id) AS rank FROM sc) WHERE rank <= 5""")
def _(spark, folder):
    ranked = ranking.recommend_rank(candidates(spark, folder), domain="sales", maximum_risk="high", keys=["tenant"])
    return ranked.select("tenant", "score", "priority", "rank")


@SET.add("candidate_build", """
WITH a AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'sla_violation' ELSE 'numeric_outlier' END AS t, event_type AS c FROM events),
 x AS (SELECT 'anomaly' AS source, 'Validate anomaly ' || t || ' on ' || c AS action, 0.72 AS confidence, 'medium' AS risk,
   CASE t WHEN 'sla_violation' THEN 0.9 ELSE 0.55 END AS urgency FROM a
   UNION ALL SELECT DISTINCT 'root_cause', 'Investigate root cause: supplier ' || s_nationkey, 0.68, 'medium', 0.9 FROM supplier
   UNION ALL SELECT DISTINCT 'experience', 'Check ' || p_type, 0.8, 'low', 0.5 FROM part)
SELECT source || ':' || sha256(source || '|' || action)[1:16] AS candidate_id, action, confidence::DOUBLE AS confidence, confidence::DOUBLE AS evidence_strength,
 urgency::DOUBLE AS urgency, risk, 'general' AS domain, source FROM x""")
def _(spark, folder):
    error = F.col("event_type") == "error"
    anomalies = table(spark, folder, "events").select(
        F.when(error, "sla_violation").otherwise("numeric_outlier").alias("anomaly_type"), F.col("event_type").alias("affected_column"),
        F.when(error, "high").otherwise("low").alias("severity"),
    )
    causes = table(spark, folder, "supplier").select(F.concat(F.lit("supplier "), F.col("s_nationkey").cast("string")).alias("title"))
    steps = table(spark, folder, "part").select(
        F.concat(F.lit("Check "), F.col("p_type")).alias("step"), F.lit("medium").alias("priority"), F.lit(0.8).alias("confidence"))
    return ranking.candidate_build(steps=steps, anomalies=anomalies, causes=causes)


DECISION_SQL = """
WITH ev AS (SELECT 's' || s_suppkey AS evidence_id, (s_acctbal + 1000) / 11987 AS strength, 0.87::DOUBLE AS reliability, 0.83::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 5 <> 0),
 op AS (SELECT 'o' || o_orderkey AS option_id, ['anomaly', 'recommendation', 'root_cause', 'strategy'][1 + o_orderkey % 4] AS source,
   o_totalprice / 499979 AS base, ['low', 'medium', 'high'][1 + o_custkey % 3] AS risk, o_orderkey FROM orders),
 le AS (SELECT option_id, 's' || l_suppkey AS eid FROM op JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey),
 ag AS (SELECT option_id, count(*) AS listed, count(evidence_id) AS present, count(*) - count(evidence_id) AS missing,
   round(avg(strength * reliability * confidence), 4) AS evidence_score FROM le LEFT JOIN ev ON eid = evidence_id GROUP BY 1),
 sc AS (SELECT *, round(least(1.0, greatest(0.0, base * 0.35 + evidence_score * present / listed * 0.5 + 0.15 * CASE source WHEN 'strategy' THEN 0.55 WHEN 'anomaly' THEN 0.65
   WHEN 'root_cause' THEN 0.85 ELSE 1.0 END - CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 0.08 ELSE 0.2 END)), 4) AS score FROM ag JOIN op USING (option_id) WHERE present > 0)
"""


def _options(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    evidence_ids = lines.groupBy("l_orderkey").agg(
        F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("evidence_ids"))
    source = F.element_at(F.array(*[F.lit(s) for s in ("anomaly", "recommendation", "root_cause", "strategy")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    risk = F.element_at(F.array(*[F.lit(r) for r in ("low", "medium", "high")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    options = orders.join(evidence_ids, orders.o_orderkey == evidence_ids.l_orderkey).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("option_id"), source.alias("source"),
        (F.col("o_totalprice") / 499979).alias("base_confidence"), risk.alias("risk"), "evidence_ids",
    )
    evidence = table(spark, folder, "supplier").where("s_suppkey % 5 <> 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("evidence_id"),
        ((F.col("s_acctbal") + 1000) / 11987).alias("strength"), F.lit(0.87).alias("reliability"), F.lit(0.83).alias("confidence"),
    )
    return options, evidence


@SET.add("decision_evidence_join", DECISION_SQL + "SELECT option_id, listed, present, missing, evidence_score FROM ag")
def _(spark, folder):
    return ranking.decision_evidence(*_options(spark, folder))


@SET.add("decision_rank", DECISION_SQL + """
SELECT option_id, source, score, row_number() OVER (ORDER BY score DESC, source, option_id) AS rank FROM sc WHERE score >= 0.4""")
def _(spark, folder):
    ranked = ranking.decision_rank(*_options(spark, folder))
    return ranked.select("option_id", "source", "score", "rank")


@SET.add("rank_enumerate", """
SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def _(spark, folder):
    from tablewise.operators.ordering import row_numbers

    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    ranked = row_numbers(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderstatus"])
    return ranked.select("o_orderstatus", "o_orderkey", "rank")


def usage_log(spark, folder):
    """Events as a usage and feedback log per user."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("pattern_id"),
        F.when(kind.isin("view", "click"), "usage").otherwise("feedback").alias("event_type"),
        learning.feedback_kind(F.when(kind == "purchase", "OK").when(kind == "error", "Non  utile").otherwise("boh")).alias("feedback"),
        "ts",
    )


LOG_SQL = """
WITH c AS (SELECT 'p' || (user_id % 40) AS pattern_id, count(*) FILTER (event_type IN ('view', 'click')) AS usage_count,
   count(*) FILTER (event_type = 'purchase') AS success_count, count(*) FILTER (event_type = 'error') AS failure_count,
   count(*) FILTER (event_type = 'signup') AS neutral_count FROM events GROUP BY 1),
 k AS (SELECT *, round(cast(least(1.0, greatest(0.0, (success_count + 0.5 * neutral_count + 1.0)::DOUBLE / (success_count + failure_count + neutral_count + 2.0)::DOUBLE * 0.86
   + least(0.16, usage_count * 0.02) - least(0.24, failure_count * 0.08))) AS DECIMAL(20, 12)), 4)::DOUBLE AS confidence FROM c),
 l AS (SELECT *, CASE WHEN confidence >= 0.72 AND usage_count >= 2 AND success_count >= 2 THEN 'promoted'
   WHEN confidence <= 0.28 OR (failure_count >= 2 AND failure_count > success_count) THEN 'demoted' ELSE 'candidate' END AS status FROM k)
"""


@SET.add("learning_confidence", LOG_SQL + "SELECT * FROM l")
def _(spark, folder):
    return learning.learning_confidence(usage_log(spark, folder))


@SET.add("feedback_fold_stream", LOG_SQL + "SELECT pattern_id, usage_count, success_count, status FROM l")
def _(spark, folder):
    folded = monitors.feedback_fold(usage_log(spark, folder))
    return folded.select("pattern_id", "usage_count", "success_count", "status")


@SET.add("rate_breach_stream", """
SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, folder):
    return monitors.rate_breaches(table(spark, folder, "events"), "ts", ["user_id"], 1, window="1 hour")


@SET.add("rate_breach_sliding", """
SELECT DISTINCT user_id, ts AS moment, requests FROM (SELECT user_id, ts, count(*) OVER (
  PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS requests FROM events) WHERE requests > 1""")
def _(spark, folder):
    return monitors.sliding_breaches(table(spark, folder, "events"), "ts", ["user_id"], 1, seconds=3600)


@SET.add("sla_monitor_stream", """
SELECT date_trunc('day', ts) AS window_start, count(value) AS valid_count, count(*) FILTER (value <= 60) AS compliant_count,
 count(*) FILTER (value > 60) AS breach_count FROM events GROUP BY 1""")
def _(spark, folder):
    return monitors.sla_monitor(table(spark, folder, "events"), "ts", "value", 60, window="1 day")


@SET.add("learning_rank", LOG_SQL + """
, p AS (SELECT DISTINCT 'p' || (p_partkey % 60) AS pattern_id, p_partkey % 60 AS k FROM part)
SELECT p.pattern_id, round(coalesce(confidence, k / 100.0), 4)::DOUBLE AS confidence,
 round(least(1.0, coalesce(confidence, k / 100.0) * 0.75 + (CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END) * 0.25), 6)::DOUBLE AS recommendation_score FROM p LEFT JOIN l USING (pattern_id)""")
def _(spark, folder):
    k = F.col("p_partkey") % 60
    patterns = table(spark, folder, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"), (k / 100.0).alias("confidence_score"),
        F.when(k % 2 == 0, F.array(F.lit("trend"), F.lit("per mese"), F.lit("zzz"))).otherwise(F.array(F.lit("TREND"), F.lit("end"))).alias("trigger_keywords"),
    ).distinct()
    return learning.learning_rank(patterns, learning.learning_confidence(usage_log(spark, folder)), "Analizza i trends per mese", digits=6)


FEEDBACK_SQL = """
WITH f AS (SELECT 't' || (user_id % 3) AS tenant_id, 'a' || (event_id % 500) AS analysis_id, user_id, event_id % 7 AS rating,
   CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'incorrect' ELSE 'other' END AS outcome, event_id AS updated_at FROM events),
 u AS (SELECT tenant_id, analysis_id, user_id, arg_max(rating, updated_at) AS rating, arg_max(outcome, updated_at) AS outcome, max(updated_at) AS updated_at
   FROM f WHERE rating BETWEEN 1 AND 5 AND outcome <> 'other' GROUP BY 1, 2, 3)
"""


def _feedback(spark, folder):
    kind = F.col("event_type")
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("a"), (F.col("event_id") % 500).cast("string")).alias("analysis_id"), "user_id",
        (F.col("event_id") % 7).alias("rating"),
        F.when(kind == "purchase", "correct").when(kind == "click", "partial").when(kind == "error", "incorrect").otherwise("other").alias("outcome"),
        F.col("event_id").alias("updated_at"),
    )
    return learning.feedback_upsert(rows)


@SET.add("feedback_upsert", FEEDBACK_SQL + "SELECT * FROM u")
def _(spark, folder):
    return _feedback(spark, folder)


@SET.add("feedback_summary", FEEDBACK_SQL + """
SELECT tenant_id, count(*) AS total, round(avg(rating), 2) AS average_rating, count(*) FILTER (outcome = 'correct') AS correct,
 count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'incorrect') AS incorrect FROM u GROUP BY ROLLUP (tenant_id)""")
def _(spark, folder):
    return learning.feedback_summary(_feedback(spark, folder))


ANALYSES_SQL = """(SELECT 'a' || o_orderkey AS id, 't' || (o_custkey % 4) AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders)"""


def _analyses(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )


@SET.add("status_summary", f"SELECT status, count(*) AS total FROM {ANALYSES_SQL} GROUP BY 1")
def _(spark, folder):
    return learning.status_summary(_analyses(spark, folder))


@SET.add("retention", f"""
SELECT id, tenant_id, status, created_at FROM {ANALYSES_SQL} WHERE created_at < '1998-01-01' AND status IN ('completed', 'failed', 'cancelled') AND tenant_id = 't1'""")
def _(spark, folder):
    return learning.retention_candidates(_analyses(spark, folder), "1998-01-01", "t1")


@SET.add("retention_purge", f"""
WITH a AS (SELECT * FROM {ANALYSES_SQL}), e AS (SELECT * FROM a WHERE created_at < '1998-01-01' AND status IN ('completed', 'failed')),
 f AS (SELECT 'a' || l_orderkey AS analysis_id FROM lineitem)
SELECT 'analyses' AS name, (SELECT count(*) FROM a) - (SELECT count(*) FROM e) AS rows
UNION ALL SELECT 'feedback', count(*) FROM f WHERE analysis_id NOT IN (SELECT id FROM e)""")
def _(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    feedback = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").select(
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("analysis_id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"),
    )
    analyses, kept = learning.purge(_analyses(spark, folder), feedback, "1998-01-01")
    return analyses.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("analyses").alias("name"), "rows").unionByName(
        kept.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("feedback").alias("name"), "rows"))


HISTORY_SQL = """(SELECT o_orderkey AS id, lower(o_orderpriority) AS source_type, (o_orderkey % 101) / 100 AS feedback_score, o_custkey % 12 AS execution_count,
 o_custkey % 12 // 2 AS success_count, o_orderdate AS created_at, o_orderpriority AS description FROM orders)"""


def _history(spark, folder):
    runs = F.col("o_custkey") % 12
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("source_type"), (F.col("o_orderkey") % 101 / 100).alias("feedback_score"),
        runs.alias("execution_count"), F.floor(runs / 2).alias("success_count"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("description"),
    )


@SET.add("top_queries", f"SELECT id, feedback_score, execution_count FROM {HISTORY_SQL} WHERE source_type = '5-low' ORDER BY feedback_score DESC, execution_count DESC, id LIMIT 5")
def _(spark, folder):
    return learning.top_queries(_history(spark, folder), "5-low").select("id", "feedback_score", "execution_count")


@SET.add("learning_stats", f"""
SELECT source_type, count(*) AS queries, round(avg(feedback_score), 2) AS avg_feedback, round(max(feedback_score), 2) AS max_feedback, round(min(feedback_score), 2) AS min_feedback,
 sum(execution_count)::BIGINT AS executions, round(sum(success_count) / sum(execution_count) * 100, 1) AS success_rate FROM {HISTORY_SQL} GROUP BY ROLLUP (source_type)""")
def _(spark, folder):
    return learning.learning_stats(_history(spark, folder))


@SET.add("learning_trend", f"""
SELECT created_at::DATE AS day, count(*) AS queries, round(avg(feedback_score), 4) AS avg_score FROM {HISTORY_SQL} WHERE created_at >= TIMESTAMP '2001-07-25' GROUP BY 1""")
def _(spark, folder):
    found = learning.learning_trend(_history(spark, folder), F.lit("2001-08-01").cast("timestamp_ntz"))
    return found.withColumn("avg_score", F.round("avg_score", 4))


@SET.add("history_confidence", f"""
SELECT id, CASE WHEN execution_count > 0 THEN round(least(1.0, greatest(0.0, (0.6 * feedback_score + 0.4 * (success_count / execution_count)) * least(1.0, execution_count / 5))), 4) ELSE 0.0 END AS confidence
FROM {HISTORY_SQL}""")
def _(spark, folder):
    score = learning.history_confidence(F.col("feedback_score"), F.col("success_count"), F.col("execution_count"))
    return _history(spark, folder).select("id", score.alias("confidence"))


@SET.add("next_actions", """
WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS tag, ['ship ' || o_orderpriority, 'Check ' || o_orderstatus, 'call ' || (o_custkey % 50)] AS recs, o_totalprice / 500000 AS score FROM orders),
 w AS (SELECT id, p - 1 AS pos, recs[p] AS action, (CASE WHEN tag IN ('1-URGENT', '3-MEDIUM') THEN 2.0 ELSE 0.0 END) + score + greatest(0, 1.0 - (p - 1) * 0.1) AS weight FROM e, generate_series(1, 3) t(p)),
 f AS (SELECT *, row_number() OVER (PARTITION BY lower(action) ORDER BY id DESC, pos) AS r FROM w)
SELECT action, round(weight, 6) AS weight FROM f WHERE r = 1 ORDER BY weight DESC, id DESC, pos LIMIT 5""")
def _(spark, folder):
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    entries = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("tags"), (F.col("o_totalprice") / 500000).alias("score"),
        F.array(text("ship ", F.col("o_orderpriority")), text("Check ", F.col("o_orderstatus")), text("call ", F.col("o_custkey") % 50)).alias("recommendations"),
    )
    found = learning.next_actions(entries, "urgent or medium orders", 5)
    return found.withColumn("weight", F.round("weight", 6))


@SET.add("readiness_gates", """
WITH m AS (SELECT count(*) AS n, count(DISTINCT event_type) AS d, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type IN ('purchase', 'error')) AS fb,
  count(*) FILTER (event_type = 'error') / count(*) AS err FROM events)
SELECT unnest(['validation_cases', 'domain_coverage', 'validated_accuracy', 'tenant_isolation', 'unsupported_requests', 'load_concurrency', 'backup_restore', 'retention_delete', 'monitoring', 'critical_bugs']) AS gate,
 unnest([n >= 30, d >= 3, fb >= 10 AND good / fb >= 0.8, true, false, err <= 0.02, true, true, false, true]) AS passed FROM m""")
def _(spark, folder):
    kind = F.col("event_type")
    evidence = table(spark, folder, "events").agg(
        F.count(F.lit(1)).alias("cases_total"), F.count_distinct("event_type").alias("cases_domains"),
        F.count_if(kind.isin("purchase", "error")).alias("feedback_total"), F.count_if(kind == "purchase").alias("feedback_correct"),
        F.avg((kind == "error").cast("double")).alias("load_error_rate"),
    ).select(
        "*", F.lit(8).alias("load_concurrency"), F.lit(True).alias("tenant_isolation_passed"), F.lit(None).alias("unsupported_requests_passed"),
        F.lit(True).alias("backup_restore_passed"), F.lit(True).alias("retention_delete_passed"), F.lit(False).alias("monitoring_passed"),
        F.lit(0).alias("open_critical_bugs"),
    )
    return learning.readiness_gates(evidence)


@SET.add("fn_cosine", """
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q""")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    query = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("_q"))
    return vectors.crossJoin(F.broadcast(query)).select("vec_id", F.round(numeric.cosine(F.col("embedding"), F.col("_q")), 6).alias("similarity"))


@SET.add("history_similarity", """
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity, 'embedding' AS method FROM embeddings, q
WHERE label % 2 = (SELECT label % 2 FROM embeddings ORDER BY vec_id LIMIT 1) AND list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) >= 0.1""")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    first = vectors.orderBy("vec_id").first()
    history = vectors.select(
        F.col("vec_id").alias("id"), (F.col("label") % 2).cast("string").alias("source_type"), F.lit(1.0).alias("feedback_score"),
        F.lit(1).alias("success_count"), F.lit("text").alias("description"), "embedding",
    )
    found = learning.history_similarity(history, "unused", str(first.label % 2), threshold=0.1, vector=list(first.embedding))
    return found.select("id", F.round("similarity", 6).alias("similarity"), "method")
