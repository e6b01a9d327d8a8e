"""Feedback, retention, pattern learning, request history and readiness gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.numeric import clamp, cosine, safe_ratio
from tablewise.functions.text import WORD_CHAR, collapse_spaces, keyword_match, ratio_bound, text_ratio, word_tokens
from tablewise.operators.joins import latest_per_key, spread
from tablewise.operators.similarity import similar_classes, word_classes
from tablewise.session import reliable_checkpoint

OUTCOMES = ("correct", "partial", "incorrect")
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
# Words of positive and negative feedback, and the promotion limits.
POSITIVE_WORDS = ("utile", "positivo", "positive", "success", "successful", "ok", "yes", "si", "sì", "like")
NEGATIVE_WORDS = ("non utile", "inutile", "negativo", "negative", "failure", "failed", "no", "dislike")
PROMOTE_AT, DEMOTE_AT = 0.72, 0.28
#: Links of one request whose texts are compared by one task.
LINK_ROWS = 4_096


def feedback_kind(feedback: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(feedback, F.lit(""))), r"\s+", " "))
    return F.when(text.isin(*POSITIVE_WORDS), "positive").when(text.isin(*NEGATIVE_WORDS), "negative").otherwise("neutral")


def feedback_upsert(feedback: DataFrame, keys: Sequence[str] = ("tenant_id", "analysis_id", "user_id"), order: str = "updated_at") -> DataFrame:
    """One valid feedback per key, the last write wins."""
    valid = feedback.where(F.col("rating").between(1, 5) & F.col("outcome").isin(*OUTCOMES))
    return latest_per_key(valid, list(keys), [F.col(order), F.col("rating"), F.col("outcome")])


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Count, mean rating and outcomes per tenant, and for all tenants (null tenant)."""
    return feedback.rollup("tenant_id").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("rating"), 2).alias("average_rating"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
    )


def status_summary(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("status").agg(F.count(F.lit(1)).alias("total"))


def _expired(before: str, tenant_id: str | None) -> Column:
    condition = (F.col("created_at") < before) & F.col("status").isin(*TERMINAL_STATUSES)
    return condition & (F.col("tenant_id") == tenant_id) if tenant_id else condition


def retention_candidates(analyses: DataFrame, before: str, tenant_id: str | None = None) -> DataFrame:
    """Finished analyses created before the cutoff."""
    return analyses.where(_expired(before, tenant_id)).select("id", "tenant_id", "status", "created_at")


def purge(analyses: DataFrame, feedback: DataFrame, before: str, tenant_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the expired analyses and their feedback."""
    expired = retention_candidates(analyses, before, tenant_id).select(F.col("id").alias("_id"), F.col("tenant_id").alias("_t"))
    kept = analyses.where(~F.coalesce(_expired(before, tenant_id), F.lit(False)))
    match = (F.col("analysis_id") == F.col("_id")) & (F.col("tenant_id") == F.col("_t"))
    return kept, feedback.join(expired, match, "left_anti")


def confidence_and_status(counts: DataFrame) -> DataFrame:
    """Adds confidence and status to usage, success, failure and neutral counts."""
    used, good, bad, neutral = (F.col(c) for c in ("usage_count", "success_count", "failure_count", "neutral_count"))
    total = good + bad + neutral
    component = F.when(total > 0, (good + 0.5 * neutral + 1.0) / (total + 2.0)).otherwise(0.5)
    confidence = F.round(clamp(component * 0.86 + F.least(F.lit(0.16), used * 0.02) - F.least(F.lit(0.24), bad * 0.08)), 4)
    status = (
        F.when((F.col("confidence") >= PROMOTE_AT) & (used >= 2) & (good >= 2), "promoted")
        .when((F.col("confidence") <= DEMOTE_AT) | ((bad >= 2) & (bad > good)), "demoted")
        .otherwise("candidate")
    )
    return counts.withColumn("confidence", confidence).withColumn("status", status)


def learning_confidence(events: DataFrame) -> DataFrame:
    """Per pattern: counts, confidence and status from usage and feedback events."""
    from tablewise.streaming.monitors import feedback_fold

    return feedback_fold(events)


def keyword_score(request: str, keywords: Column) -> Column:
    """Matched keywords / 4, at most 1."""
    text = F.lit(" ".join(request.lower().split()))
    clean = F.transform(keywords, lambda k: F.trim(F.regexp_replace(F.lower(k), r"\s+", " ")))
    hits = F.filter(clean, lambda k: (k != "") & F.when(
        F.contains(k, F.lit(" ")), F.contains(text, k)
    ).otherwise(F.rlike(text, F.concat(F.lit(rf"(?<!{WORD_CHAR})\Q"), k, F.lit(r"\E")))))
    return F.least(F.lit(1.0), F.size(hits) / 4.0)


def learning_rank(patterns: DataFrame, learned: DataFrame, request: str, digits: int = 4) -> DataFrame:
    """Patterns (``pattern_id, confidence_score, trigger_keywords``) by learned confidence and keyword fit."""
    stats = learned.select("pattern_id", F.col("confidence").alias("_learned"))
    joined = patterns.join(stats, "pattern_id", "left")
    confidence = F.round(F.coalesce("_learned", "confidence_score", F.lit(0.0)), 4)
    score = F.round(F.least(F.lit(1.0), F.coalesce("_learned", "confidence_score", F.lit(0.0)) * 0.75 + keyword_score(request, F.col("trigger_keywords")) * 0.25), digits)
    return joined.select("pattern_id", confidence.alias("confidence"), score.alias("recommendation_score")).orderBy(
        F.desc("confidence"), F.desc("recommendation_score"), "pattern_id"
    )


def history_confidence(feedback: Column, successes: Column, executions: Column) -> Column:
    rate = safe_ratio(successes, executions)
    score = (0.6 * feedback + 0.4 * rate) * F.least(F.lit(1.0), executions / 5)
    return F.when(executions > 0, F.round(clamp(score), 4)).otherwise(0.0)


def history_similarity(
    history: DataFrame, request: str, source_type: str, *, threshold: float = 0.6, minimum_feedback: float = 0.0,
    vector: Sequence[float] | None = None,
) -> DataFrame:
    """Past requests of one source similar to a request, best first.

    Embeddings are compared where both exist, texts otherwise by their matching blocks; texts whose lengths alone
    keep the ratio under the threshold are left out before. ``similar_requests`` compares all requests with each other.
    """
    rows = history.where((F.col("source_type") == source_type) & (F.col("feedback_score") >= minimum_feedback))
    embedded = F.col("embedding").isNotNull() if vector is not None and "embedding" in history.columns else F.lit(False)
    wanted = F.lit(request)
    near = rows.where(~embedded).where(ratio_bound(collapse_spaces(wanted), collapse_spaces(F.col("description"))) >= threshold)
    by_text = near.withColumn("similarity", text_ratio(wanted, F.col("description"))).withColumn("method", F.lit("text"))
    found = by_text
    if vector is not None and "embedding" in history.columns:
        target = F.array(*[F.lit(float(v)) for v in vector])
        by_vector = rows.where(embedded).withColumn("similarity", cosine(F.col("embedding"), target)).withColumn("method", F.lit("embedding"))
        found = by_vector.unionByName(by_text)
    return found.where(F.col("similarity") >= threshold).orderBy(
        F.desc("similarity"), F.desc("feedback_score"), F.desc("success_count"), "id"
    )


def similar_requests(history: DataFrame, *, threshold: float = 0.6, minimum_feedback: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """All requests of the history against each other, within their source.

    The first frame has (id, class): requests with the same words are one class, named by its smallest id. The second has
    (class, other, members, other_members, similarity, ratio) of the classes that share the threshold of their words, with
    ``text_ratio`` of the two requests that name them. Requests without a word are similar to none.
    """
    rows = history.where(F.col("feedback_score") >= minimum_feedback)
    members, classes = word_classes(rows, "id", word_tokens(F.col("description")), "source_type")
    pairs = reliable_checkpoint(similar_classes(classes, threshold))
    named = rows.select(F.col("id").alias("_id"), "description").join(classes.select("class", "members"), F.col("_id") == F.col("class"))
    named = named.groupBy("class").agg(F.min("description").alias("description"), F.max("members").alias("members"))
    others = named.select(F.col("class").alias("other"), F.col("description").alias("_description"), F.col("members").alias("other_members"))
    # With each link goes one of its texts; the links of a class that has many are dealt over several tasks, which all get its text.
    crowded = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / LINK_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(crowded, "other", "left").withColumn("_part", F.pmod(F.xxhash64("class"), parts).cast("int")).drop("_parts")
    copies = others.join(crowded, "other", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    found = spread(dealt.join(named, "class"), "other", "_part").join(copies, ["other", "_part"])
    return members, found.select(
        "class", "other", "members", "other_members", "similarity", text_ratio(F.col("description"), F.col("_description")).alias("ratio"))


def top_queries(history: DataFrame, source_type: str, limit: int = 5) -> DataFrame:
    rows = history.where(F.col("source_type") == source_type)
    return rows.orderBy(F.desc("feedback_score"), F.desc("execution_count"), "id").limit(limit)


def learning_stats(history: DataFrame) -> DataFrame:
    """Per source and for all (null source): queries, feedback range, executions, success rate."""
    return history.rollup("source_type").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("feedback_score"), 2).alias("avg_feedback"),
        F.round(F.max("feedback_score"), 2).alias("max_feedback"), F.round(F.min("feedback_score"), 2).alias("min_feedback"),
        F.sum("execution_count").alias("executions"),
        F.round(F.coalesce(safe_ratio(F.sum("success_count"), F.sum("execution_count")) * 100, F.lit(0.0)), 1).alias("success_rate"),
    )


def learning_trend(history: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Queries and mean feedback per day over the last days before ``now``."""
    recent = history.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy(F.col("created_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("feedback_score").alias("avg_score")
    )


def learned_keywords(history: DataFrame, text: str, liked: Column, limit: int | None = None) -> DataFrame:
    """Most frequent words of more than three characters in liked texts."""
    words = history.where(liked).select(F.explode(F.split(F.lower(F.trim(text)), r"\s+")).alias("keyword"))
    counted = words.where(F.length("keyword") > 3).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), "keyword")
    return ordered.limit(limit) if limit else ordered


def next_actions(entries: DataFrame, request: str, limit: int | None = None, recent: int | None = None) -> DataFrame:
    """Recommendations of the entries (the ``recent`` newest, if given) by token overlap, entry score and position.

    ``entries``: ``id, tags ARRAY<STRING>, recommendations ARRAY<STRING>, score``. The first
    occurrence of an action (newest entry, then position) decides its weight.
    """
    tokens = sorted({t for t in _words(request) if len(t) > 2})
    wanted = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    newest = entries if recent is None else entries.orderBy(F.desc("id")).limit(recent)
    overlap = F.size(F.array_intersect(word_tokens(F.array_join("tags", " "), 3), wanted))
    listed = newest.select(
        "id", (overlap * 2.0 + F.coalesce("score", F.lit(0.0))).alias("_base"), F.posexplode("recommendations").alias("_pos", "_action")
    ).select("id", "_pos", F.trim("_action").alias("action"), (F.col("_base") + F.greatest(F.lit(0.0), 1.0 - F.col("_pos") * 0.1)).alias("weight"))
    first = listed.where(F.coalesce("action", F.lit("")) != "").groupBy(F.lower("action").alias("_key")).agg(
        F.min_by(F.struct("action", "weight", "id", "_pos"), F.struct(-F.col("id"), F.col("_pos"))).alias("_f")
    )
    ordered = first.select("_f.*").orderBy(F.desc("weight"), F.desc("id"), "_pos")
    return (ordered.limit(limit) if limit else ordered).select("action", "weight")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-zA-Z0-9_]+", text.lower())


def readiness_gates(evidence: DataFrame) -> DataFrame:
    """Ten gates over one row of evidence metrics: ``gate, passed``; a missing metric fails."""
    def number(name: str, default: float = 0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))

    accuracy = F.coalesce(safe_ratio(number("feedback_correct"), number("feedback_total")), F.lit(0.0))
    gates = {
        "validation_cases": number("cases_total") >= 30,
        "domain_coverage": number("cases_domains") >= 3,
        "validated_accuracy": (number("feedback_total") >= 10) & (accuracy >= 0.8),
        "tenant_isolation": flag("tenant_isolation_passed"),
        "unsupported_requests": flag("unsupported_requests_passed"),
        "load_concurrency": (number("load_concurrency") >= 5) & (number("load_error_rate", 1) <= 0.02),
        "backup_restore": flag("backup_restore_passed"),
        "retention_delete": flag("retention_delete_passed"),
        "monitoring": flag("monitoring_passed"),
        "critical_bugs": number("open_critical_bugs", 1) == 0,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), ok.alias("passed")) for g, ok in gates.items()]))
    return evidence.select(rows.alias("_g")).select("_g.gate", "_g.passed")


def pattern_tags(texts: DataFrame, key: str, text: str, patterns: dict[str, tuple[float, Sequence[str]]]) -> DataFrame:
    """``key, pattern, matches, confidence`` of every pattern with a keyword in the text.

    ``patterns``: name to (base confidence, keywords). Whole texts are searched.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    rows = texts.select(key, text).select(key, clean.alias("_t"))
    hits = {name: sum((keyword_match(F.col("_t"), k).cast("int") for k in keywords), F.lit(0)) for name, (_b, keywords) in patterns.items()}
    # Counts are exploded before they are used, so that every keyword is searched once per text.
    found = F.explode(F.array(*[
        F.struct(F.lit(name).alias("pattern"), hits[name].alias("matches"), F.lit(float(base)).alias("_base"))
        for name, (base, _k) in patterns.items()
    ]))
    confidence = F.round(F.least(F.lit(0.99), F.col("_base") + F.least(F.lit(0.85), F.col("matches") * 0.22)), 4)
    return rows.select(key, found.alias("_p")).select(key, "_p.*").where(F.col("matches") > 0).select(
        key, "pattern", "matches", confidence.alias("confidence")
    )


def pack_scores(
    texts: DataFrame, key: str, text: str, packs: dict[str, Sequence[str]], columns: Sequence[str] = (), minimum: float = 0.18
) -> DataFrame:
    """``key, pack, score`` of the best keyword pack per text, kept from ``minimum`` on."""
    def normal(value: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"[_\-/]+", " "), r"\s+", " "))

    import re

    rows = texts.select(key, text).select(key, normal(F.col(text)).alias("_t"))
    names = [re.sub(r"[_\-/]+", " ", c.lower()) for c in columns]

    def in_columns(term: str) -> bool:
        clean = " ".join(re.sub(r"[_\-/]+", " ", term.lower()).split())
        return any(clean in n if " " in clean else re.search(rf"\b{re.escape(clean)}\w*\b", n) for n in names)

    scores = []
    for pack, terms in packs.items():
        clean = [" ".join(re.sub(r"[_\-/]+", " ", t.lower()).split()) for t in terms]
        hits = sum((keyword_match(F.col("_t"), t).cast("int") for t in clean), F.lit(0))
        score = F.least(F.lit(0.7), hits * 0.08) + min(0.35, 0.06 * sum(in_columns(t) for t in terms))
        score = score + F.when(keyword_match(F.col("_t"), " ".join(re.sub(r"[_\-/]+", " ", pack.lower()).split())), 0.2).otherwise(0.0)
        scores.append(F.struct(F.round(F.least(score, F.lit(0.99)), 4).alias("score"), F.lit(-len(scores)).alias("_order"), F.lit(pack).alias("pack")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    # Exploding a one-element array keeps the filter from repeating the keyword search.
    return rows.select(key, F.explode(F.array(best)).alias("_b")).select(key, "_b.pack", "_b.score").where(F.col("score") >= minimum)


def latest_entries(df: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """Newest entries per key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")
