"""Text, JSON and number functions, tagging and keyword counts over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import jsonfn, numeric, text
from tablewise.operators import learning
from tablewise.operators.joins import spread
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()


@SET.add("filter_value", """
SELECT p_partkey, p_type FROM part WHERE trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', '_', 'g'), '_') = 'RED_WIDGET'""")
def _(spark, folder):
    wanted = text.value_normalize(F.col("p_name")) == "RED_WIDGET"
    return table(spark, folder, "part").where(wanted).select("p_partkey", "p_type")


@SET.add("fn_name_normalize", """
SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS name FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.name_normalize(F.col("url")).alias("name"))


@SET.add("fn_value_normalize", """
SELECT c_custkey, CASE v WHEN 'CONSEGNA_MANO' THEN 'CONSEGNA_A_MANO' ELSE v END AS value FROM (SELECT c_custkey,
 CASE c_custkey % 3 WHEN 0 THEN 'CONSEGNA_MANO' ELSE trim(regexp_replace(upper(c_name || ' ' || c_mktsegment), '[^A-Z0-9]+', '_', 'g'), '_') END AS v FROM customer)""")
def _(spark, folder):
    raw = F.when(F.col("c_custkey") % 3 == 0, " consegna - mano ").otherwise(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return table(spark, folder, "customer").select("c_custkey", text.value_normalize(raw).alias("value"))


@SET.add("fn_slug", """
SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^\\p{L}\\p{N}]', '_', 'g'), '_')[1:80] AS slug FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@SET.add("fn_id", """
SELECT doc_id, sha1(text)[1:16] AS id16, sha1(text)[1:12] AS id12, sha256(source || '|' || lang)[1:16] AS candidate FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.stable_hash(F.col("text")).alias("id16"), text.stable_hash(F.col("text"), 12).alias("id12"),
        F.substring(F.sha2(F.concat_ws("|", "source", "lang"), 256), 1, 16).alias("candidate"),
    )


@SET.add("fn_truncate", """
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE text[1:117] || '...' END AS short FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


@SET.add("fn_tokenize", """
SELECT conv_id, turn, list_count(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{3,})')))::INT AS tokens FROM conversations""")
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.size(text.word_tokens(F.col("text"), 3)).alias("tokens"))


@SET.add("fn_prefix_match", """
WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part)
SELECT p_partkey, (SELECT count(*) FROM (SELECT unnest(t) AS a) WHERE length(a) >= 4 AND a[1:5] IN ('widge', 'green'))::INT AS matches FROM p""")
def _(spark, folder):
    request = F.array(F.lit("widgets"), F.lit("green"), F.lit("red"))
    return table(spark, folder, "part").select(
        "p_partkey", text.prefix_match_count(F.split(F.lower("p_name"), " "), request).alias("matches"))


@SET.add("fn_keyword_match", """
SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the') AS word, contains(lower(text), 'of the') AS phrase FROM documents""")
def _(spark, folder):
    lowered = F.lower("text")
    return table(spark, folder, "documents").select(
        "doc_id", text.keyword_match(lowered, "the").alias("word"), text.keyword_match(lowered, "of the").alias("phrase"))


@SET.add("fn_jaccard", """
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{1,})')) AS w FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, ['the', 'and', 'that', 'of'])) / len(list_distinct(list_concat(w, ['the', 'and', 'that', 'of']))) END, 6)::DOUBLE AS jaccard FROM t""")
def _(spark, folder):
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "that", "of")])
    score = text.jaccard(text.word_tokens(F.col("text")), wanted)
    return table(spark, folder, "conversations").select("conv_id", "turn", F.round(score, 6).alias("jaccard"))


@SET.add("fn_shape_similarity", """
SELECT p_partkey, round(((CASE WHEN p_partkey = 100 THEN 1 ELSE 1 - least(abs(ln(1 + p_partkey) - ln(101)) / 6, 1) END) + (CASE WHEN p_size = 10 THEN 1 ELSE 1 - abs(p_size - 10) / greatest(p_size, 10, 1) END)) / 2, 6) AS shape FROM part""")
def _(spark, folder):
    score = numeric.shape_similarity(F.lit(100), F.lit(10), F.col("p_partkey"), F.col("p_size"))
    return table(spark, folder, "part").select("p_partkey", F.round(score, 6).alias("shape"))


#: Characters in matching blocks of the pairs ``p`` (k, l, a, b): cells of equal characters with the length of the
#: run that begins there; in each stretch the longest block is taken, and the cells on both of its sides go on.
MATCHED_SQL = r"""
ca AS (SELECT k, l, unnest(string_split(a, '')) AS ch, generate_subscripts(string_split(a, ''), 1) AS i FROM p WHERE a <> b),
cb AS (SELECT k, l, unnest(string_split(b, '')) AS ch, generate_subscripts(string_split(b, ''), 1) AS j FROM p WHERE a <> b),
m AS (SELECT k, l, i, j, i - row_number() OVER (PARTITION BY k, l, i - j ORDER BY i) AS run FROM ca JOIN cb USING (k, l, ch)),
r AS (SELECT 0 AS depth, k, l, 0::BIGINT AS stretch, i, j, max(i) OVER (PARTITION BY k, l, i - j, run) - i + 1 AS size FROM m
 UNION ALL
 SELECT depth + 1, k, l, CASE WHEN i < bi THEN stretch ELSE bi + bs END, i, j, CASE WHEN i < bi THEN least(size, bi - i, bj - j) ELSE size END
 FROM (SELECT *, first_value(i) OVER w AS bi, first_value(j) OVER w AS bj, first_value(size) OVER w AS bs FROM r
  WINDOW w AS (PARTITION BY k, l, stretch ORDER BY size DESC, i, j))
 WHERE i < bi AND j < bj OR i >= bi + bs AND j >= bj + bs),
s AS (SELECT k, l, sum(size) AS matched FROM (SELECT k, l, depth, stretch, max(size) AS size FROM r GROUP BY ALL) GROUP BY ALL),
ratios AS (SELECT k, l, CASE WHEN a = b THEN 1.0 ELSE round(2.0 * coalesce(matched, 0) / (length(a) + length(b)), 6) END::DOUBLE AS ratio FROM p LEFT JOIN s USING (k, l))"""
LINE_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@SET.add("fn_text_ratio", f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {LINE_SQL} AS line FROM conversations),
p AS (SELECT x.conv_id AS k, x.turn AS l, x.line AS a, y.line AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1),{MATCHED_SQL}
SELECT k AS conv_id, l AS turn, ratio FROM ratios""")
def _(spark, folder):
    """Ratio of each turn to the one before it in the conversation."""
    turns = table(spark, folder, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return spread(turns.join(before, ["conv_id", "turn"])).select(
        "conv_id", "turn", F.round(text.text_ratio(F.col("text"), F.col("before")), 6).alias("ratio"))


@SET.add("fn_to_number", """
WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN cast(value AS VARCHAR) WHEN 1 THEN 'n/a' ELSE '  12.5 ' END AS t FROM events)
SELECT event_id, try_cast(trim(t) AS DOUBLE) AS number FROM d""")
def _(spark, folder):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "n/a").otherwise("  12.5 ")
    return table(spark, folder, "events").select("event_id", numeric.to_number(raw).alias("number"))


@SET.add("fn_round4", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7919, 4) AS rounded, CASE WHEN l_linenumber <> 4 THEN round(l_tax, 4) END AS finite FROM lineitem""")
def _(spark, folder):
    broken = F.when(F.col("l_linenumber") == 4, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.round_to(F.col("l_extendedprice") / 7919).alias("rounded"), numeric.round_to(broken).alias("finite"))


@SET.add("fn_json", """
SELECT event_id, cast(json_extract(props, '$.k') AS VARCHAR) AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS packed FROM events""")
def _(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), jsonfn.to_json(F.struct("event_type", "user_id")).alias("packed"))


@SET.add("fn_properties_match", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3")
def _(spark, folder):
    properties = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, folder, "customer").where(jsonfn.properties_match(properties, {"segment": "Building", "nation": "3"})).select("c_custkey")


@SET.add("fn_mask_secret", """
SELECT c_custkey, 'jdbc://user:***@host/' || c_mktsegment AS url, 1 AS kept FROM customer""")
def _(spark, folder):
    metadata = F.create_map(F.lit("Password"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    url = F.concat(F.lit("jdbc://user:"), F.regexp_replace("c_name", "[^0-9]", ""), F.lit("@host/"), F.col("c_mktsegment"))
    return table(spark, folder, "customer").select(
        "c_custkey", jsonfn.mask_url_password(url).alias("url"), F.size(jsonfn.drop_secrets(metadata)).alias("kept"))


@SET.add("order_preserving_unique", """
SELECT doc_id, list_count(list_distinct(string_split(text, ' ')))::INT AS distinct_words FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).alias("distinct_words"))


PATTERNS = {
    "trend_analysis": (0.1, ["trend", "andamento", "the", "th"]),
    "quality_audit": (0.1, ["quality", "missing", "of the", "and"]),
    "prose": (0.2, ["les", "der", "que", "on the"]),
}


@SET.add("text_tagging", """
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
 m AS (SELECT doc_id, 'trend_analysis' AS pattern, 0.1 AS base, regexp_matches(t, '(^|[^\\p{L}\\p{N}_])trend')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])andamento')::INT
   + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])the')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])th')::INT AS matches FROM d
  UNION ALL SELECT doc_id, 'quality_audit', 0.1, regexp_matches(t, '(^|[^\\p{L}\\p{N}_])quality')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])missing')::INT + contains(t, 'of the')::INT
   + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])and')::INT FROM d
  UNION ALL SELECT doc_id, 'prose', 0.2, regexp_matches(t, '(^|[^\\p{L}\\p{N}_])les')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])der')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])que')::INT
   + contains(t, 'on the')::INT FROM d)
SELECT doc_id, pattern, matches, round(least(0.99, base + least(0.85, matches * 0.22)), 4)::DOUBLE AS confidence FROM m WHERE matches > 0""")
def _(spark, folder):
    return learning.pattern_tags(table(spark, folder, "documents"), "doc_id", "text", PATTERNS)


PACKS = {"english": ["the", "and", "that", "of"], "french": ["les", "que", "des", "pas"], "german": ["der", "und", "sch"]}


@SET.add("text_packs", """
WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[_/-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
 s AS (SELECT doc_id, least(0.7, 0.08 * (regexp_matches(t, '(^|[^\\p{L}\\p{N}_])the')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])and')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])that')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])of')::INT))
   + CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])english') THEN 0.2 ELSE 0 END AS e,
  least(0.7, 0.08 * (regexp_matches(t, '(^|[^\\p{L}\\p{N}_])les')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])que')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])des')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])pas')::INT))
   + CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])french') THEN 0.2 ELSE 0 END AS f,
  least(0.7, 0.08 * (regexp_matches(t, '(^|[^\\p{L}\\p{N}_])der')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])und')::INT + regexp_matches(t, '(^|[^\\p{L}\\p{N}_])sch')::INT))
   + CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])german') THEN 0.2 ELSE 0 END + 0.06 AS g FROM d)
SELECT doc_id, CASE WHEN e >= f AND e >= g THEN 'english' WHEN f >= g THEN 'french' ELSE 'german' END AS pack, round(greatest(e, f, g), 4)::DOUBLE AS score FROM s
WHERE round(greatest(e, f, g), 4) >= 0.18""")
def _(spark, folder):
    return learning.pack_scores(table(spark, folder, "documents"), "doc_id", "text", PACKS, ["under_writer"])


@SET.add("learned_keywords", """
WITH w AS (SELECT unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS keyword FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT keyword, count(*) AS count FROM w WHERE length(keyword) > 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, folder):
    rated = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return learning.learned_keywords(rated, "text", F.col("quality") > 0.5, 10)


def _requests(spark, folder):
    """Each turn as a past request of its role."""
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("source_type"), F.col("text").alias("description"),
        F.lit(1.0).alias("feedback_score"), F.lit(1).alias("success_count"),
    )


#: Share of their words that similar requests have in common; the words of the tables are invented.
SIMILAR_FROM = 0.2
CLASSES_SQL = rf"""
t AS (SELECT conv_id || '-' || turn AS id, role, {LINE_SQL} AS line, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{{1,}})'))) AS w FROM conversations),
c AS (SELECT role, w, min(id) AS class, count(*) AS members FROM t WHERE len(w) > 0 GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT x.class, y.class AS other, x.members, y.members AS other_members, len(list_intersect(x.w, y.w)) AS shared, len(x.w) + len(y.w) AS sizes
 FROM c x JOIN c y ON x.role = y.role AND x.class < y.class) WHERE shared / (sizes - shared) >= {SIMILAR_FROM})"""


@SET.add("similar_history", f"""
WITH RECURSIVE {CLASSES_SQL},
p AS (SELECT class AS k, other AS l, x.line AS a, y.line AS b FROM pairs JOIN t x ON x.id = class JOIN t y ON y.id = other),{MATCHED_SQL}
SELECT class, other, members, other_members, round(shared / (sizes - shared), 6)::DOUBLE AS similarity, ratio FROM pairs JOIN ratios ON k = class AND l = other""")
def _(spark, folder):
    """All past requests of a role against each other."""
    _, pairs = learning.similar_requests(_requests(spark, folder), threshold=SIMILAR_FROM)
    return pairs.select("class", "other", "members", "other_members", F.round("similarity", 6).alias("similarity"), F.round("ratio", 6).alias("ratio"))


@SET.add("similar_history_members", f"""
WITH {CLASSES_SQL},
n AS (SELECT class, count(*) AS links FROM (SELECT class FROM pairs UNION ALL SELECT other FROM pairs) GROUP BY class)
SELECT id, c.class, coalesce(links, 0) AS links FROM t JOIN c USING (role, w) LEFT JOIN n USING (class)""")
def _(spark, folder):
    """Each past request with its class and the number of other classes that are similar."""
    members, pairs = learning.similar_requests(_requests(spark, folder), threshold=SIMILAR_FROM)
    ends = pairs.select(F.explode(F.array("class", "other")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
