"""Parts of scores, order, caps and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions.text import truncated
from ..operators import health as H
from ..operators import limits as L
from . import query, table

_TIER = "CASE r_name WHEN 'AFRICA' THEN 'unknown' WHEN 'AMERICA' THEN 's' WHEN 'ASIA' THEN 'a' ELSE 'b' END"


@query("tier_score", f"""
SELECT n_regionkey AS region, CAST(max(CASE {_TIER} WHEN 's' THEN 10 WHEN 'a' THEN 7 WHEN 'b' THEN 4 ELSE 0 END) AS INT) AS points, count(*) AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def tier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources with the tier of their region: two lookups of fixed dimensions."""
    tier = F.when(F.col("r_name") == "AFRICA", "unknown").when(F.col("r_name") == "AMERICA", "s").when(F.col("r_name") == "ASIA", "a").otherwise("b")
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_regionkey").alias("region"), tier.alias("tier"))
    rows = table(spark, sf_dir, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("region").agg(F.max(S.tier_points(F.col("tier"))).alias("points"), F.count("*").alias("n"))


_WEIGHTS = {"ECONOMY": 0.0, "STANDARD": 0.3, "PROMO": 2.5}


@query("interest_weighted", """
SELECT p_partkey, CAST(floor(15 * (0.5 + 0.5 * CASE p_type WHEN 'ECONOMY' THEN 0.0 WHEN 'STANDARD' THEN 0.3 ELSE 1.0 END) + 0.5) AS INT) AS points FROM part
""")
def interest_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for k, v in _WEIGHTS.items() for x in (k, v)])
    return table(spark, sf_dir, "part").select("p_partkey", S.topic_points(F.try_element_at(weights, F.col("p_type"))).alias("points"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: lines are talks, media, topics and people."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    number = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    media = F.struct(F.concat_ws("/", "l_orderkey", "l_partkey").alias("url"), F.when(F.col("l_returnflag") == "A", "video").when(F.col("l_returnflag") == "N", "audio").otherwise("slides").alias("media_type"), F.when(F.col("l_linestatus") == "O", "open").otherwise("registration_required").alias("public_access"))
    person = F.struct(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("canonical_name"), F.when(number == 1, "speaker").when(number == 2, "organizer").when(number == 3, "title_mention").otherwise("participant").alias("role"), F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("Fields"))).otherwise(F.array(F.lit("x"))).alias("scholar_tags"))
    talk = F.struct(F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_quantity") > 25, "about").otherwise(none).alias("abstract_text"))
    topic = F.struct(F.when(number % 2 == 0, "even").otherwise("odd").alias("topic_id"))
    line = F.struct(number.alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), media.alias("media"), person.alias("person"), talk.alias("talk"), topic.alias("topic"))
    rows = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(rows, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType)))
    part = lambda k: F.transform("lines", lambda x: x[k])
    return rows.select(
        F.col("o_orderkey"), F.col("o_totalprice"), part("media").alias("media"), part("person").alias("people"), part("talk").alias("talks"), part("topic").alias("topics"),
        F.struct(F.when(F.col("o_orderpriority").startswith("1"), "livestream").when(F.col("o_orderpriority").startswith("2"), "hybrid").when(F.col("o_orderpriority").startswith("3"), "recording_expected").otherwise("unknown").alias("online")).alias("access"),
        F.when(F.col("o_orderstatus") == "O", F.lit("text")).alias("description"), F.when(F.col("o_custkey") % 2 == 0, F.lit("here")).alias("location"),
    )


_MEDIA = "CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 25 ELSE 18 END WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 15 ELSE 0 END ELSE 10 END"
_PERSON = "CASE l_linenumber WHEN 1 THEN CASE WHEN l_suppkey % 5 = 0 THEN 10 ELSE 3 END WHEN 2 THEN CASE WHEN l_suppkey % 5 = 0 THEN 5 ELSE 3 END WHEN 3 THEN 0 ELSE 3 END"
_PARTS = f"""
SELECT o_orderkey, CAST(least(30, coalesce(n, 0) * 15) AS INT) AS topic, CAST(coalesce(media, 0) AS INT) AS media,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 15 WHEN '2' THEN 12 WHEN '3' THEN 10 ELSE 0 END AS access, CAST(coalesce(people, 0) AS INT) AS people,
  CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 0 END + CASE WHEN coalesce(abstracts, 0) > 0 THEN 3 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 3 THEN 2 ELSE 0 END AS completeness
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max({_MEDIA}) AS media, max({_PERSON}) AS people, count(*) FILTER (l_quantity > 25) AS abstracts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
"""


@query("score_parts", _PARTS)
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, media, access, people and completeness points of orders as events."""
    rows = _events(spark, sf_dir)
    best = S.best_person(F.col("people"))
    return rows.select(
        "o_orderkey", S.topic_score(F.col("topics")).cast("int").alias("topic"), S.media_score(F.col("media")).alias("media"), S.access_score(F.col("access")["online"]).alias("access"),
        F.coalesce(best["points"], F.lit(0)).alias("people"), S.completeness_score(F.col("description"), F.col("talks"), F.col("location")).alias("completeness"),
    )


@query("score_total", f"SELECT o_orderkey, topic + media + access + people + completeness + 7 AS score, topic > 0 AND media >= 0 AS topical FROM ({_PARTS})")
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, parts, _ = S.scored(F.lit(7))
    rows = _events(spark, sf_dir).withColumn("t", F.struct(total.alias("score"), parts.alias("parts")))
    return rows.select("o_orderkey", F.col("t.score").cast("int").alias("score"), (F.col("t.parts.topic") > 0).alias("topical"))


@query("score_reasons", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
g AS (SELECT l_orderkey, string_agg('matched_topic: ' || CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END, '; ' ORDER BY pos) AS topics,
  bool_or(l_linestatus = 'O') AS open, arg_max('p' || l_suppkey, {_PERSON} * 1000 - pos) AS who, arg_max(l_linenumber, {_PERSON} * 1000 - pos) AS line FROM l GROUP BY 1)
SELECT p.o_orderkey, concat_ws('; ', topics, CASE WHEN coalesce(open, false) THEN 'public_recording_available' END, CASE access WHEN 15 THEN 'livestream' WHEN 12 THEN 'hybrid' END,
  CASE WHEN p.o_orderkey % 2 = 0 THEN 'major_research_institute' END,
  CASE WHEN people >= 5 THEN CASE line WHEN 1 THEN 'important_speaker: ' WHEN 2 THEN 'important_organizer: ' ELSE 'important_person: ' END || who END, CASE WHEN completeness >= 10 THEN 'program_complete' END) AS reasons
FROM ({_PARTS}) p LEFT JOIN g ON p.o_orderkey = g.l_orderkey
""")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of orders as events, in order."""
    _, _, reasons = S.scored(F.when(F.col("o_orderkey") % 2 == 0, 10).otherwise(7))
    return _events(spark, sf_dir).select("o_orderkey", F.array_join(reasons, "; ").alias("reasons"))


@query("rank_topk", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= 100")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))
    top = L.top_events(rows, 100)
    return top.select(F.col("id").alias("o_orderkey"), F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))).alias("rank"))


@query("survivors_by_source", """
SELECT source, count(*) AS events FROM (SELECT source FROM documents ORDER BY source, doc_id LIMIT 500) GROUP BY source
""")
def survivors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("stub_ord"), F.array(F.struct(F.col("source").alias("source_id"))).alias("sources"))
    return L.survivors(L.capped_candidates(rows, 500))


@query("health_recount", """
SELECT d.source, CASE WHEN coalesce(k.n, 0) < d.n THEN 'partial' ELSE 'ok' END AS status, CAST(coalesce(k.n, 0) AS INT) AS events
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) d LEFT JOIN (SELECT source, count(*) AS n FROM (SELECT source FROM documents ORDER BY source, doc_id LIMIT 500) GROUP BY 1) k ON d.source = k.source
""")
def health_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("stub_ord"), F.array(F.struct(F.col("source").alias("source_id"))).alias("sources"))
    health = rows.groupBy("source").agg(F.count("*").cast("int").alias("events")).withColumn("status", F.lit("ok"))
    return L.recounted(health, L.capped_candidates(rows, 500)).select("source", "status", "events")


@query("stub_cap", """
SELECT source, doc_id, count(*) OVER (PARTITION BY source) > 40 AS cut FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 40
""")
def stub_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.capped_stubs(table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("stub_ord")), 40).select("source", "doc_id", "cut")


@query("talk_budget", """
SELECT o_orderkey, CAST(least(n, 300 - before) AS INT) AS talks FROM (
  SELECT o_orderkey, n, coalesce(sum(n) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT o_orderkey, o_totalprice, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)) WHERE before < 300
""")
def talk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "talks")
    return L.talk_budget(L.top_events(rows, 500), 300).select(F.col("id").alias("o_orderkey"), F.size("talks").alias("talks"))


@query("text_truncate", "SELECT doc_id, CAST(length(substr(text, 1, 1200)) AS INT) AS n, sha256(substr(text, 1, 1200)) AS digest FROM documents")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = truncated(F.col("text"), 1200)
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(t).alias("n"), F.sha2(t, 256).alias("digest"))


@query("health_ratio", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS healthy, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS ratio FROM events")
def health_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.healthy_share(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "http_error").when(F.col("event_type") == "view", "partial").otherwise("ok").alias("status")))


@query("retry_class", """
SELECT event_id, s, s IN (408, 429) OR s BETWEEN 500 AND 599 AS again, CAST(least(500 * (1 << CAST(user_id % 5 AS INT)), 3000) AS BIGINT) AS pause
FROM (SELECT event_id, user_id, CAST([200, 404, 408, 429, 500, 503, 600][event_id % 7 + 1] AS INT) AS s FROM events)
""")
def retry_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 408, 429, 500, 503, 600)]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", status.alias("s"), H.retries(status).alias("again"), H.backoff_ms(F.col("user_id") % 5 + 1, F.lit(3000).cast("long")).alias("pause"))


@query("source_status", """
SELECT source, CASE WHEN count(*) FILTER (n_chars < 200) > 0 THEN 'partial' ELSE 'ok' END AS status FROM documents GROUP BY source
UNION ALL SELECT 'missing', 'parse_error'
""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the outcome of their documents; a source without any result is a parse error."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_chars") < 200, 1)).alias("bad"))
    results = counts.select("source", H.source_status(F.col("n"), F.col("n") - F.col("bad"), F.col("bad"), F.lit(0), F.lit(False)).alias("status"), F.lit(0).alias("duration_ms"), F.lit(0).alias("requests"), F.col("n").alias("events"), F.lit("").alias("message"))
    wanted = docs.select(F.col("source").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("missing").alias("id")))
    return H.with_missing(wanted, results).select("source", "status")
