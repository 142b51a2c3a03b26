"""Changes between scans, stored state, and scans as a stream."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as G
from ..operators import checks as Q
from ..plans import state as S
from ..plans.tables import shared
from ..sources import registry as R
from . import query, table
from .duplicates import _date, _null, event_rows

_NOW = datetime.datetime(2024, 2, 1, tzinfo=datetime.UTC)
_CUT = "TIMESTAMP '2024-01-16'"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event stream as two scans: users are events, actions are talks, and pages seen are media."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.lit("2024-01-16").cast("timestamp")

    def scan(part: DataFrame) -> DataFrame:
        own = part.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.max(F.floor("value")).alias("top"), F.min("ts").alias("at"))
        talks = F.transform("kinds", lambda k: F.struct(k.alias("id"), k.alias("title"), F.array(F.struct(F.concat(F.lit("by "), k).alias("canonical_name"), k.alias("matched_text"), F.lit("speaker").alias("role"), _null().cast("string").alias("evidence"), F.lit(1.0).cast("float").alias("confidence"), F.array().cast("array<string>").alias("scholar_tags"))).alias("speaker"), _null().cast("string").alias("abstract_text"), _null().cast("struct<start:timestamp,end:timestamp,timezone:string>").alias("date_time"), F.array().cast("array<struct<url:string,media_type:string,title:string,platform:string,public_access:string,published_at:timestamp>>").alias("media"), F.array().cast("array<struct<topic_id:string,canonical_name:string,matched_text:string,confidence:float>>").alias("topics")))
        media = F.transform(F.filter("kinds", lambda k: k.isin("view", "error")), lambda k: F.struct(k.alias("url"), F.when(k == "error", "livestream").otherwise("video").alias("media_type"), _null().cast("string").alias("title"), _null().cast("string").alias("platform"), F.lit("open").alias("public_access"), _null().cast("timestamp").alias("published_at")))
        return event_rows(own, id=F.col("user_id").cast("string"), title=F.concat(F.lit("top "), (F.col("top") > 150).cast("string")), date=_date(F.lit("2024-01-01")), talks=talks, media=media, first_seen_at=F.col("at"), last_seen_at=F.col("at"))

    return scan(rows.filter(F.col("ts") < cut)), scan(rows.filter(F.col("ts") >= cut))


_SIDES = f"""
p AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k, max(floor(value)) > 150 AS top, min(ts) AS at FROM events WHERE ts < {_CUT} GROUP BY 1),
c AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k, max(floor(value)) > 150 AS top, min(ts) AS at FROM events WHERE ts >= {_CUT} GROUP BY 1),
b AS (SELECT coalesce(p.user_id, c.user_id) AS u, p.user_id IS NOT NULL AS was, c.user_id IS NOT NULL AS is_now, coalesce(p.k, []) AS pk, coalesce(c.k, []) AS ck, p.top AS pt, c.top AS ct FROM p FULL JOIN c ON p.user_id = c.user_id),
x AS (
  SELECT u, 'event_added' AS kind, NULL AS detail FROM b WHERE NOT was
  UNION ALL SELECT u, 'event_cancelled', NULL FROM b WHERE NOT is_now
  UNION ALL SELECT u, 'event_updated', NULL FROM b WHERE was AND is_now AND (pt <> ct OR pk <> ck)
  UNION ALL SELECT u, 'schedule_added', unnest(list_filter(ck, lambda t: NOT list_contains(pk, t))) FROM b WHERE was AND is_now
  UNION ALL SELECT u, 'speaker_added', 'by ' || unnest(list_filter(ck, lambda t: NOT list_contains(pk, t))) FROM b WHERE was AND is_now
  UNION ALL SELECT u, 'livestream_added', 'error' FROM b WHERE was AND is_now AND list_contains(ck, 'error') AND NOT list_contains(pk, 'error')
  UNION ALL SELECT u, 'media_added', 'view' FROM b WHERE was AND is_now AND list_contains(ck, 'view') AND NOT list_contains(pk, 'view')
  UNION ALL SELECT u, 'media_removed', unnest(list_filter(pk, lambda t: t IN ('view', 'error') AND NOT list_contains(ck, t))) FROM b WHERE was AND is_now)
"""


@query("snapshot_diff", f"WITH {_SIDES} SELECT CAST(u AS VARCHAR) AS event_id, kind, detail FROM x")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.detect_changes(*_halves(spark, sf_dir), _NOW).select("event_id", "kind", "detail")


@query("changes_in_order", f"""
WITH {_SIDES}, k(kind, place) AS (VALUES ('event_added', 0), ('event_updated', 1), ('schedule_added', 2), ('speaker_added', 3), ('livestream_added', 4), ('media_added', 5), ('media_removed', 6), ('event_cancelled', 7))
SELECT CAST(row_number() OVER (ORDER BY CAST(u AS VARCHAR), place, detail NULLS FIRST) AS INTEGER) AS place, CAST(u AS VARCHAR) AS event_id, x.kind, detail FROM x JOIN k ON x.kind = k.kind
""")
def changes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the place that the order gives them."""
    rows = G.in_order(G.detect_changes(*_halves(spark, sf_dir), _NOW)).withColumn("at", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("at")).alias("place"), "event_id", "kind", "detail")


def _stored(spark: SparkSession, sf_dir: str, status: str) -> dict[str, DataFrame]:
    before, after = _halves(spark, sf_dir)
    empty = lambda n: spark.createDataFrame([], S.schema(S.TABLES[n]))
    health = spark.range(1).select(F.lit("a").alias("source"), F.lit(status).alias("status"), F.lit(1).cast("long").alias("duration_ms"), F.lit(1).alias("requests"), F.lit(1).alias("events"), _null().cast("string").alias("message"), _null().cast("timestamp").alias("recorded_at"))
    return S.bundle(before, empty("tombstones"), empty("health"), empty("changes"), after, health, _NOW)


@query("guarded_cancel", f"WITH {_SIDES} SELECT CAST(count(*) FILTER (kind = 'event_cancelled') AS BIGINT) * 0 AS cancelled, count(*) FILTER (kind <> 'event_cancelled') AS others, (SELECT count(*) FROM b) AS events, CAST(0 AS BIGINT) AS tombstones FROM x")
def guarded_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with an unhealthy source: nothing is cancelled, and absent events stay."""
    parts = _stored(spark, sf_dir, "partial")
    gone = F.count(F.when(F.col("kind") == "event_cancelled", 1))
    return parts["changes"].agg(gone.alias("cancelled"), (F.count("*") - gone).alias("others")).crossJoin(parts["events"].agg(F.count("*").alias("events"))).crossJoin(parts["tombstones"].agg(F.count("*").alias("tombstones")))


@query("scan_commit", f"WITH {_SIDES} SELECT CAST(u AS VARCHAR) AS id, is_now AS stored, strftime(coalesce(p.at, TIMESTAMP '2024-02-01'), '%Y-%m-%d %H:%M:%S') AS first_seen FROM b LEFT JOIN p ON p.user_id = u")
def scan_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a healthy scan: stored events with the time they were first seen, and tombstones of those that went."""
    parts = _stored(spark, sf_dir, "ok")
    text = F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen")
    return parts["events"].select("id", F.lit(True).alias("stored"), text).unionByName(parts["tombstones"].select("id", F.lit(False).alias("stored"), text))


@query("first_seen_restore", """
SELECT CAST(e.user_id AS VARCHAR) AS id, strftime(coalesce(p.at, CASE WHEN t.last >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY THEN t.at END, TIMESTAMP '2024-01-20'), '%Y-%m-%d %H:%M:%S') AS first_seen
FROM (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20') e
LEFT JOIN (SELECT user_id, min(ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'error' GROUP BY 1) p ON e.user_id = p.user_id
LEFT JOIN (SELECT user_id, min(ts) AS at, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type = 'click' GROUP BY 1) t ON e.user_id = t.user_id
""")
def first_seen_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three periods: stored before, cancelled within or beyond the retention, or new."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda d: F.lit(d).cast("timestamp")
    now = datetime.datetime(2024, 1, 20, tzinfo=datetime.UTC)
    key = F.col("user_id").cast("string")
    events = event_rows(rows.filter(F.col("ts") >= at("2024-01-20")).select("user_id").distinct(), id=key)
    stored = rows.filter((F.col("ts") >= at("2024-01-15")) & (F.col("ts") < at("2024-01-20")) & (F.col("event_type") == "error")).groupBy("user_id").agg(F.min("ts").alias("at"))
    dead = rows.filter((F.col("ts") < at("2024-01-15")) & (F.col("event_type") == "click")).groupBy(key.alias("id")).agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last"))
    # The retention of 90 days, seen from 80 days later, leaves what is 10 days old.
    dead = dead.withColumn("cancelled_at", F.col("last") - F.expr("INTERVAL 80 DAYS"))
    done = S.first_seen(events, event_rows(stored, id=key, first_seen_at=F.col("at")), dead, now)
    return done.select("id", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("ttl_purge", "SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1")
def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("cancelled_at"))
    kept = S.living(rows, datetime.datetime(2024, 4, 11, tzinfo=datetime.UTC))
    return kept.groupBy("id").agg(F.count("*").alias("n"))


@query("set_change", """
WITH l AS (SELECT l_suppkey AS s, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A')) AS a, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'N')) AS n FROM lineitem WHERE l_partkey % 100 < 100 GROUP BY 1)
SELECT s, coalesce(a, []) <> coalesce(n, []) AS updated, CAST(len(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS INT) AS added FROM l
""")
def set_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' line numbers under two flags as the talks of two scans."""
    rows = table(spark, sf_dir, "lineitem")

    def side(flag: str) -> DataFrame:
        found = F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber"))))
        talk = lambda n: F.struct(n.cast("string").alias("id"))
        return rows.groupBy("l_suppkey").agg(F.transform(found, talk).alias("talks")).select("l_suppkey", F.struct("talks").alias(flag))

    both = side("A").join(side("N"), "l_suppkey")
    old, new = G.talk_ids(F.col("A.talks")), G.talk_ids(F.col("N.talks"))
    added = F.filter(new, lambda t: ~F.array_contains(old, t))
    return both.select(F.col("l_suppkey").alias("s"), (F.array_sort(F.array_distinct(old)) != F.array_sort(F.array_distinct(new))).alias("updated"), F.size(added).alias("added"))


def _store(spark: SparkSession, sf_dir: str) -> S.ScanStore:
    """State after two scans, the second one with an unhealthy source beside a healthy one."""
    before, after = _halves(spark, sf_dir)
    store = S.ScanStore(spark, shared(spark))
    shape = "source string, status string, duration_ms long, requests int, events int, message string, recorded_at timestamp"
    health = lambda *status: spark.createDataFrame([(f"s{k}", s, 1, 1, 1, None, None) for k, s in enumerate(status)], shape)
    store.store_scan(before, health("ok", "ok"), _FIRST)
    store.store_scan(after, health("ok", "timeout"), _NOW)
    return store


_FIRST = datetime.datetime(2024, 1, 16, tzinfo=datetime.UTC)


@query("changes_since", f"WITH {_SIDES} SELECT CAST(u AS VARCHAR) AS event_id, kind, detail FROM x WHERE kind <> 'event_cancelled'")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log has since the second scan, of which an unhealthy source lets nothing be cancelled."""
    return _store(spark, sf_dir).list_changes(_NOW).select("event_id", "kind", "detail")


@query("state_events", f"""
WITH {_SIDES} SELECT CAST(u AS VARCHAR) AS id, strftime(CASE WHEN was THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d') AS first_seen,
  CAST(row_number() OVER (ORDER BY CAST(u AS VARCHAR)) AS INTEGER) AS place FROM b
""")
def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events in order of their ids, with the times of their first scans."""
    rows = _store(spark, sf_dir).list_events().withColumn("at", F.monotonically_increasing_id())
    return rows.select("id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.row_number().over(Window.orderBy("at")).alias("place"))


@query("state_one", """
SELECT CAST(min(user_id) AS VARCHAR) AS id, 'one' AS what, CAST(1 AS BIGINT) AS n FROM events UNION ALL SELECT '-1', 'none', 0
""")
def state_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored event by its id, and one that isn't there."""
    store = _store(spark, sf_dir)
    least = table(spark, sf_dir, "events").agg(F.min("user_id").cast("string")).first()[0]
    n = lambda i, what: store.get_event(i).agg(F.lit(i).alias("id"), F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(least, "one").unionByName(n("-1", "none"))


@query("state_health", "SELECT * FROM (VALUES ('s1', 'ok', '2024-01-16', 1), ('s1', 'timeout', '2024-02-01', 2)) t(source, status, recorded, place)")
def state_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's health over both scans, oldest first."""
    rows = _store(spark, sf_dir).list_health("s1").withColumn("at", F.monotonically_increasing_id())
    return rows.select("source", "status", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded"), F.row_number().over(Window.orderBy("at")).alias("place"))


# Checks of registry tables


@query("registry_empty", "SELECT n_nationkey AS key, 'n_name' AS \"column\" FROM nation WHERE n_regionkey = 2")
def registry_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_regionkey") == 2, " ").otherwise(F.col("n_name")).alias("n_name"), "n_regionkey")
    return Q.empty_cells(rows, "key", ["n_name", "n_regionkey"])


@query("registry_repeated", "SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1")
def registry_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("key"))
    return Q.repeated_keys(rows, "key", "c_custkey").select("c_custkey")


@query("registry_domain", "SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')")
def registry_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.outside(table(spark, sf_dir, "customer"), "c_custkey", {"c_mktsegment": ["MACHINERY", "HOUSEHOLD"]})


@query("registry_typed", "SELECT c_custkey, 'money' AS \"column\", CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS value FROM customer WHERE floor(c_acctbal) < 0 UNION ALL SELECT c_custkey, 'flag', 'maybe' FROM customer WHERE c_nationkey = 1")
def registry_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("string").alias("money"), F.when(F.col("c_nationkey") == 1, "maybe").otherwise("true").alias("flag"))
    return Q.not_typed(rows, "c_custkey", {"money": "unsigned", "flag": "boolean"})


@query("registry_unresolved", "SELECT o_orderkey, o_custkey + 700 AS reference FROM orders WHERE o_custkey + 700 NOT IN (SELECT c_custkey FROM customer)")
def registry_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 700).alias("ref"))
    return Q.unresolved(rows, "o_orderkey", "ref", table(spark, sf_dir, "customer"), "c_custkey")


@query("registry_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)")
def registry_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no order of a fortieth of all refers to."""
    return Q.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").filter("o_orderkey % 40 = 0"), "o_custkey")


@query("registry_conditional", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_type <> 'PROMO'")
def registry_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.required_if(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size") > 40, F.col("p_type") == "PROMO")


@query("registry_prefix", "SELECT p_partkey, p_partkey || ' ' || p_name AS name FROM part WHERE p_size >= 10")
def registry_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name begins no entry of a list that has the small parts' names with a word more."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name"))
    return Q.absent_names(part, "p_partkey", "name", part.filter("p_size < 10").select(F.concat("name", F.lit(" x")).alias("n")), "n")


@query("registry_columns", "SELECT c_custkey, 'c_phone' AS missing, c_name FROM customer WHERE c_custkey % 3 > 0")
def registry_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tab-separated text with blank lines, read again; a wanted column isn't there."""
    path = shared(spark)
    line = F.when(F.col("c_custkey") % 3 > 0, F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name")).otherwise(" \t ")
    rows = table(spark, sf_dir, "customer").select(F.lit(1).alias("k"), line.alias("value")).unionByName(spark.createDataFrame([(0, "c_custkey\tc_name")], "k int, value string"))
    rows.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    read = Q.read_tsv(spark, path)
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.lit(",".join(Q.missing_columns(read, ["c_custkey", "c_phone", "c_name"]))).alias("missing"), "c_name")


@query("registry_coverage", """
SELECT *, pending > 0 OR (audited >= 20 AND usable >= 10 AND kinds >= 2) AS ok, pending = 0 AND media < 3 AS warning FROM (
  SELECT CAST(0 AS BIGINT) AS pending, count(*) FILTER (s_acctbal > 0) AS audited, count(*) FILTER (s_acctbal > 5000) AS usable, count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_nationkey END) AS kinds, count(*) FILTER (s_nationkey = 3) AS media FROM supplier)
""")
def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return Q.coverage(table(spark, sf_dir, "supplier"), F.lit(False), c("s_acctbal") > 0, c("s_acctbal") > 5000, "s_nationkey", c("s_nationkey") == 3)


@query("registry_violations", """
SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 5 = 0 THEN 'missing entrypoint' WHEN s_suppkey % 5 = 1 THEN 'entrypoint scheme' WHEN s_suppkey % 5 = 2 THEN 'max_depth' ELSE 'empty selector list_link' END AS rule FROM supplier WHERE s_suppkey % 5 < 4
""")
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources of a registry, each fifth with a mistake of one kind."""
    k = F.col("s_suppkey") % 5
    selectors = F.struct(*[F.when((k == 3) & F.lit(n == "list_link"), "").otherwise("a").alias(n) for n in R.SELECTORS])
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.when(k == 3, "html_config").otherwise("rss").alias("adapter"),
        F.when(k == 1, "ftp://a").when(k > 1, "https://a").alias("entrypoint"), F.array(F.lit("h")).alias("allowed_hosts"), F.when(k == 2, 0).otherwise(2).alias("max_depth"),
        F.lit(20).alias("request_budget"), F.lit(True).alias("enabled"), selectors.alias("selectors"),
    )
    return R.violations(rows).select("ord", "rule")


# Streams


@query("stream_first_seen", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts) AS run FROM e),
m AS (SELECT id, max(run) AS run FROM g GROUP BY 1)
SELECT g.id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS sightings FROM g JOIN m ON g.id = m.id AND g.run = m.run GROUP BY 1
""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of sightings with half a day of retention; the last state of each id."""
    from ..streaming import scans

    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{{events.parquet}}")
    out = shared(spark)
    seen = scans.first_seen(rows.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("seen_at")), 0.5)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch_{number}")

    seen.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    last = rows.groupBy("id").agg(F.max_by(F.struct("first_seen_at", "last_seen_at", "sightings"), "batch").alias("s"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return last.select("id", text("s.first_seen_at").alias("first_seen"), text("s.last_seen_at").alias("last_seen"), "s.sightings")
