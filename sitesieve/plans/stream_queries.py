"""Streams and tables of events over the driver's event table, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitesieve.operators import keywords, rankings
from sitesieve.plans import bindings as b
from sitesieve.sources import tables
from sitesieve.streaming import batches as m
from sitesieve.streaming import events as e

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark, d):
    """The event table as a stream of envelopes; what lacks a field is malformed."""
    table = b.read(spark, d, "events")
    rows = spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("site."), "event_type").alias("type"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("user_id").cast("string").alias("run_id"),
        (F.col("event_id") % 5).cast("string").alias("job_id"), F.when(F.col("value") > 10, "failed").otherwise("completed").alias("status"), F.get_json_object("props", "$.k").alias("content_hash"), F.col("value"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'site.' || event_type AS type FROM events")
def dedup_event_id(spark, d):
    twice = _stream(spark, d).unionByName(_stream(spark, d))
    return e.drain(e.dedup(twice, "400 days").select("id", "type"), "dedup")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click'")
def route_by_type(spark, d):
    return e.drain(e.route(_stream(spark, d), "*.click").select("id"), "route")


@query("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id % 5 AS VARCHAR) AS job_id, CASE WHEN value > 10 THEN 'failed' ELSE 'completed' END AS status, ts FROM events) SELECT run_id, job_id, (min((ts, status)))[2] AS status, count(*) AS seen FROM s GROUP BY 1, 2")
def step_state_fold(spark, d):
    return e.drain(e.fold_steps(_stream(spark, d)).drop("completed_at"), "fold", "complete")


@query("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS url, json_extract_string(props, '$.k') AS h, ts, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT url, p AS previous_hash, h AS content_hash FROM s WHERE h IS DISTINCT FROM p")
def page_change_stream(spark, d):
    updates = _stream(spark, d).select(F.col("run_id").alias("url"), "content_hash", F.col("occurred_at").alias("at"))
    folder = m.run(updates, "changes", m.change_step, ("url",), m.CHANGE_STATE, "400 days")
    return m.sink(spark, folder, "changes", m.CHANGES).drop("at")


@query("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS channel_id, event_type AS id, CASE WHEN value < 20 THEN 503 ELSE 200 END AS status, ts, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events) SELECT channel_id, id, count(*) AS attempts FROM s WHERE coalesce(done, 0) = 0 GROUP BY 1, 2")
def delivery_claim(spark, d):
    attempts = _stream(spark, d).select(F.col("run_id").alias("channel_id"), F.substring_index("type", ".", -1).alias("id"), F.col("occurred_at").alias("at"), F.when(F.col("value") < 20, 503).otherwise(200).alias("status"))
    folder = m.run(attempts, "claims", m.claim_step, ("channel_id", "id"), m.CLAIM_STATE, "400 days")
    return m.sink(spark, folder, "attempts", m.ATTEMPTS).groupBy("channel_id", "id").agg(F.count(F.lit(1)).alias("attempts"))


@query("WITH s AS (SELECT DISTINCT CAST(event_id % 5 AS VARCHAR) AS job_id FROM events WHERE event_id % 5 < 3) SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 5 < 3")
def completion_match(spark, d):
    steps = b.read(spark, d, "events").select((F.col("event_id") % 5).cast("string").alias("job_id")).filter("job_id < 3")
    return e.drain(e.match_completions(_stream(spark, d), steps).select("id"), "match")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN contains(event_type, 'error') OR value IS NULL THEN 'dead' ELSE 'events' END AS sink FROM events")
def dead_letter_split(spark, d):
    """Both sinks of one stream: sound envelopes, and the texts of the others."""
    fields = F.struct("id", F.when(~F.col("type").contains("error"), F.col("type")).alias("type"), F.lit(1).alias("version"), "occurred_at", F.lit("site").alias("producer"), F.col("value").cast("string").alias("payload"))
    folder = m.run(_stream(spark, d).select(F.to_json(fields).alias("value")), "letters", m.letter_step)
    dead = m.sink(spark, folder, "dead", m.DEAD).select(F.get_json_object("value", "$.id").alias("id"), F.lit("dead").alias("sink"))
    return m.sink(spark, folder, "events", m.EVENTS).select("id", F.lit("events").alias("sink")).unionByName(dead)


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS site, CAST(event_id AS VARCHAR) AS url, event_type, value FROM events)
SELECT site, 'page.updated' AS type, url AS subject FROM s WHERE value <= 10 UNION ALL SELECT site, 'crawl.completed', site FROM s WHERE event_type = 'purchase'""")
def completion_fanout(spark, d):
    """Every page of a finished crawl as an update, and the crawl's completion, into two sinks."""
    crawls = _stream(spark, d).select(F.col("run_id").alias("site"), F.col("id").alias("url"), "content_hash", (F.col("status") == "completed").alias("indexable"), "type")
    folder = m.run(crawls, "fanout", m.fanout_step(F.col("type") == "site.purchase"))
    updates = m.sink(spark, folder, "updates", m.UPDATES).drop("content_hash")
    return updates.unionByName(m.sink(spark, folder, "completions", m.COMPLETIONS))


@query(
    "WITH s AS (SELECT *, event_id % 7 AS k, value IS NOT NULL AS given FROM events) SELECT CAST(user_id AS VARCHAR) AS run_id, "
    + ", ".join(
        f"arg_min({'value' if kind == 'double' else 'event_id'}, event_id) FILTER (k = {k} AND given) AS {name}"
        for name, k, kind in (("overall_score", 0, "double"), ("total_issues", 0, ""), ("keywords_found", 1, ""), ("keywords_ranked", 2, ""), ("average_position", 2, "double"), ("orphan_pages", 3, ""), ("keyword_coverage", 4, "double"), ("pages_to_rewrite", 5, ""), ("competitors_compared", 6, ""))
    )
    + ", CASE WHEN count(*) FILTER (k = 6 AND given) > 0 THEN CAST(1 AS BIGINT) END AS behind_on FROM s GROUP BY 1"
)
def workflow_headline(spark, d):
    kinds = ("crawl", "keyword_research", "serp_check", "link_analysis", "content_analysis", "optimizer_plan", "competitor_check")
    value, number = F.col("value"), F.col("event_id")
    fields = {"overall_score": value, "total_issues": number, "total": number, "keywords_ranked": number, "average_position": value, "orphan_count": number, "coverage": value, "pages_with_fixes": number, "compared_against": number, "behind_on": F.array("event_type")}
    result = F.when(value.isNotNull(), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))).otherwise("{}")
    kind = F.get(F.array(*(F.lit(k) for k in kinds)), (number % 7).cast("int"))
    return e.headline(b.read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), number.alias("position"), kind.alias("kind"), result.alias("result")))


@query("SELECT a.user_id::VARCHAR AS correlation_id, CAST(c.event_id AS VARCHAR) AS cause, CAST(a.event_id AS VARCHAR) AS effect, c.event_type AS cause_type, a.event_type AS type FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a JOIN events c ON c.user_id = a.user_id AND c.event_id = a.before")
def trace_chain(spark, d):
    rows = b.read(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.trace(rows.select(F.col("user_id").cast("string").alias("correlation_id"), F.col("event_id").cast("string").alias("id"), before.cast("string").alias("causation_id"), F.col("event_type").alias("type")))


@query("SELECT CAST(user_id AS VARCHAR) AS seed, event_type AS source, count(*) FILTER (value < 20) AS failures, count(*) AS requests FROM events GROUP BY 1, 2")
def source_failures(spark, d):
    error = F.when(F.col("value") < 20, "timeout").alias("error")
    return keywords.source_failures(b.read(spark, d, "events").select(F.col("user_id").cast("string").alias("seed"), F.col("event_type").alias("source"), error))


@query("SELECT CAST(event_id AS VARCHAR) AS keyword, CASE WHEN value < 20 THEN 'timeout' END AS error FROM events")
def serp_failure_split(spark, d):
    error = F.when(F.col("value") < 20, "timeout").alias("error")
    answered, failed = rankings.split_failures(b.read(spark, d, "events").select(F.col("event_id").cast("string").alias("keyword"), error))
    return answered.select("keyword", F.lit(None).cast("string").alias("error")).unionByName(failed)


def _part(name, k, subject, by, group, n):
    return f"SELECT * FROM (SELECT user_id, '{name}' AS kind, {subject} AS subject, {group} AS g, {by} AS by_, row_number() OVER (PARTITION BY user_id ORDER BY {by} DESC NULLS LAST, {subject}) AS k FROM {'events' if name != 'issue' else 'issues_'} WHERE {k}) WHERE k <= {n}"


@query(
    "WITH issues_ AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 4 = 3 GROUP BY 1, 2), p AS ("
    + " UNION ALL ".join(_part(*x) for x in (("rank", "event_id % 4 = 0", "CAST(event_id AS VARCHAR)", "value", 0, 3), ("link", "event_id % 4 = 1", "'/' || event_id", "event_id % 50", 1, 2), ("content", "event_id % 4 = 2", "CAST(event_id AS VARCHAR)", "value", 2, 2), ("issue", "true", "event_type", "n", 3, 5)))
    + "), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g, by_ DESC NULLS LAST, subject) AS place FROM p) SELECT user_id AS site, place, kind, subject FROM q WHERE place <= 5"
)
def next_actions_topk(spark, d):
    rows = b.read(spark, d, "events").withColumnRenamed("user_id", "site")
    part = lambda k: rows.filter(F.col("event_id") % 4 == k)
    name = F.col("event_id").cast("string")
    issues = part(3).groupBy("site", F.col("event_type").alias("issue_id")).agg(F.count(F.lit(1)).alias("affected"))
    return tables.next_actions(
        part(0).select("site", name.alias("keyword"), F.col("value").alias("opportunity")), part(1).select("site", F.concat(F.lit("/"), name).alias("url"), (F.col("event_id") % 50).alias("linked_from")),
        part(2).select("site", name.alias("keyword"), F.col("value").alias("demand")), issues,
    )
