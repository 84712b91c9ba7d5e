"""Queries of the link graph, rankings and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.operators import compare, graph, rankings, trends
from sitesieve.plans import bindings as b

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_G = f"WITH {b.NODES}, {b.EDGES}"
_IN = "inl AS (SELECT site, target AS url, count(*) AS inlinks FROM (SELECT DISTINCT site, source, target FROM edges) GROUP BY 1, 2)"
_GENERIC = ", ".join(f"'{a}'" for a in graph.GENERIC_ANCHORS)
_RANK = f"""edge_n AS (SELECT e.site, source, target, count(*) AS k FROM edges e JOIN nodes n ON n.site = e.site AND n.url = target GROUP BY 1, 2, 3),
deg AS (SELECT source, sum(k) AS d FROM edge_n GROUP BY 1),
shares AS (SELECT e.source, e.target, CAST(k AS DOUBLE) / d AS share FROM edge_n e JOIN deg USING (source)),
sizes AS (SELECT site, count(*) AS n FROM nodes GROUP BY 1), base AS (SELECT site, url, n, url IN (SELECT source FROM deg) AS links FROM nodes JOIN sizes USING (site)),
pr AS (SELECT 0 AS k, url, 1.0::DOUBLE / n AS rank FROM base
 UNION ALL SELECT k + 1, url, rank FROM (
  SELECT (SELECT max(k) FROM pr) AS k, b.url, {1 - graph.DAMPING}::DOUBLE / n + {graph.DAMPING}::DOUBLE * coalesce(leak, 0) / n + {graph.DAMPING}::DOUBLE * coalesce(g.passed, 0) AS rank
  FROM base b LEFT JOIN (SELECT x.site, sum(p.rank) AS leak FROM pr p JOIN base x USING (url) WHERE NOT x.links GROUP BY 1) l USING (site)
  LEFT JOIN (SELECT s.target AS url, sum(p.rank * s.share) AS passed FROM pr p JOIN shares s ON p.url = s.source GROUP BY 1) g USING (url)) WHERE k < {graph.ROUNDS}),
au AS (SELECT site, url, round(rank / max(rank) OVER (PARTITION BY site) * 100, 1) AS authority FROM pr JOIN nodes USING (url) WHERE k = {graph.ROUNDS})"""
_GR = f"WITH RECURSIVE {b.NODES}, {b.EDGES}, {_RANK}, {_IN}"


@query(f"{_G} SELECT e.site, source, target, status AS target_status, n.indexable AS target_indexable FROM edges e LEFT JOIN nodes n ON n.url = target AND n.site = e.site")
def join_links_pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_target(b.edges(spark, d), b.nodes(spark, d)).select("site", "source", "target", "target_status", "target_indexable")


@query(f"{_G} SELECT site, source, target, anchor, nofollow FROM edges")
def build_graph(spark, d):
    return graph.build_graph(b.nodes(spark, d), b.edges(spark, d))[1].select("site", "source", "target", "anchor", "nofollow")


@query(f"{_G} SELECT site, target AS url, count(*) AS inlinks FROM edges GROUP BY 1, 2")
def inlink_tag_count(spark, d):
    return graph.inlinks_by_tag(b.edges(spark, d))


@query(f"{_G}, {_IN} SELECT * FROM inl")
def inlink_page_count(spark, d):
    return graph.inlink_counts(b.edges(spark, d))


@query(f"{_G} SELECT site, url FROM nodes WHERE indexable AND (site, url) NOT IN (SELECT (site, target) FROM edges) AND url <> '1'")
def anti_join_orphans(spark, d):
    return graph.orphans(b.nodes(spark, d), b.edges(spark, d), F.lit("1"))


@query(f"{_G} SELECT site, url FROM nodes WHERE indexable AND url NOT IN (SELECT source FROM edges e JOIN nodes n ON n.site = e.site AND n.url = target)")
def anti_join_dead_ends(spark, d):
    """Pages without a link to a page of their own site."""
    nodes = b.nodes(spark, d)
    return graph.dead_ends(nodes, graph.with_target(b.edges(spark, d), nodes, "inner"))


@query(f"{_G} SELECT e.site, target AS url, status, count(*) AS linked_from FROM edges e JOIN nodes n ON n.url = target AND n.site = e.site WHERE status NOT BETWEEN 200 AND 299 GROUP BY e.site, target, status QUALIFY row_number() OVER (PARTITION BY e.site ORDER BY count(*) DESC, target) <= 50")
def broken_targets_topk(spark, d):
    return graph.broken_targets(b.nodes(spark, d), b.edges(spark, d))


@query(f"{_G} SELECT e.site, target AS url, count(*) AS linked_from FROM edges e JOIN nodes n ON n.url = target AND n.site = e.site WHERE status BETWEEN 200 AND 299 AND NOT n.indexable GROUP BY e.site, target QUALIFY row_number() OVER (PARTITION BY e.site ORDER BY count(*) DESC, target) <= 25")
def noindex_topk(spark, d):
    return graph.links_to_noindex(b.nodes(spark, d), b.edges(spark, d))


_PROFILE = f"""c AS (SELECT site, target, anchor, count(*) AS n FROM edges GROUP BY ALL),
prof AS (SELECT site, target AS url, list(anchor || '=' || n ORDER BY n DESC, anchor) FILTER (anchor <> '') AS v,
 coalesce(sum(n) FILTER (anchor <> '' AND lower(trim(anchor)) IN ({_GENERIC})), 0) AS generic, coalesce(sum(n) FILTER (anchor = ''), 0) AS empty, sum(n) AS total FROM c GROUP BY 1, 2)"""


@query(f"{_G}, {_PROFILE} SELECT site, url, array_to_string(v[1:10], '|') AS variants, generic, empty, total FROM prof")
def anchor_profile(spark, d):
    out = graph.anchor_profile(b.edges(spark, d))
    return out.withColumn("variants", F.array_join(F.transform("variants", lambda v: F.concat_ws("=", v["anchor"], v["count"].cast("string"))), "|"))


_VAGUE = b.EDGES.replace("t.p_brand AS anchor", "CASE l_partkey % 3 WHEN 0 THEN 'here' WHEN 1 THEN '' ELSE t.p_brand END AS anchor")


def _vague(spark, d):
    key = F.col("target").cast("bigint") % 3
    return b.edges(spark, d).withColumn("anchor", F.when(key == 0, "here").when(key == 1, "").otherwise(F.col("anchor")))


@query(f"WITH {b.NODES}, {_VAGUE}, {_PROFILE} SELECT site, url, generic, empty, total FROM prof WHERE total >= 2 AND generic + empty = total AND (site, url) IN (SELECT (site, url) FROM nodes) QUALIFY row_number() OVER (PARTITION BY site ORDER BY total DESC, url) <= 25")
def undescribed_targets(spark, d):
    return graph.undescribed(b.nodes(spark, d), _vague(spark, d)).drop("variants")


@query(f"{_GR} SELECT site, url, authority FROM au")
def pagerank_authority(spark, d):
    return graph.authority(b.nodes(spark, d), b.edges(spark, d))


@query(f"{_GR} SELECT n.site, n.url, title, authority, coalesce(o, 0) AS outgoing FROM nodes n JOIN au USING (url) LEFT JOIN (SELECT source AS url, count(*) AS o FROM edges GROUP BY 1) USING (url) WHERE indexable QUALIFY row_number() OVER (PARTITION BY n.site ORDER BY authority DESC, n.url) <= 10")
def hubs(spark, d):
    n, e = b.nodes(spark, d), b.edges(spark, d)
    return graph.hubs(n, e, graph.authority(n, e))


@query(f"""{_GR} SELECT n.site, n.url, title, words, coalesce(inlinks, 0) AS inlinks, depth, authority FROM nodes n JOIN au USING (url) LEFT JOIN inl ON inl.site = n.site AND inl.url = n.url
JOIN (SELECT site, list_sort(list(words))[count(*) // 2 + 1] AS mw FROM nodes WHERE indexable AND words > 0 GROUP BY 1) w ON w.site = n.site JOIN (SELECT site, list_sort(list(authority))[count(*) // 2 + 1] AS ma FROM au GROUP BY 1) a ON a.site = n.site
WHERE indexable AND status BETWEEN 200 AND 299 AND n.url <> '1' AND coalesce(inlinks, 0) <= 2 AND words >= mw AND authority <= ma
QUALIFY row_number() OVER (PARTITION BY n.site ORDER BY authority, words DESC, n.url) <= 15""")
def overlooked(spark, d):
    n, e = b.nodes(spark, d), b.edges(spark, d)
    return graph.overlooked(n, e, graph.authority(n, e), F.lit("1"))


@query(f"{_G} SELECT site, list_sort(list(words))[count(*) // 2 + 1] AS middle FROM nodes WHERE indexable GROUP BY 1")
def upper_median(spark, d):
    return graph.upper_median(b.nodes(spark, d).filter("indexable"), "words", "middle")


@query(f"""WITH RECURSIVE {b.NODES}, {b.EDGES}, walk AS (SELECT site, url, 0 AS depth FROM nodes WHERE CAST(url AS BIGINT) < 100 UNION SELECT site, url, 1 FROM nodes WHERE CAST(url AS BIGINT) BETWEEN 100 AND 199
 UNION SELECT walk.site, target, depth + 1 FROM walk JOIN edges ON source = url AND edges.site = walk.site WHERE depth < 3) SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url""")
def click_depth_bfs(spark, d):
    starts = b.nodes(spark, d).filter(F.col("url").cast("bigint") < 200).select("site", "url", F.when(F.col("url").cast("bigint") < 100, 0).otherwise(1).alias("depth"))
    return graph.click_depth(b.edges(spark, d), starts)


@query(f"{_G} SELECT site, depth, count(*) AS pages FROM nodes WHERE indexable GROUP BY 1, 2")
def depth_histogram(spark, d):
    return graph.depth_histogram(b.nodes(spark, d))


@query(f"""{_G}, {_IN}, ps AS (SELECT n.site, count(*) AS pages, count(*) FILTER (indexable) AS indexable_pages, coalesce(round_even(avg(coalesce(inlinks, 0)) FILTER (indexable), 1), 0) AS average_inlinks,
 coalesce(max(depth) FILTER (indexable), 0) AS max_depth FROM nodes n LEFT JOIN inl ON inl.site = n.site AND inl.url = n.url GROUP BY 1),
ls AS (SELECT site, count(*) AS internal_links, count(*) FILTER (nofollow) AS nofollow_internal FROM edges GROUP BY 1)
SELECT ps.*, coalesce(internal_links, 0) AS internal_links, coalesce(nofollow_internal, 0) AS nofollow_internal FROM ps LEFT JOIN ls USING (site)""")
def link_summary(spark, d):
    return graph.link_summary(b.nodes(spark, d), b.edges(spark, d))


# rankings

_R = f"WITH {b.RESULTS}"
_T = "'shop3.example'"
_RK = f"""{_R}, best AS (SELECT keyword, min(position) FILTER (domain = {_T} OR ends_with(domain, '.' || {_T})) AS p FROM results GROUP BY 1),
rk AS (SELECT r.keyword, b.p AS position, min(CASE WHEN r.position = b.p THEN url END) AS url, (SELECT list(x.domain ORDER BY x.m) FROM (SELECT domain, min(position) AS m FROM results z WHERE z.keyword = r.keyword GROUP BY 1) x WHERE x.m < b.p) AS above FROM results r JOIN best b USING (keyword) GROUP BY r.keyword, b.p),
rko AS (SELECT *, CASE WHEN position IS NULL THEN 100 WHEN position = 1 THEN 0 ELSE greatest(0, least(100, CAST(round_even((0.28::DOUBLE - [0.28, 0.15, 0.11, 0.08, 0.06, 0.05, 0.04, 0.03, 0.03, 0.02][position]::DOUBLE) * 100 / 0.28::DOUBLE * 0.9::DOUBLE, 0) AS INTEGER))) END AS opportunity FROM rk)"""


def _ranked(spark, d):
    return rankings.rank(b.results(spark, d), b.target_domain(spark, d))


@query(f"{_RK} SELECT keyword, position, url FROM rko")
def rank_in_results(spark, d):
    return _ranked(spark, d).select("keyword", "position", "url")


@query(f"{_RK} SELECT keyword, coalesce(array_to_string(above, ','), '') AS above FROM rko")
def competitors_above(spark, d):
    return rankings.competitors_above(b.results(spark, d), b.target_domain(spark, d)).select("keyword", F.array_join("competitors_above", ",").alias("above"))


@query(f"{_RK} SELECT keyword, opportunity FROM rko")
def serp_opportunity(spark, d):
    return _ranked(spark, d).select("keyword", "opportunity")


@query(f"{_RK} SELECT keyword, position, opportunity FROM rko ORDER BY opportunity DESC, keyword LIMIT 25")
def serp_opportunities_topk(spark, d):
    return rankings.opportunities(_ranked(spark, d))


@query(f"{_RK} SELECT domain, count(*) AS outranks_on FROM (SELECT unnest(above) AS domain FROM rko) WHERE domain <> {_T} AND NOT ends_with(domain, '.' || {_T}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_competitors(spark, d):
    return rankings.top_competitors(_ranked(spark, d), b.target_domain(spark, d))


@query(f"{_RK} SELECT count(*) AS keywords_checked, count(position) AS keywords_ranked, count(*) - count(position) AS keywords_missing, round_even(avg(position), 1) AS average_position, min_by(keyword, (position, keyword)) FILTER (position IS NOT NULL) AS best_keyword, min(position) AS best_position FROM rko")
def serp_summary(spark, d):
    return rankings.summary(_ranked(spark, d))


# runs and trends

_W = f"WITH {b.RUNS}, done AS (SELECT *, lag(run_id) OVER w AS prev FROM runs WHERE status = 'completed' WINDOW w AS (PARTITION BY site ORDER BY created_at, run_id))"


@query(f"{_W} SELECT run_id, prev AS previous_run_id FROM done")
def previous_run(spark, d):
    return trends.previous_run(b.runs(spark, d))


@query(f"WITH {b.RUNS} SELECT run_id, site, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) AS place FROM runs WHERE status = 'completed') WHERE place <= 12")
def run_history(spark, d):
    return trends.history(b.runs(spark, d)).select("run_id", "site", "place")


@query(f"WITH {b.RUNS} SELECT run_id, status, place FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, run_id DESC) AS place FROM runs) WHERE place <= 20")
def recent_runs(spark, d):
    return trends.recent(b.runs(spark, d)).select("run_id", "status", "place")


def _trend_sql() -> str:
    parts = []
    for m, (way, least) in trends.METRICS.items():
        if m in ("keywords_ranked", "average_position", "behind_on"):
            continue
        fair = "AND least(a.pages_crawled, p.pages_crawled) > 0 AND abs(a.pages_crawled - p.pages_crawled) <= 0.2 * greatest(a.pages_crawled, p.pages_crawled)" if m in trends.COUNTING else ""
        better = ">" if way == "higher" else "<"
        parts.append(f"SELECT a.run_id, a.site, '{m}' AS metric, p.{m} AS before, a.{m} AS after, round_even(a.{m} - p.{m}, 2) AS change, CASE WHEN abs(round_even(a.{m} - p.{m}, 2)) < {least} THEN 'level' WHEN a.{m} - p.{m} {better} 0 THEN 'better' ELSE 'worse' END AS direction FROM done a JOIN done p ON a.prev = p.run_id WHERE p.{m} IS NOT NULL AND a.{m} IS NOT NULL {fair}")
    return " UNION ALL ".join(parts)


@query(f"{_W} {_trend_sql()}")
def metric_trend(spark, d):
    return trends.metric_trend(b.runs(spark, d))


@query(f"{_W}, t AS ({_trend_sql()}) SELECT run_id, site, count(*) FILTER (direction = 'better') AS better, count(*) FILTER (direction = 'worse') AS worse, max(change) FILTER (metric = 'overall_score' AND direction <> 'level') AS score_change FROM t GROUP BY 1, 2")
def trend_headline(spark, d):
    return trends.trend_headline(trends.metric_trend(b.runs(spark, d)))


_CAT = " UNION ALL ".join(f"SELECT a.run_id, a.site, '{c}' AS category, p.{c} AS before, a.{c} AS after, CAST(a.{c} - p.{c} AS DOUBLE) AS change FROM done a JOIN done p ON a.prev = p.run_id" for c in ("content", "links"))


@query(f"{_W}, c AS ({_CAT}) SELECT *, CASE WHEN abs(change) < 3 THEN 'level' WHEN change > 0 THEN 'better' ELSE 'worse' END AS direction, row_number() OVER (PARTITION BY run_id ORDER BY abs(change) DESC, category) AS place FROM c")
def category_trend(spark, d):
    return trends.category_trend(b.runs(spark, d))


@query(f"{_W} SELECT a.run_id, coalesce(least(a.pages_crawled, p.pages_crawled) > 0 AND abs(a.pages_crawled - p.pages_crawled) <= 0.2 * greatest(a.pages_crawled, p.pages_crawled), false) AS comparable FROM done a LEFT JOIN done p ON a.prev = p.run_id")
def sample_comparability(spark, d):
    rows = trends.with_previous(b.runs(spark, d), "pages_crawled")
    return rows.select("run_id", F.coalesce(trends.comparable(F.col("previous_pages_crawled"), F.col("pages_crawled")), F.lit(False)).alias("comparable"))


@query("WITH w AS (SELECT DISTINCT l_orderkey AS comparison_id, CASE WHEN l_linenumber = 1 THEN 'mine' ELSE 'competitor' END AS role, l_suppkey AS crawl_id FROM lineitem), j AS (SELECT w.*, s.s_name AS site, s.s_suppkey IS NOT NULL AS available FROM w LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = w.crawl_id) SELECT *, CASE WHEN bool_or(role = 'mine' AND available) OVER (PARTITION BY comparison_id) THEN 'completed' ELSE 'failed' END AS status FROM j")
def join_reports(spark, d):
    role = F.when(F.col("l_linenumber") == 1, "mine").otherwise("competitor")
    wanted = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("comparison_id"), role.alias("role"), F.col("l_suppkey").alias("crawl_id"))
    reports = b.read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("crawl_id"), F.col("s_name").alias("site"))
    return compare.assemble(wanted, reports)
