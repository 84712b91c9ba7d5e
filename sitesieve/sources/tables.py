"""Tables from crawl files and saved answers, and tables written for others."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesieve.functions.urls import domain_of
from sitesieve.operators.graph import top
from sitesieve.operators.pages import plain
from sitesieve.operators.robots import noindex_blocked, robots_blocked  # noqa: F401  part of what is read from robots files

REPORT = (
    "start_url string, pages array<struct<url:string,status:int,title:string,description:string,words:int,depth:int,indexable:boolean,headings:array<struct<level:int,text:string>>>>, "
    "links struct<edges:array<struct<`from`:string,`to`:string,anchor:string,nofollow:boolean>>,truncated:boolean>, issues array<struct<id:string,severity:string,category:string,affected:int>>"
)
#: Metric, short name, good up to, poor beyond.
VITALS = {
    "LARGEST_CONTENTFUL_PAINT_MS": ("LCP", 2500.0, 4000.0), "INTERACTION_TO_NEXT_PAINT": ("INP", 200.0, 500.0), "CUMULATIVE_LAYOUT_SHIFT_SCORE": ("CLS", 0.1, 0.25),
    "FIRST_CONTENTFUL_PAINT_MS": ("FCP", 1800.0, 3000.0), "EXPERIMENTAL_TIME_TO_FIRST_BYTE": ("TTFB", 800.0, 1800.0),
}
SUGGESTION = "seed string, keyword string, source string, position int, seq bigint"


def explode_report(reports: DataFrame, column: str = "report") -> dict[str, DataFrame]:
    """Pages, edges and issues of crawl reports as JSON text, each with the report's other columns."""
    rest = [c for c in reports.columns if c != column]
    parsed = reports.select(*rest, F.from_json(column, REPORT).alias("r"))
    pick = lambda path: parsed.select(*rest, F.col("r.start_url").alias("start_url"), F.inline(path))
    return {"pages": pick("r.pages"), "edges": pick("r.links.edges").withColumnsRenamed({"from": "source", "to": "target"}), "issues": pick("r.issues")}


def extract_sitemap_locs(bodies: DataFrame) -> DataFrame:
    """Every <loc> of sitemap bodies (site, seq, body) once, in order: site, loc, child (it names another sitemap), seq, pos, times (how often it is there)."""
    index = F.lower("body").contains("<sitemapindex")
    rows = bodies.select("site", "seq", index.alias("child"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("pos", "loc")).filter("loc <> ''")
    return rows.groupBy("site", "loc").agg(F.min(F.struct("seq", "pos", "child")).alias("f"), F.count(F.lit(1)).alias("times")).select("site", F.replace("loc", F.lit("&amp;"), F.lit("&")).alias("loc"), F.col("f.child").alias("child"), F.col("f.seq").alias("seq"), F.col("f.pos").alias("pos"), "times")


def parse_robots(bodies: DataFrame) -> DataFrame:
    """robots.txt (site, body) as rows: site, line_no, agents (of the group), directive, value."""
    line = F.trim(F.substring_index("line", "#", 1))
    rows = bodies.select("site", F.posexplode(F.split("body", r"\r?\n|\r")).alias("line_no", "line")).select("site", "line_no", line.alias("line")).filter(F.col("line").contains(":"))
    rows = rows.select("site", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    order = Window.partitionBy("site").orderBy("line_no")
    agent = F.col("directive") == "user-agent"
    start = agent & (F.coalesce(F.lag("directive").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("_group", F.sum(start.cast("int")).over(order))
    return rows.withColumn("agents", F.collect_list(F.when(agent, F.lower("value"))).over(Window.partitionBy("site", "_group"))).drop("_group")


def scan_suggestions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUGGESTION).json(path)


def explode_vitals(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field metrics (site, metric, value, status) and opportunities (site, id, savings_ms) of page-speed answers as JSON text."""
    metric = "map<string,struct<percentile:double>>"
    field = payloads.select("site", F.explode(F.from_json(F.get_json_object("payload", "$.loadingExperience.metrics"), metric)).alias("name", "m"))
    of = lambda k: F.coalesce(*(F.when(F.col("name") == n, v[k]) for n, v in VITALS.items()))
    value = F.when(F.col("name") == "CUMULATIVE_LAYOUT_SHIFT_SCORE", F.col("m.percentile") / 100).otherwise(F.col("m.percentile"))
    rows = field.filter(F.col("name").isin(*VITALS)).select("site", of(0).alias("metric"), value.alias("value"), of(1).alias("good"), of(2).alias("poor")).filter("value is not null")
    status = F.when(F.col("value") <= F.col("good"), "good").when(F.col("value") <= F.col("poor"), "needs-improvement").otherwise("poor")
    audits = F.from_json(F.get_json_object("payload", "$.lighthouseResult.audits"), "map<string,struct<score:double,details:struct<overallSavingsMs:double>>>")
    found = payloads.select("site", F.explode(audits).alias("id", "a")).select("site", "id", F.col("a.details.overallSavingsMs").alias("savings_ms"), F.col("a.score").alias("score"))
    return rows.withColumn("status", status), found.filter("savings_ms >= 150 and (score is null or score < 0.9)").select("site", "id", "savings_ms")


def vitals_hits(metrics: DataFrame, chances: DataFrame, limit: int = 4) -> DataFrame:
    """Findings on metrics that aren't good, and on the largest opportunities of sites that have any metric."""
    bad = metrics.filter("status <> 'good'").select("site", F.concat(F.lit("cwv-"), F.lower("metric")).alias("issue_id"), F.when(F.col("status") == "poor", "high").otherwise("medium").alias("severity"))
    known = chances.join(metrics.select("site").distinct(), "site", "left_semi")
    first = known.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("savings_ms"), "id"))).filter(F.col("_k") <= limit)
    rows = bad.unionByName(first.select("site", F.concat(F.lit("psi-"), "id").alias("issue_id"), F.lit("low").alias("severity")))
    return rows.withColumns({"category": F.lit("performance"), "url": F.lit(None).cast("string")})


def extract_serp(saved: DataFrame) -> DataFrame:
    """Results of saved answer pages (keyword, html) in order: advertisements left out, redirecting links unwrapped."""
    parts = F.split("html", r"(?=<div[^>]*class=\"[^\"]*\bresult\b)")
    organic = F.filter(parts, lambda p: p.rlike(r"^<div[^>]*class=\"[^\"]*\bresult\b") & ~p.rlike(r"^<div[^>]*class=\"[^\"]*result--ad"))
    rows = saved.select("keyword", F.posexplode(organic).alias("pos", "block"))
    tag = F.regexp_extract("block", r"(?is)<a[^>]*class=\"[^\"]*result__a[^\"]*\"[^>]*>.*?</a>", 0)
    href = F.replace(F.regexp_extract(tag, r"(?is)href=\"([^\"]*)\"", 1), F.lit("&amp;"), F.lit("&"))
    target = F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1)
    url = F.when(target != "", F.try_url_decode(target)).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    found = rows.select("keyword", "pos", url.alias("url"), plain(tag).alias("title"), plain(F.regexp_extract("block", r"(?is)class=\"result__snippet[^>]*>(.*?)</", 1)).alias("snippet")).filter(F.col("url").rlike("(?i)^https?://"))
    order = Window.partitionBy("keyword").orderBy("pos")
    return found.select("keyword", F.row_number().over(order).alias("position"), "url", domain_of(F.col("url")).alias("domain"), "title", "snippet")


def decode_bodies(rows: DataFrame, column: str = "body") -> DataFrame:
    """``text`` of binary bodies: the header's charset, else the one a meta tag in the first 4096 bytes names, else UTF-8; what can't be read is replaced."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import codecs
        import re

        meta = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)

        def one(body: bytes | None, kind: str | None) -> str | None:
            if body is None:
                return None
            said = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", kind or "", re.I)
            found = meta.search(body[:4096])
            for name in (said and said[1], found and found[1].decode("ascii"), "utf-8"):
                try:
                    codecs.lookup(name or "")
                except LookupError:
                    continue
                return body.decode(name, errors="replace")

        for bodies, kinds in batches:
            yield pd.Series([one(b, k) for b, k in zip(bodies, kinds, strict=True)])

    return rows.withColumn("text", decode(F.col(column), F.col("content_type")))


def broken_external(probes: DataFrame) -> DataFrame:
    """Probed external links that failed: an error, no status, or one from 400."""
    return probes.filter(F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) == 0) | (F.col("status") >= 400))


def external_sample(links: DataFrame, limit: int = 40) -> DataFrame:
    """The first external urls of each site, each with the first page that links to it."""
    first = links.filter("not internal").groupBy("site", "href").agg(F.min(F.struct("seq", "url")).alias("f"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("f.seq", "href"))).filter(F.col("_k") <= limit)
    return ranked.select("site", "href", F.col("f.url").alias("found_on"))


def scoped(df: DataFrame, tenant: str | None) -> DataFrame:
    return df.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def validate(events: DataFrame, schema: str, required: tuple[str, ...], column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON payload has the required keys, the declared types and no others, and the rest."""
    known = [f.split(":")[0] if ":" in f else f.strip().split(" ")[0] for f in schema.split(",")]
    parsed = F.from_json(column, schema)
    keys = F.json_object_keys(column)
    typed = F.forall(F.array(*(F.get_json_object(column, f"$.{k}").isNull() | parsed[k].isNotNull() for k in known)), lambda x: x)
    present = F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains(keys, k))
    extra = F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0
    ok = F.coalesce(present & typed & ~extra, F.lit(False))
    return events.filter(ok), events.filter(~ok)


def lift(df: DataFrame, columns: dict[str, str], document: str = "report") -> DataFrame:
    """Scalar columns taken out of a JSON document, by name and JSON path, so that listings need not open it."""
    return df.withColumns({name: F.get_json_object(document, path) for name, path in columns.items()})


def write_results(tables: dict[str, DataFrame], folder: str, by: str = "site") -> None:
    """Each table as Parquet below ``folder``, partitioned by ``by`` where it has it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by in df.columns else writer).parquet(f"{folder}/{name}")


def export_audit(issues: DataFrame, scores: DataFrame, stats: DataFrame, wins: DataFrame, folder: str) -> None:
    """Statistics, category scores, quick wins and issues of each site as JSON lines."""
    for name, df in {"stats": stats, "category_scores": scores, "quick_wins": wins, "issues": issues}.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def export_keywords(keywords: DataFrame, clusters: DataFrame, plan: DataFrame, folder: str) -> None:
    for name, df in {"keywords": keywords, "clusters": clusters, "plan": plan}.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def page_by_url(pages: DataFrame, url: str) -> DataFrame:
    return pages.filter((F.col("url") == url) | (F.col("final_url") == url)).limit(1)


def next_actions(opportunities: DataFrame, broken: DataFrame, gaps: DataFrame, issues: DataFrame, limit: int = 5) -> DataFrame:
    """What each site does next: three ranking opportunities, two broken targets, two keyword gaps, then issues: site, place, kind, subject."""

    def part(df: DataFrame, kind: str, subject: str, by: str, group: int, n: int) -> DataFrame:
        rows = df.select("site", F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.lit(group).alias("g"), F.col(by).cast("double").alias("by"))
        return top(rows, [F.desc_nulls_last("by"), F.col("subject")], n)

    parts = (part(opportunities, "rank", "keyword", "opportunity", 0, 3), part(broken, "link", "url", "linked_from", 1, 2), part(gaps, "content", "keyword", "demand", 2, 2), part(issues, "issue", "issue_id", "affected", 3, limit))
    place = F.row_number().over(Window.partitionBy("site").orderBy("g", F.desc_nulls_last("by"), "subject"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).filter(F.col("place") <= limit).select("site", "place", "kind", "subject")
