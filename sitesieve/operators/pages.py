"""Page facts from crawled html: one Arrow pass over the markup as a tree, the rest native expressions.

The markup is read once (``functions.markup``) and gives what the page says as it says it; urls are resolved, words are
counted and hashes are taken by Spark. The main text is that of the ``main``, ``article``, ``role=main``, ``#content``,
``.content`` or ``#main`` element with most words if it has 50, else the body without navigation, headers, footers,
asides and forms if that has 30, else the body.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sitesieve.functions.markup import FACTS, facts_of
from sitesieve.functions.text import content_hash, count_words
from sitesieve.functions.urls import is_internal, origin_of, resolve

#: Patterns that say in SQL what the markup reader does on markup without nesting.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>|<iframe\b.*?</iframe\s*>|<!--.*?-->"
BOILERPLATE = r"(?is)<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<aside\b.*?</aside\s*>|<form\b.*?</form\s*>"
TAGS = r"(?s)<[^>]*>"
#: Pages of an Arrow batch that are Python objects at once.
PAGES_AT_ONCE = 64
#: Columns of a crawl that a table may lack, and what stands for them.
DEFAULTS = {
    "final_url": "url", "status_code": "200", "error": "cast(null as string)", "redirect_chain": "cast(array() as array<struct<code:int,url:string>>)", "headers": "cast(map() as map<string,string>)",
    "content_type": "'text/html'", "elapsed_ms": "0", "byte_size": "octet_length(html)", "depth": "0", "crawl_seq": "0",
}


def with_defaults(pages: DataFrame) -> DataFrame:
    """A crawl table with every fetch column; the site is the host where there is none."""
    site = F.expr(r"regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)")
    out = pages if "site" in pages.columns else pages.withColumn("site", site)
    return out.withColumns({k: F.expr(v) for k, v in DEFAULTS.items() if k not in pages.columns})


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.parquet(path))


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Text of markup: tags as spaces, references decoded, white space as one space."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, TAGS, " ")), r"\s+", " "))


def markup(html: Column) -> Column:
    """The facts of ``functions.markup`` as a struct."""
    kind = StructType.fromDDL(FACTS)

    @F.arrow_udf(kind)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield facts_array(pages, kind)

    return read(html)


def facts_array(pages: pa.Array, kind: StructType) -> pa.Array:
    """Facts of an Arrow batch of html texts, a few pages at a time: Python objects are larger than what Arrow makes of them."""

    def some(html: pa.Array) -> pa.Array:
        rows = [{k: _pairs(f[k]) if k in ("og", "twitter") else _rows(f.get(k), kind[k].dataType) for k in kind.names} for f in map(facts_of, html.to_pylist())]
        return pa.array(rows, to_arrow_type(kind))

    return pa.concat_arrays([some(pages.slice(at, PAGES_AT_ONCE)) for at in range(0, max(len(pages), 1), PAGES_AT_ONCE)])


def _pairs(found: dict) -> list[tuple[str, str]]:
    return list(found.items())


def _rows(found, kind):
    """Tuples as the structs that they stand for."""
    element = getattr(kind, "elementType", None)
    return found if element is None or not hasattr(element, "names") else [dict(zip(element.names, x, strict=True)) for x in found]


def page_facts(pages: DataFrame) -> DataFrame:
    """Every fact that the rules read, beside the crawl columns. Null html is as an empty page, but its content has no hash."""
    out = pages.withColumn("_p", markup(F.col("html")))
    own = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    out = out.withColumn("_base", F.coalesce(resolve(own, F.col("_p.base")), own))
    p = lambda name: F.col(f"_p.{name}")
    # the base is evaluated once for each page and not once for each link
    with_base = lambda rows, f: F.flatten(F.transform(F.array("_base"), lambda base: F.transform(rows, lambda x: f(base, x))))
    image = lambda base, x: F.struct(F.when(x["src"] != "", resolve(base, x["src"])).otherwise("").alias("src"), *(x[n].alias(n) for n in ("alt", "width", "height", "loading")))
    link = lambda base, x: F.struct(resolve(base, x["raw"]).alias("href"), x["raw"].alias("raw"), x["anchor"].alias("anchor"), x["rel"].alias("rel"))
    links = F.filter(with_base(p("anchors"), link), lambda x: F.lower(x["href"]).rlike("^https?://"))
    with_side = F.transform(links, lambda x: F.struct(x["href"].alias("href"), x["raw"].alias("raw"), x["anchor"].alias("anchor"), x["rel"].alias("rel"), is_internal(x["href"], F.col("url")).alias("internal")))
    alternate = lambda base, x: F.struct(x["code"].alias("code"), resolve(base, x["href"]).alias("href"))
    same = ("title", "viewport", "lang", "charset", "og", "twitter", "jsonld", "microdata", "external_scripts", "blocking_scripts", "inline_script_bytes", "inline_style_bytes", "blocking_styles", "iframes", "headings", "text")
    out = out.withColumns({
        **{name: p(name) for name in same},
        "meta_description": p("description"),
        "meta_robots": F.coalesce(F.nullif(p("robots"), F.lit("")), p("googlebot"), F.lit("")),
        "canonical": F.when(p("canonical") != "", resolve(F.col("_base"), p("canonical"))),
        "favicon": resolve(F.col("_base"), p("favicon")),
        "hreflang": with_base(p("hreflang"), alternate),
        "images": with_base(p("images"), image),
        "links": with_side,
        "main_part": p("main"),
    })
    return out.withColumns({"words": count_words(F.col("text")), "content_hash": F.when(F.col("html").isNotNull(), content_hash(F.col("text")))}).drop("_p", "_base")


def with_flags(pages: DataFrame) -> DataFrame:
    """is_html, is_ok, is_noindex, is_indexable."""
    robots = F.lower(F.concat_ws(",", F.coalesce("meta_robots", F.lit("")), F.coalesce(F.element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), F.lit("x-robots-tag")), F.lit(""))))
    out = pages.withColumns({
        "is_html": F.lower(F.coalesce("content_type", F.lit(""))).contains("html"),
        "is_ok": F.col("error").isNull() & (F.col("status_code") >= 200) & (F.col("status_code") < 300),
        "is_noindex": robots.contains("noindex"),
    })
    return out.withColumn("is_indexable", F.col("is_html") & F.col("is_ok") & ~F.col("is_noindex"))


def page_links(facts: DataFrame, *kept: str) -> DataFrame:
    """One row per link, in page order: site, url, pos, href, raw, anchor, rel, internal, nofollow, and what is ``kept`` of the page (several may have one url)."""
    rows = facts.select("site", "url", *kept, F.posexplode("links").alias("pos", "l")).select("site", "url", *kept, "pos", "l.*")
    return rows.withColumn("nofollow", F.lower("rel").contains("nofollow"))


def page_headings(facts: DataFrame) -> DataFrame:
    return facts.select("site", "url", F.posexplode("headings").alias("pos", "h")).select("site", "url", "pos", "h.level", "h.text")


def page_images(facts: DataFrame) -> DataFrame:
    return facts.select("site", "url", F.posexplode("images").alias("pos", "i")).select("site", "url", "pos", "i.*", (F.col("pos") < 3).alias("first_viewport"))


def term_density(facts: DataFrame) -> DataFrame:
    """The commonest token of three or more characters of each page: term, hits, tokens, density."""
    tokens = facts.select("site", "url", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']{3,}"), F.lit(0))).alias("term"))
    counted = tokens.groupBy("site", "url", "term").agg(F.count(F.lit(1)).alias("hits"))
    top = counted.groupBy("site", "url").agg(F.sum("hits").alias("tokens"), F.min(F.struct((-F.col("hits")).alias("o"), "term")).alias("t"))
    return top.select("site", "url", F.col("t.term").alias("term"), (-F.col("t.o")).alias("hits"), "tokens", (-F.col("t.o") / F.col("tokens")).alias("density"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values that several pages of a site share, with their number."""
    return df.groupBy("site", key).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") > 1)


def report_pages(facts: DataFrame, headings: int = 20) -> DataFrame:
    return facts.select("site", "url", "status_code", "title", F.col("meta_description").alias("description"), "words", "depth", "is_indexable", "elapsed_ms", "content_hash", F.slice("headings", 1, headings).alias("headings"))


def site_origin(facts: DataFrame) -> DataFrame:
    return facts.groupBy("site").agg(F.min_by("url", F.struct("crawl_seq", "url")).alias("start_url")).withColumn("origin", origin_of(F.col("start_url")))
