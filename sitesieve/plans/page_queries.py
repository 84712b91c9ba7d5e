"""Queries of page facts, rules, scores and scalar expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesieve.functions import text as t
from sitesieve.functions import urls as u
from sitesieve.operators import audit, pages, schedules, structured
from sitesieve.operators.graph import GENERIC_ANCHORS
from sitesieve.functions.shared import shared_folder
from sitesieve.plans import bindings as b
from sitesieve.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _plain(x: str) -> str:
    tags = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({_unescape(tags)}, '\s+', ' ', 'g'), ' ')"


_WORD = t.WORDS.replace("'", "''")
_COUNT = f"len(regexp_extract_all({{}}, '{_WORD}'))"
_FACTS = rf"""p0 AS (SELECT *, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, regexp_replace(html, '{pages.HIDDEN}', ' ', 'g') AS seen FROM pages),
p1 AS (SELECT *, trim({_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, ' ') AS title, regexp_extract(html, '(?is)<html[^>]*\slang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?is)<meta[^>]*\scharset="([^"]*)"', 1) AS charset,
 {_plain("regexp_extract(seen, '(?is)<(?:article|main)[^>]*>.*?</(?:article|main)>', 0)")} AS main, {_plain(f"regexp_replace(regexp_extract(seen, '(?is)<body[^>]*>(.*)', 1), '{pages.BOILERPLATE}', ' ', 'g')")} AS bare, {_plain("regexp_extract(seen, '(?is)<body[^>]*>(.*)', 1)")} AS whole,
 list_transform(regexp_extract_all(seen, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>'), lambda h: (CAST(substr(h, 3, 1) AS INTEGER), {_plain("h")})) AS heads FROM p0),
p2 AS (SELECT *, CASE WHEN {_COUNT.format("main")} >= 50 THEN main WHEN {_COUNT.format("bare")} >= 30 THEN bare ELSE whole END AS text FROM p1),
facts AS (SELECT *, {_COUNT.format("text")} AS words, sha1(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')) AS content_hash FROM p2)"""
_F = f"WITH {_FACTS}"
_HREFS = r"""hrefs AS (SELECT page_id, url, site, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\shref="([^"]*)"[^>]*>', 1)) AS raw FROM facts),
lk AS (SELECT *, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || trim(raw) AS href FROM hrefs)"""


def facts(spark, d):
    return pages.page_facts(pages.with_defaults(b.read(spark, d, "pages")))


@query("SELECT page_id, url, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, 200 AS status_code, 'text/html' AS content_type, 0 AS depth, strlen(html) AS byte_size FROM pages")
def scan_crawl_pages(spark, d):
    return pages.scan_pages(spark, f"{d}/pages.parquet").select("page_id", "url", "site", "status_code", "content_type", "depth", "byte_size")


@query(f"{_F}, {_HREFS} SELECT site, url, raw, href, true AS internal FROM lk")
def page_links(spark, d):
    return pages.page_links(facts(spark, d)).select("site", "url", "raw", "href", "internal")


@query(f"{_F}, {_HREFS} SELECT site, url, href FROM lk WHERE NOT regexp_matches(lower(regexp_extract(href, '^[^:]+://[^/?#]*([^?#]*)', 1)), '({'|'.join(e[1:] for e in u.FILE_ENDINGS)})$') OR NOT regexp_matches(lower(href), '[.]({'|'.join(e[1:] for e in u.FILE_ENDINGS)})$')")
def crawlable_filter(spark, d):
    return pages.page_links(facts(spark, d)).filter(u.is_crawlable(F.col("href"))).select("site", "url", "href")


@query(f"{_F} SELECT site, url, h[1] AS level, h[2] AS text FROM (SELECT site, url, unnest(heads) AS h FROM facts)")
def page_headings(spark, d):
    return pages.page_headings(facts(spark, d)).select("site", "url", "level", "text")


_BARE = lambda seen: _plain(f"regexp_replace(regexp_extract({seen}, '(?is)<body[^>]*>(.*)', 1), '{pages.BOILERPLATE}', ' ', 'g')")
_WHOLE = lambda seen: _plain(f"regexp_extract({seen}, '(?is)<body[^>]*>(.*)', 1)")


@query(rf"""{_F}, v0 AS (SELECT page_id, regexp_replace({b.SPELLED}, '{pages.HIDDEN}', ' ', 'g') AS seen FROM pages), v1 AS (SELECT page_id, {_BARE("seen")} AS rest, {_WHOLE("seen")} AS body FROM v0),
v2 AS (SELECT page_id, rest, body, CASE page_id % {len(b.MAINS)} WHEN 4 THEN main || ' More to read.' WHEN 7 THEN '' ELSE main END AS m FROM facts JOIN v1 USING (page_id)),
v3 AS (SELECT page_id, CASE WHEN {_COUNT.format("m")} >= 50 THEN 'main' WHEN {_COUNT.format("rest")} >= 30 THEN 'bare' ELSE 'body' END AS main_part, m, rest, body FROM v2),
v4 AS (SELECT page_id, main_part, CASE main_part WHEN 'main' THEN m WHEN 'bare' THEN rest ELSE body END AS text FROM v3)
SELECT page_id, main_part, text, {_COUNT.format("text")} AS words, sha1(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')) AS content_hash FROM v4""")
def page_main_text(spark, d):
    """Over all pages, with the main element written in each of the ways that are looked for."""
    found = pages.page_facts(pages.with_defaults(b.spelled(b.read(spark, d, "pages"))))
    return found.select("page_id", "main_part", "text", "words", "content_hash")


_SITED = r"p AS (SELECT *, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin FROM pages)"


def _structured(spark, d):
    return pages.page_facts(pages.with_defaults(b.structured(b.read(spark, d, "pages"))))


@query(f"WITH {_SITED} SELECT site, url, n, part, pos, block, types FROM p JOIN (VALUES {b.STRUCTURED_ROWS}) v(m, n, part, pos, block, types) ON page_id % {len(b.STRUCTURED)} = m")
def page_jsonld_blocks(spark, d):
    """Objects, items of lists and graphs, envelopes and broken blocks over all pages, with structured data by their number."""
    return structured.jsonld_blocks(_structured(spark, d)).withColumn("types", F.array_join("types", " "))


@query(f"WITH {_SITED} SELECT site, url, pos, type FROM p, (VALUES (0, 'Product'), (1, 'Offer')) v(pos, type) WHERE page_id % {len(b.STRUCTURED)} = 1")
def page_microdata_types(spark, d):
    return structured.microdata_types(_structured(spark, d))


@query(rf"""WITH {_SITED} SELECT site, url, 0 AS pos, 'fr' AS code, origin || '/fr' AS href FROM p WHERE page_id % 6 = 4
UNION ALL SELECT site, url, 0, 'de', CASE WHEN regexp_matches(url, '^[^:]+://[^/?#]+/') THEN regexp_extract(url, '^([^?#]*/)', 1) ELSE origin || '/' END || 'de' FROM p WHERE page_id % 6 = 5 UNION ALL SELECT site, url, 1, 'x-default', 'https://other.example/' FROM p WHERE page_id % 6 = 5""")
def page_hreflang(spark, d):
    return structured.alternates(_structured(spark, d))


@query(r"SELECT page_id, trim(unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\shref=\"([^\"]*)\"[^>]*>', 1))) AS raw FROM pages")
def udtf_links(spark, d):
    """Links by a table function beside each page."""
    return b.read(spark, d, "pages").lateralJoin(structured.LinksOf(F.col("html").outer())).select("page_id", "raw")


@query(f"SELECT page_id, n, block AS raw FROM pages JOIN (VALUES {b.STRUCTURED_ROWS}) v(m, n, part, pos, block, types) ON page_id % {len(b.STRUCTURED)} = m WHERE part IN ('object', 'error')")
def udtf_jsonld(spark, d):
    """Scripts that are one object or broken, by a table function beside each page."""
    rows = b.structured(b.read(spark, d, "pages")).lateralJoin(structured.JsonldOf(F.col("html").outer()))
    return rows.filter("raw not like '[%' and raw not like '{\"@context%' and raw not like '%graph\":[%' and raw <> '7'").select("page_id", "n", "raw")


@query(f"WITH {b.CRAWL}, im AS (SELECT regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, url, unnest(regexp_extract_all({b.BODY_BY_PAGE}, '(?is)<img[^>]*>')) AS tag FROM crawled) SELECT site, url, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || regexp_extract(tag, 'src=\"([^\"]*)\"', 1) AS src, CASE WHEN tag LIKE '% alt=%' THEN length(regexp_extract(tag, 'alt=\"([^\"]*)\"', 1)) END AS alt_length, tag LIKE '%loading=\"lazy\"%' AS lazy FROM im")
def page_images(spark, d):
    """Images of the crawl, of which the first three of a page are in its first view."""
    rows = pages.page_images(pages.page_facts(pages.with_defaults(b.crawl(spark, d))))
    return rows.select("site", "url", "src", F.length("alt").alias("alt_length"), (F.coalesce("loading", F.lit("")) == "lazy").alias("lazy"))


@query(r"""SELECT page_id, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1), lambda s: length(s))), 0) AS inline_script_bytes,
 coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), lambda s: length(s))), 0) AS inline_style_bytes, len(regexp_extract_all(html, '(?i)<iframe\b')) AS iframes FROM pages""")
def page_resource_counts(spark, d):
    return facts(spark, d).select("page_id", "inline_script_bytes", "inline_style_bytes", "iframes")


@query(f"{_F} SELECT site, content_hash, count(*) AS pages FROM facts GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return pages.duplicates(facts(spark, d), "content_hash")


_DENSE = r"""tk AS (SELECT site, url, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']{3,}')) AS term FROM facts), tc AS (SELECT site, url, term, count(*) AS hits FROM tk GROUP BY 1, 2, 3),
dn AS (SELECT site, url, min((-hits, term)) AS m, sum(hits) AS tokens FROM tc GROUP BY 1, 2), dense AS (SELECT site, url, m[2] AS term, -m[1] AS hits, tokens, -m[1]::DOUBLE / tokens AS density FROM dn)"""


@query(f"{_F}, {_DENSE} SELECT * FROM dense")
def term_density(spark, d):
    return pages.term_density(facts(spark, d))


# rules and scores

_IDS = {r.id: f"{r.id}|{r.severity}|{r.category}" for r in audit.PAGE_RULES} | {"noindex-blocked-by-robots": "noindex-blocked-by-robots|high|indexing"}
_HAS_VIEWPORT, _AT_LEAST = "(k % 2 = 0 OR k % 10 = 1)", "words >= {}"
_FIRST_P = r"len(string_split(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), ' '))"
_LD, _DESC = "k % 7 < 5", "k % 3 = 0"
#: Rules on one page in SQL: on all pages, on html pages that were fetched, on those that may be indexed.
_ROW_HIT = {
    "true": {
        "server-error": "error IS NULL AND status >= 500", "broken-internal-links": "error IS NULL AND status = 404", "forbidden-pages": "error IS NULL AND status = 403", "unreachable-pages": "error IS NOT NULL",
        "redirect-chain": "k % 43 = 1", "temporary-redirect": "k % 43 = 0", "crawl-budget-waste": "redirected OR (good AND is_noindex) OR status >= 400",
    },
    "good": {
        "noindex-blocked-by-robots": "is_noindex AND length(site) % 4 = 3 AND (starts_with(path, '/fr/') OR starts_with(path, '/en/1') OR starts_with(path, '/de/'))",
        "missing-rtl-direction": "regexp_matches(substr(text, 1, 2000), '[؀-ۿ]') AND NOT regexp_matches(lower(substr(html, 1, 3000)), 'dir=[\"'']rtl[\"'']') AND NOT contains(replace(lower(substr(html, 1, 3000)), ' ', ''), 'direction:rtl')",
        "mixed-content": "https AND (k % 9 = 2 OR (url LIKE 'http://%' AND (k % 4 = 0 OR k % 5 = 3 OR k % 13 = 0)))", "viewport-missing": f"NOT {_HAS_VIEWPORT}", "viewport-invalid": "k % 2 = 1 AND k % 10 = 1", "html-lang-missing": "lang = ''", "charset-missing": "charset = ''",
        "no-compression": "k % 2 = 1 AND strlen(html) > 50000", "noindex-pages": "is_noindex", "site-wide-noindex": "is_noindex", "jsonld-invalid": "k % 7 = 4", "empty-anchor-text": "k % 6 = 5", "js-navigation": "k % 23 = 0",
        "unsafe-target-blank": "k % 5 = 2", "image-alt-missing": "k % 6 = 0", "image-alt-too-long": "k % 6 = 1", "image-no-dimensions": "k % 6 = 0", "lcp-image-lazy": "k % 6 = 1", "no-lazy-loading": "k % 6 = 3", "legacy-image-format": "k % 6 = 2",
        "image-filename": "k % 6 = 1", "heavy-html": "strlen(html) > 500000", "slow-response": "elapsed > 800", "too-many-scripts": "k % 17 = 0", "large-inline-script": "k % 19 = 0", "render-blocking-resources": "k % 17 = 1",
        "hreflang-invalid-code": "k % 13 = 1", "hreflang-no-self": "k % 13 = 1", "hreflang-no-x-default": "k % 13 = 1", "client-side-rendered": "words < 50 AND k % 17 < 2 AND strlen(html) > 2000",
        "soft-404": f"words <= 250 AND regexp_matches(title || ' ' || array_to_string(list_transform(list_filter(heads, lambda h: h[1] = 1), lambda h: h[2]), ' '), '{audit.SOFT_404}')",
    },
    "idx": {
        "title-missing": "title = ''", "title-too-short": "title <> '' AND length(title) < 25", "title-too-long": "length(title) > 60", "meta-description-missing": f"NOT ({_DESC})", "meta-description-short": "k % 9 = 0", "meta-description-long": "k % 9 = 3",
        "canonical-missing": "NOT (k % 4 = 0 OR k % 8 = 1 OR k % 8 = 3)", "canonical-external": "k % 8 = 1", "og-missing": "k % 5 > 1", "og-image-missing": "k % 5 = 0",
        "h1-missing": "h1 = 0", "h1-multiple": "h1 > 1", "h1-empty": "h1 = 1 AND length(trim(list_filter(heads, lambda h: h[1] = 1)[1][2])) < 3",
        "heading-order": "len(list_filter(range(1, len(heads)), lambda i: heads[i + 1][1] - heads[i][1] > 1)) > 0", "no-subheadings": "words > 600 AND h2 = 0", "thin-content": "words < 300", "shallow-content": "words >= 300 AND words < 600",
        "no-publish-date": "words >= 400 AND NOT regexp_matches(lower(html), '<time|article:published_time|datepublished|datemodified')", "structured-data-partial": f"NOT ({_LD})", "no-structured-data": f"NOT ({_LD})",
        "orphan-pages": "inlinks = 0 AND url <> start_url", "weak-internal-linking": "inlinks = 1 AND url <> start_url", "deep-pages": "k % 6 >= 4", "no-author-byline": "words >= 500 AND NOT regexp_matches(html, '{author}')",
        "no-external-citations": "words >= 700 AND NOT (k % 5 = 2 OR k % 9 = 2)", "no-question-headings": "words >= 400 AND k % 4 = 3", "buried-answer": f"words >= 400 AND {_FIRST_P} > 120", "no-lists-or-tables": "words >= 400 AND NOT regexp_matches(html, '(?i)<(ul|ol|table)\\b')",
        "url-too-long": "length(url) > 115", "url-underscores": "contains(path, '_')", "url-uppercase": r"regexp_matches(path, '\p{Lu}')", "url-parameters": "query <> '' AND len(string_split(query, '&')) >= 3",
    },
}
_ROW_HIT["idx"]["no-author-byline"] = _ROW_HIT["idx"]["no-author-byline"].replace("{author}", audit.AUTHOR.replace("'", "''"))
#: Where a rule depends on a site's share of hits: when it counts.
_EMITTED = {
    "noindex-pages": "n < html", "site-wide-noindex": "n = html", "crawl-budget-waste": "pages >= 10 AND n > 0.25 * pages", "no-structured-data": "n = idx", "structured-data-partial": "n < idx AND n > 0.5 * idx", "orphan-pages": "idx >= 3",
    "weak-internal-linking": "idx >= 3 AND n > 0.3 * idx", "unsafe-target-blank": "n > 2", "no-author-byline": "w500 >= 2 AND n >= greatest(2, 0.5 * w500)", "no-external-citations": "w700 >= 2 AND n >= greatest(2, 0.6 * w700)",
    "hreflang-no-x-default": "n = hreflang", "no-lists-or-tables": "n > 0.6 * w400",
}
_CASES = ", ".join(f"CASE WHEN {rows} AND ({p}) THEN '{_IDS[i]}' END" for rows, rules in _ROW_HIT.items() for i, p in rules.items())
_NORMAL = f"lower(regexp_extract(url, '^([^:/?#]+)', 1)) || '://' || regexp_replace(lower(site), CASE WHEN lower(url) LIKE 'http:%' THEN ':80$' ELSE ':443$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END"
_LINK_TEXT = r"trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_GENERIC = ", ".join(f"'{x}'" for x in GENERIC_ANCHORS)
_DUPLICATE = "UNION ALL SELECT site, url, '{0}' FROM (SELECT *, count(*) OVER (PARTITION BY site, {1}) AS n FROM rows1 WHERE idx AND {2}) WHERE n > 1"
_SITE_HIT = "UNION ALL SELECT site, NULL, '{0}' FROM {1} WHERE {2}"
_SITE_RULES = "\n".join(_SITE_HIT.format(*x) for x in (
    ("no-https|critical|technical", "starts_", "NOT https"), ("no-hsts|low|technical", "starts_", "https AND first_k % 2 = 1"), ("no-cache-headers|low|performance", "starts_", "first_k % 2 = 1"),
    ("robots-missing|low|indexing", "starts_", "length(site) % 4 = 0"), ("robots-blocks-site|critical|indexing", "starts_", "length(site) % 4 = 1"), ("robots-no-sitemap|low|indexing", "starts_", "length(site) % 4 = 1"),
    ("robots-blocks-assets|high|indexing", "starts_", "length(site) % 4 = 3"), ("ai-crawlers-blocked|info|ai_search", "starts_", "length(site) % 4 = 2"), ("ai-crawler-policy-undefined|info|ai_search", "starts_", "length(site) % 4 IN (1, 3)"),
    ("no-llms-txt|info|ai_search", "starts_", "length(site) % 3 <> 0"), ("no-security-txt|info|eeat", "starts_", "length(site) % 5 <> 0"),
    *((f"missing-{k}-page|{s}|eeat", "trust", f"NOT {k}") for k, (s, _) in audit.TRUST.items()), ("no-social-profiles|low|eeat", "trust", "NOT social"),
    ("generic-anchor-text|medium|links", "trust", "generic > 0.1"),
    ("no-organization-schema|medium|eeat", "trust", "typed"), ("no-breadcrumb-schema|low|structured_data", "trust", "typed AND n_idx > 3"),
    ("sitemap-missing|medium|indexing", "maps", "locs = 0"), ("sitemap-mismatch|medium|indexing", "maps", "locs > 0 AND length(site) % 7 = 1"),
))
_MAPPED = "url IN (SELECT url FROM maps_ WHERE maps_.site = rows1.site)"
_HITS = rf"""{b.CRAWL_FLAGS},
starts_ AS (SELECT site, arg_min(url, (k, url)) AS start_url, min(k) AS first_k, lower(arg_min(url, (k, url))) LIKE 'https://%' AS https FROM f3 GROUP BY 1),
rows_ AS (SELECT f3.*, start_url, https, len(list_filter(heads, lambda h: h[1] = 1)) AS h1, len(list_filter(heads, lambda h: h[1] = 2)) AS h2, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM f3 JOIN starts_ USING (site)),
rows0 AS (SELECT *, {_NORMAL} AS u_ FROM rows_),
ins AS (SELECT site, u_, count(*) FILTER (k % 5 = 3) AS inlinks FROM rows0 GROUP BY 1, 2), rows1 AS (SELECT rows0.*, inlinks FROM rows0 JOIN ins USING (site, u_)),
counts AS (SELECT site, count(*) AS pages, count(*) FILTER (good) AS html, count(*) FILTER (idx) AS idx, count(*) FILTER (good AND k % 13 < 2) AS hreflang, count(*) FILTER (idx AND words >= 400) AS w400, count(*) FILTER (idx AND words >= 500) AS w500, count(*) FILTER (idx AND words >= 700) AS w700 FROM rows1 GROUP BY 1),
page_hits AS (SELECT site, url, unnest(list_filter([{_CASES}], lambda x: x IS NOT NULL)) AS key FROM rows1),
shares AS (SELECT site, string_split(key, '|')[1] AS i, count(*) AS n FROM page_hits GROUP BY 1, 2), failed AS (SELECT site, i FROM shares JOIN counts USING (site) WHERE {" OR ".join(f"(i = '{i}' AND NOT ({e}))" for i, e in _EMITTED.items())}),
links_ AS (SELECT site, url, good, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>')) AS tag FROM rows1),
links1 AS (SELECT *, regexp_extract(tag, 'href="([^"]*)"', 1) AS raw FROM links_ WHERE good), links2 AS (SELECT *, raw NOT LIKE 'https://x.com%' AND raw NOT LIKE 'http://old.example%' AS internal, {_LINK_TEXT} AS anchor FROM links1 WHERE raw <> '#'),
seen_ AS (SELECT site, url AS t FROM rows1 UNION ALL SELECT site, CASE WHEN raw LIKE '/%' THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || trim(raw) ELSE raw END || ' ' || anchor FROM links2 WHERE internal),
trust_ AS (SELECT site, {", ".join(f"bool_or(regexp_matches(t, '{p}')) AS {k}" for k, (_, p) in audit.TRUST.items())} FROM seen_ GROUP BY 1),
trust AS (SELECT t.*, social, generic, typed, n_idx FROM trust_ t JOIN (SELECT site, bool_or(k % 5 = 2) FILTER (good) AS social, bool_or(k % 7 < 3) FILTER (good) AS typed, count(*) FILTER (idx) AS n_idx FROM rows1 GROUP BY 1 HAVING count(*) FILTER (good) > 0) s USING (site)
 LEFT JOIN (SELECT site, avg(CASE WHEN lower(anchor) IN ({_GENERIC}) THEN 1.0 ELSE 0.0 END) AS generic FROM links2 WHERE internal GROUP BY 1) g USING (site)),
maps_ AS (SELECT DISTINCT site, CASE WHEN length(site) % 7 = 1 THEN u_ || '-gone' ELSE u_ END AS url FROM rows1 WHERE length(site) % 7 <> 0 AND k % 3 = 0), maps AS (SELECT s.site, count(m.url) AS locs FROM starts_ s LEFT JOIN maps_ m USING (site) GROUP BY 1),
absent AS (SELECT r.site, r.url FROM rows1 r JOIN maps m ON m.site = r.site AND m.locs > 0 WHERE r.idx AND NOT EXISTS (SELECT 1 FROM maps_ x WHERE x.site = r.site AND x.url = r.u_)),
many AS (SELECT site FROM absent JOIN counts USING (site) GROUP BY site, idx HAVING count(*) > greatest(2, 0.2 * idx)),
tk AS (SELECT site, url, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']{{3,}}')) AS term FROM rows1 WHERE idx AND words >= 150), tc AS (SELECT site, url, term, count(*) AS hits FROM tk GROUP BY 1, 2, 3), dn AS (SELECT site, url, min((-hits, term)) AS m, sum(hits) AS tokens FROM tc GROUP BY 1, 2),
to_hidden AS (SELECT site, url FROM rows1 WHERE idx AND k % 8 = 3 AND length(site) % 3 = 0 AND site IN (SELECT site FROM rows1 WHERE good AND k % 22 = 11)),
hits0 AS (SELECT site, url, key FROM page_hits WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.site = page_hits.site AND f.i = string_split(key, '|')[1])
 {_DUPLICATE.format("title-duplicate|high|content", "lower(title)", "title <> ''")} {_DUPLICATE.format("meta-description-duplicate|low|content", "k % 9", _DESC)} {_DUPLICATE.format("duplicate-content|high|indexing", "content_hash", "words >= 100")}
 UNION ALL SELECT site, url, 'keyword-stuffing|high|content' FROM dn WHERE tokens >= 80 AND -m[1]::DOUBLE / tokens > 0.06 AND -m[1] >= 15 AND regexp_matches(m[2], '\p{{L}}')
 UNION ALL SELECT site, url, 'canonical-mismatch|medium|indexing' FROM rows1 WHERE idx AND k % 8 = 3 AND site NOT IN (SELECT site FROM to_hidden) UNION ALL SELECT site, url, 'canonical-to-noindex|high|indexing' FROM to_hidden
 UNION ALL SELECT DISTINCT site, url, 'hreflang-not-reciprocal|high|international' FROM rows1 WHERE good AND k % 13 = 0 AND site IN (SELECT site FROM rows1 WHERE good AND k % 26 = 14)
 UNION ALL SELECT DISTINCT site, url, 'schema-missing-required|medium|structured_data' FROM rows1 WHERE good AND k % 7 = 1 UNION ALL SELECT DISTINCT site, url, 'schema-deprecated-type|info|structured_data' FROM rows1 WHERE good AND k % 7 = 2 UNION ALL SELECT DISTINCT site, url, 'schema-no-type|medium|structured_data' FROM rows1 WHERE good AND k % 7 = 3
 UNION ALL SELECT site, 'https://' || site || '/sitemap-2.xml', 'sitemap-invalid|medium|indexing' FROM maps WHERE locs > 0 AND length(site) % 2 = 0
 UNION ALL SELECT site, url, 'sitemap-bad-entries|medium|indexing' FROM rows1 WHERE EXISTS (SELECT 1 FROM maps_ x WHERE x.site = rows1.site AND x.url = rows1.u_) AND (error IS NOT NULL OR status >= 400 OR redirected OR is_noindex)
 UNION ALL SELECT site, url, 'sitemap-incomplete|low|indexing' FROM absent WHERE site IN (SELECT site FROM many)
 UNION ALL SELECT DISTINCT site, raw, 'broken-external-links|medium|links' FROM links2 WHERE NOT internal AND (raw LIKE 'http://old.example%' OR length(site) % 2 = 0)
 UNION ALL SELECT site, start_url, v.key FROM starts_ JOIN (VALUES {", ".join(f"({k}, '{i}|{sev}|performance')" for k, i, sev in b.VITALS_FOUND)}) v(m, key) ON length(site) % 3 = v.m
 {_SITE_RULES}),
hits AS (SELECT site, string_split(key, '|')[1] AS issue_id, string_split(key, '|')[2] AS severity, string_split(key, '|')[3] AS category, url FROM hits0),
issues AS (SELECT site, issue_id, severity, category, count(*) AS affected FROM hits GROUP BY ALL),
sev AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {w}, {o})" for k, (w, o) in audit.SEVERITY.items())}) s(severity, weight, o)),
pen AS (SELECT i.*, CASE WHEN weight = 0 THEN 0.0::DOUBLE ELSE weight * (0.55::DOUBLE + 0.45::DOUBLE * sqrt(least(1.0::DOUBLE, greatest(1, affected)::DOUBLE / greatest(1, html)))) END AS penalty, o FROM issues i JOIN sev USING (severity) JOIN counts c USING (site)),
cats AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({w} AS DECIMAL(4,1)))" for k, w in audit.CATEGORY_WEIGHT.items())}) c(category, weight)),
shown AS (SELECT site, bool_or(good AND (k % 6 < 4)) AS images, bool_or(good AND k % 13 < 2) AS foreign_ FROM rows1 GROUP BY 1),
act AS (SELECT s.site, category, weight FROM shown s, cats WHERE category NOT IN ('images', 'international') OR (category = 'images' AND images) OR (category = 'international' AND (foreign_ OR s.site IN (SELECT site FROM issues WHERE category = 'international')))),
sc AS (SELECT a.site, a.category, a.weight, greatest(0, least(100, CAST(round_even(round(100 - coalesce(sum(penalty), 0), 9), 0) AS INTEGER))) AS score, count(p.issue_id) FILTER (p.severity <> 'info') AS issues FROM act a LEFT JOIN pen p ON a.site = p.site AND a.category = p.category GROUP BY 1, 2, 3)"""
_H = f"WITH {b.CRAWL}, {_FACTS.replace('FROM pages)', 'FROM crawled)', 1)}, {_HITS}"
_CR = f"WITH {b.CRAWL}, {_FACTS.replace('FROM pages)', 'FROM crawled)', 1)}, {b.CRAWL_FLAGS}"
_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@query(f"""{_CR} SELECT page_id, site, coalesce(title, '') AS title, nullif(lang, '') AS lang, nullif(charset, '') AS charset,
 CASE WHEN k % 9 = 0 THEN 'Short text.' WHEN k % 9 = 3 THEN repeat('long ', 40) || 'end' WHEN k % 3 = 0 THEN 'All about the things that are sold on this very page, with prices, sizes and colours of each of them.' END AS meta_description,
 CASE WHEN k % 11 = 0 THEN 'noindex, follow' ELSE '' END AS meta_robots, CASE WHEN k % 2 = 0 THEN 'width=device-width, initial-scale=1' WHEN k % 10 = 1 THEN 'width=600' END AS viewport,
 CASE WHEN k % 4 = 0 THEN url WHEN k % 8 = 1 THEN 'https://other.invalid/x' WHEN k % 8 = 3 THEN {_ORIGIN} || CASE WHEN length(site) % 3 = 0 THEN '/hidden' ELSE '/elsewhere/1' END END AS canonical,
 CASE WHEN k % 5 = 0 THEN 'og:title=t' WHEN k % 5 = 1 THEN 'og:image=/i.png og:title=t' ELSE '' END AS og, CASE WHEN k % 13 = 0 THEN 'en=' || url || ' x-default=' || url || ' de=' || {_ORIGIN} || '/alt' WHEN k % 13 = 1 THEN 'english_1=' || {_ORIGIN} || '/x' ELSE '' END AS alternates FROM f3""")
def page_head_facts(spark, d):
    """Facts of the heads of the crawl's pages."""
    found = pages.page_facts(pages.with_defaults(b.crawl(spark, d)))
    pairs = lambda rows, k, v: F.array_join(F.transform(rows, lambda x: F.concat_ws("=", x[k], x[v])), " ")
    return found.select("page_id", "site", F.coalesce("title", F.lit("")).alias("title"), "lang", "charset", "meta_description", "meta_robots", "viewport", "canonical", pairs(F.array_sort(F.map_entries("og")), "key", "value").alias("og"), pairs(F.col("hreflang"), "code", "href").alias("alternates"))


@query(f"{_CR} SELECT page_id, is_html, error IS NULL AND status = 200 AS is_ok, is_noindex, idx AS is_indexable FROM f3")
def page_class_flags(spark, d):
    """Of the crawl, whose pages answer with errors, other types and noindex by their number."""
    return pages.with_flags(pages.page_facts(pages.with_defaults(b.crawl(spark, d)))).select("page_id", "is_html", "is_ok", "is_noindex", "is_indexable")


_RULES = ("pages", "duplicates", "stuffing", "canonical", "reciprocity", "anchors", "trust", "structured", "sites", "sitemaps", "robots_conflicts", "external", "vitals")


def _ready(spark, d):
    """Facts of the crawl written once: every rule reads them."""
    shared_folder(spark)
    return audit.ready(pages.with_flags(pages.page_facts(pages.with_defaults(b.crawl(spark, d)))).checkpoint()).checkpoint()


def _external(ready):
    """External links of html pages, each with the first page that has it, as many as are probed."""
    return tables.external_sample(pages.page_links(ready.filter("is_html and is_ok"), "crawl_seq").withColumnRenamed("crawl_seq", "seq"))


def _audited(spark, d):
    """Hits of all rules on pages, robots files and sitemaps."""
    ready = _ready(spark, d)
    starts = pages.site_origin(ready)
    frames = {"pages": ready, "sites": b.site_files(starts), "sitemap": b.sitemaps(ready), "vitals": b.vitals(starts), "probes": b.probes(_external(ready))}
    hits, notes = audit.run_all(frames, _RULES)
    if notes:
        raise ValueError("; ".join(notes))
    return ready, hits


def _issues(spark, d):
    ready, hits = _audited(spark, d)
    return ready, audit.roll_up(hits).checkpoint()


@query(f"{_H} SELECT * FROM hits")
def issue_union(spark, d):
    return _audited(spark, d)[1]


@query(f"{_H}, u AS (SELECT site, issue_id, list_sort(list(url) FILTER (url IS NOT NULL)) AS urls FROM hits GROUP BY 1, 2) SELECT i.*, coalesce(array_to_string(urls[1:50], ' '), '') AS urls FROM issues i JOIN u USING (site, issue_id)")
def issue_rollup(spark, d):
    return _issues(spark, d)[1].withColumn("urls", F.array_join("urls", " "))


@query(f"{_H} SELECT site, issue_id, round(penalty, 6) AS penalty FROM pen")
def issue_penalty(spark, d):
    ready, issues = _issues(spark, d)
    return audit.penalties(issues, audit.site_counts(ready)).select("site", "issue_id", F.round("penalty", 6).alias("penalty"))


_GRADE = "CASE " + " ".join(f"WHEN score >= {n} THEN '{g}'" for n, g in audit.GRADES) + f" ELSE '{audit.LOWEST_GRADE}' END"


@query(f"{_H} SELECT site, category, score, issues, {_GRADE} AS grade FROM sc")
def category_score(spark, d):
    return audit.category_scores(*_issues(spark, d))


@query(f"{_H} SELECT site, category FROM act")
def active_category(spark, d):
    return audit.active_categories(*_issues(spark, d))


@query(f"{_H}, o AS (SELECT site, CAST(round_even(round(CAST(sum(score * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 9), 0) AS INTEGER) AS s FROM sc GROUP BY 1) SELECT site, CASE WHEN site IN (SELECT site FROM issues WHERE severity = 'critical') THEN least(s, 45) ELSE s END AS overall_score FROM o")
def overall_score(spark, d):
    ready, issues = _issues(spark, d)
    return audit.overall_scores(audit.category_scores(ready, issues), issues)


@query(f"{_H} SELECT site, issue_id, affected, row_number() OVER (PARTITION BY site ORDER BY o, affected DESC, issue_id) AS place FROM pen")
def issue_order(spark, d):
    return audit.order_issues(_issues(spark, d)[1]).select("site", "issue_id", "affected", "place")


_QUICK = ", ".join(f"'{x}'" for x in audit.QUICK)


@query(f"{_H} SELECT * FROM (SELECT site, issue_id, row_number() OVER (PARTITION BY site ORDER BY o, affected DESC, issue_id) AS place FROM pen WHERE issue_id IN ({_QUICK}) OR severity IN ('critical', 'high')) WHERE place <= 8")
def quick_wins(spark, d):
    return audit.quick_wins(_issues(spark, d)[1]).select("site", "issue_id", "place")


@query(f"{_H} SELECT site, {', '.join(f'count(*) FILTER (severity = {chr(39)}{s}{chr(39)}) AS {s}' for s in audit.SEVERITY)} FROM issues GROUP BY 1")
def by_severity(spark, d):
    return audit.by_severity(_issues(spark, d)[1])


@query(f"{_H} SELECT site, {', '.join(f'count(*) FILTER (category = {chr(39)}{c}{chr(39)}) AS {c}' for c in audit.CATEGORY_WEIGHT)} FROM issues GROUP BY 1")
def by_category(spark, d):
    return audit.by_category(_issues(spark, d)[1])


@query(f"{_H} SELECT f.site, count(*) AS pages_crawled, count(*) FILTER (good) AS html_pages, count(*) FILTER (idx) AS indexable_pages, count(*) FILTER (error IS NOT NULL OR status >= 400) AS errors, count(*) FILTER (redirected) AS redirects, CAST(trunc(coalesce(avg(words) FILTER (idx), 0)) AS INTEGER) AS avg_words, CAST(trunc(avg(elapsed)) AS INTEGER) AS avg_load_ms, max(t) AS total_issues, max(c) AS critical_count, max(h) AS high_count FROM rows1 f JOIN (SELECT site, count(*) AS t, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM issues GROUP BY 1) USING (site) GROUP BY 1")
def site_stats(spark, d):
    return audit.site_stats(*_issues(spark, d))


@query(f"{_H} SELECT * FROM issues")
def all_rules(spark, d):
    """Issues of every rule, over all pages of the crawl."""
    return _issues(spark, d)[1].drop("urls")


@query(rf"""{_F}, idx AS (SELECT site, url, lower(title) AS t, lower(array_to_string(list_transform(list_filter(heads, lambda h: h[1] = 1), lambda h: h[2]), chr(10))) AS h, lower(text) AS b FROM facts),
{b.PHRASES}, kw AS (SELECT keyword AS k FROM phrases), g AS (SELECT site, k, count(*) FILTER (contains(b, k)) AS body, count(*) FILTER (contains(t, k)) AS title, count(*) FILTER (contains(h, k)) AS h1 FROM idx, kw GROUP BY 1, 2)
SELECT site, k AS keyword, 'absent' AS p FROM g WHERE body = 0 UNION ALL SELECT site, k, 'weak' FROM g WHERE body > 0 AND title = 0 AND h1 = 0 UNION ALL SELECT site, k, 'cannibal' FROM g WHERE title > 1""")
def cross_join_keywords(spark, d):
    """Every benchmark item's words, pairs of words, and whole text as keywords of every site."""
    shared_folder(spark)
    return audit.keyword_usage(pages.with_flags(facts(spark, d)).checkpoint(), b.phrases(spark, d), every_site=True).select("site", "keyword", "p")


# scalar expressions over page urls and documents

_PART = "regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)([?]([^#]*))?(#(.*))?', {})"


def _url(spark, d):
    return b.read(spark, d, "pages").select("page_id", "url")


@query(f"SELECT page_id, {_PART.format(2)} AS scheme, {_PART.format(4)} AS host, {_PART.format(5)} AS path, {_PART.format(7)} AS query, {_PART.format(9)} AS fragment FROM pages")
def url_parts(spark, d):
    return _url(spark, d).select("page_id", u.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


_Q = f"CASE WHEN {_PART.format(7)} <> '' THEN '?' || {_PART.format(7)} ELSE '' END"


@query(f"SELECT page_id, lower({_PART.format(2)}) || '://' || CASE WHEN lower({_PART.format(2)}) = 'http' THEN regexp_replace(lower({_PART.format(4)}), ':80$', '') ELSE regexp_replace(lower({_PART.format(4)}), ':443$', '') END || CASE WHEN {_PART.format(5)} = '' THEN '/' ELSE {_PART.format(5)} END || {_Q} AS normal FROM pages")
def normalize_url(spark, d):
    return _url(spark, d).select("page_id", u.normalize_url(F.col("url")).alias("normal"))


@query(f"SELECT page_id, lower({_PART.format(2)}) || '://' || lower({_PART.format(4)}) || CASE WHEN {_PART.format(5)} IN ('', '/') THEN '/' ELSE regexp_replace({_PART.format(5)}, '/$', '') END || {_Q} AS node FROM pages")
def normalise_node(spark, d):
    return _url(spark, d).select("page_id", u.normalise_node(F.col("url")).alias("node"))


@query(f"WITH k AS (SELECT page_id, url, array_to_string(list_filter(string_split({_PART.format(7)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:utm_[a-z]+|gclid|fbclid|msclkid|yclid|mc_[a-z]+|ref|source)(=|$)')), '&') AS q FROM pages) SELECT page_id, CASE WHEN {_PART.format(7)} = '' THEN url ELSE {_PART.format(1)} || {_PART.format(3)} || {_PART.format(5)} || CASE WHEN q <> '' THEN '?' || q ELSE '' END || {_PART.format(8)} END AS kept FROM k")
def strip_tracking_params(spark, d):
    return _url(spark, d).select("page_id", u.strip_tracking(F.col("url")).alias("kept"))


@query(f"SELECT page_id, regexp_replace(lower({_PART.format(4)}), '^www[.]', '') AS domain, {_PART.format(2)} || '://' || {_PART.format(4)} AS origin FROM pages")
def domain_of(spark, d):
    return _url(spark, d).select("page_id", u.domain_of(F.col("url")).alias("domain"), u.origin_of(F.col("url")).alias("origin"))


@query(f"WITH h AS (SELECT page_id, coalesce(url, '') AS url, lower({_PART.format(4)}) AS host FROM pages) SELECT page_id, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') WHEN url <> '' THEN url ELSE 'unknown' END AS label FROM h")
def site_label(spark, d):
    return _url(spark, d).select("page_id", u.site_label(F.col("url")).alias("label"))


@query(f"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower({_PART.format(4)}), '^www[.]', ''), '^([^.:]*)', 1), '[-_]+', ' ', 'g') AS seed FROM pages")
def seed_from_domain(spark, d):
    return _url(spark, d).select("page_id", u.seed_of(F.col("url")).alias("seed"))


@query(f"SELECT doc_id, {_COUNT.format('text')} AS words, sha1(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')) AS content_hash FROM documents")
def page_word_count(spark, d):
    return b.read(spark, d, "documents").select("doc_id", t.count_words(F.col("text")).alias("words"), t.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ') AS folded FROM documents")
def text_normalise(spark, d):
    return b.read(spark, d, "documents").select("doc_id", t.normalise(F.col("text")).alias("folded"))


@query()
def arrow_udf_text(spark, d):
    """Every document composed and folded; tests hold it against the standard library, SQL has neither."""
    return b.read(spark, d, "documents").select("doc_id", t.nfkc_casefold(F.col("text")).alias("folded"))


@query(r"""SELECT event_id, CASE user_id % 3 WHEN 0 THEN CASE WHEN date_trunc('day', ts) + INTERVAL 1 HOUR * (user_id % 24) > ts THEN date_trunc('day', ts) + INTERVAL 1 HOUR * (user_id % 24) ELSE date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL 1 HOUR * (user_id % 24) END
 WHEN 1 THEN (SELECT CASE WHEN w > ts THEN w ELSE w + INTERVAL 7 DAY END FROM (SELECT date_trunc('day', ts) + INTERVAL 1 DAY * CAST((user_id % 7 - (isodow(ts) - 1) + 7) % 7 AS INTEGER) + INTERVAL 1 HOUR * (user_id % 24) AS w))
 ELSE (SELECT CASE WHEN m > ts THEN m ELSE n END FROM (SELECT date_trunc('month', ts) + INTERVAL 1 DAY * CAST(least(user_id % 31 + 1, day(last_day(ts))) - 1 AS INTEGER) + INTERVAL 1 HOUR * (user_id % 24) AS m,
  date_trunc('month', ts) + INTERVAL 1 MONTH + INTERVAL 1 DAY * CAST(least(user_id % 31 + 1, day(last_day(date_trunc('month', ts) + INTERVAL 1 MONTH))) - 1 AS INTEGER) + INTERVAL 1 HOUR * (user_id % 24) AS n)) END AS next_run FROM events""")
def next_run_time(spark, d):
    who = F.col("user_id")
    cadence = F.when(who % 3 == 0, "daily").when(who % 3 == 1, "weekly").otherwise("monthly")
    run = schedules.next_run(F.col("ts"), cadence, (who % 24).cast("int"), (who % 7).cast("int"), (who % 31 + 1).cast("int"), F.lit("UTC"))
    return b.read(spark, d, "events").select("event_id", run.alias("next_run"))


@query("SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1")
def first_seen_dedup(spark, d):
    rows = b.read(spark, d, "events").groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return rows.select("event_type", "user_id", "event_id")
