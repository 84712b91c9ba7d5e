"""The logical tables of the operators, bound to the driver's tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesieve.functions.shared import once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("site"), key.cast("string").alias("url"), F.col("p_name").alias("title"), F.when(key % 25 == 0, 404).otherwise(200).alias("status"),
        (key % 10 != 0).alias("indexable"), (F.col("p_size") % 6).alias("depth"), (F.col("p_size") * 10).alias("words"),
    )


NODES = "nodes AS (SELECT p_brand AS site, CAST(p_partkey AS VARCHAR) AS url, p_name AS title, CASE WHEN p_partkey % 25 = 0 THEN 404 ELSE 200 END AS status, p_partkey % 10 <> 0 AS indexable, p_size % 6 AS depth, p_size * 10 AS words FROM part)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, on the site of the first one's brand; most lead to another site."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").withColumn("source", F.lag("l_partkey").over(order)).filter("source is not null and source <> l_partkey")
    brands = read(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_brand"))
    own = brands.toDF("source", "site")
    pairs = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).join(own, "source")
    return pairs.select("site", F.col("source").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"), F.col("p_brand").alias("anchor"), (F.col("l_returnflag") == "R").alias("nofollow"))


EDGES = """edges AS (SELECT s.p_brand AS site, CAST(src AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, t.p_brand AS anchor, l_returnflag = 'R' AS nofollow
 FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS src FROM lineitem) l
 JOIN part t ON l_partkey = t.p_partkey JOIN part s ON src = s.p_partkey WHERE src IS NOT NULL AND src <> l_partkey)"""


#: How the main element of a page is written, by the page's number: what opens it and what closes it.
MAINS = (
    ("<article>", "</article>"), ('<div id="content">', "</div>"), ("<div class='wide content'>", "</div>"), ("<section role=main>", "</section>"),
    ("<article><article>", "</article><p>More to read.</p></article>"), ("<div id=main><div>", "</div></div>"), ("<main>Few words.</main><DIV ID='content'>", "</DIV>"), ("<span>", "</span>"),
)


def _spelled(column: str, quote: str) -> str:
    """SQL that both engines read: ``column`` with the main element as the page's number has it."""
    text = lambda x: "'" + x.replace("'", quote) + "'"
    cases = " ".join(f"WHEN {k} THEN replace(replace({column}, '<article>', {text(a)}), '</article>', {text(b)})" for k, (a, b) in enumerate(MAINS))
    return f"CASE page_id % {len(MAINS)} {cases} END"


def spelled(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.expr(_spelled("html", "\\'")))


SPELLED = _spelled("html", "''")


#: Structured data by the page's number: what stands behind the head's and the body's tag, and the blocks that come of it (script, part, place, block, types).
STRUCTURED = (
    ('<script type="application/ld+json">{"@type":"Article","headline":"x"}</script>', "", ((0, "object", 0, '{"@type":"Article","headline":"x"}', "Article"),)),
    ("<script type='application/LD+JSON'> {broken </script>", '<div itemscope itemtype="https://schema.org/Product"><b itemtype=Offer></b></div>', ((0, "error", 0, "{broken", ""),)),
    ('<script type="application/ld+json">{"@context":"c","@id":"i","@graph":[{"@type":"Person","name":"y"},"text",{"@type":["Article","Thing"]}]}</script>', "", ((0, "item", 0, '{"@type":"Person","name":"y"}', "Person"), (0, "item", 2, '{"@type":["Article","Thing"]}', "Article Thing"), (0, "envelope", 0, '{"@context":"c","@id":"i"}', ""))),
    ('<script type="application/ld+json">{"@graph":[{"a":[1,{"b":null}]}],"@context":"c"}</script>', "", ((0, "item", 0, '{"a":[1,{"b":null}]}', ""),)),
    ('<script type="application/ld+json">[{"@type":"A"},3,{"c":"\u00e9"}]</script><link rel="alternate" hreflang="fr" href="/fr">', "", ((0, "item", 0, '{"@type":"A"}', "A"), (0, "item", 2, '{"c":"\u00e9"}', ""))),
    ('<script type="application/ld+json"> </script><script type="application/ld+json">{"@graph":"no list"}</script><script type="application/ld+json">7</script><link hreflang=de rel=alternate href=de><link rel=alternate hreflang=x-default href="https://other.example/">', "", ((0, "object", 0, '{"@graph":"no list"}', ""),)),
)


def _by_number(column: str) -> str:
    rows = " ".join(f"WHEN {k} THEN replace(replace({column}, '<head>', '<head>{head}'), '<body>', '<body>{body}')".replace("type='application/LD+JSON'", 'type="application/LD+JSON"') for k, (head, body, _) in enumerate(STRUCTURED))
    return f"CASE page_id % {len(STRUCTURED)} {rows} END"


def structured(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.expr(_by_number("html")))


STRUCTURED_ROWS = ", ".join(f"({m}, {n}, '{part}', {pos}, '{block}', '{types}')" for m, (_, _, found) in enumerate(STRUCTURED) for n, part, pos, block, types in found)


# A crawl: every page with the head, body and fetch facts that its number gives it, so that all kinds of rules have pages
# that they hold for and pages that they don't. Head and body are said once, in SQL that both engines read.
_HEAD = """concat(
 CASE k % 53 WHEN 0 THEN '<title></title>' WHEN 1 THEN concat('<title>', repeat('Long title ', 7), '</title>') WHEN 2 THEN '<title>Page not found</title>' ELSE '' END,
 CASE WHEN k % 3 = 0 THEN concat('<meta name="description" content="', CASE k % 9 WHEN 0 THEN 'Short text.' WHEN 3 THEN concat(repeat('long ', 40), 'end') ELSE 'All about the things that are sold on this very page, with prices, sizes and colours of each of them.' END, '">') ELSE '' END,
 CASE WHEN k % 2 = 0 THEN '<meta name="viewport" content="width=device-width, initial-scale=1">' WHEN k % 10 = 1 THEN '<meta name="viewport" content="width=600">' ELSE '' END,
 CASE WHEN k % 4 = 0 THEN concat('<link rel="canonical" href="', url, '">') WHEN k % 8 = 1 THEN '<link rel="canonical" href="https://other.invalid/x">' WHEN k % 8 = 3 AND length(site) % 3 = 0 THEN '<link rel="canonical" href="/hidden">' WHEN k % 8 = 3 THEN '<link rel="canonical" href="/elsewhere/1">' ELSE '' END,
 CASE WHEN k % 11 = 0 THEN '<meta name="robots" content="noindex, follow">' ELSE '' END,
 CASE WHEN k % 5 = 0 THEN '<meta property="og:title" content="t">' WHEN k % 5 = 1 THEN '<meta property="og:title" content="t"><meta property="og:image" content="/i.png">' ELSE '' END,
 CASE WHEN k % 13 = 0 THEN concat('<link rel="alternate" hreflang="en" href="', url, '"><link rel="alternate" hreflang="x-default" href="', url, '"><link rel="alternate" hreflang="de" href="/alt">') WHEN k % 13 = 1 THEN '<link rel="alternate" hreflang="english_1" href="/x">' ELSE '' END,
 CASE WHEN k % 7 < 5 THEN concat('<script type="application/ld+json">', CASE k % 7 WHEN 0 THEN '{"@type":"Article","headline":"x"}' WHEN 1 THEN '{"@type":"Article"}' WHEN 2 THEN '{"@type":"FAQPage"}' WHEN 3 THEN '{"name":"x"}' ELSE '{broken' END, '</script>') ELSE '' END,
 CASE WHEN k % 17 = 0 THEN repeat('<script async src="/s.js"></script>', 16) WHEN k % 17 = 1 THEN concat(repeat('<script src="/s.js"></script>', 2), repeat('<link rel="stylesheet" href="/s.css">', 2)) ELSE '' END,
 CASE WHEN k % 19 = 0 THEN concat('<script>', repeat('x', 100001), '</script>') ELSE '' END,
 CASE WHEN k % 97 = 0 THEN concat('<!--', repeat('x', 500001), '-->') ELSE '' END)"""
_BODY = """concat(CASE WHEN k % 61 = 1 THEN '<h1>Another heading</h1>' ELSE '' END, '<aside>',
 CASE k % 6 WHEN 0 THEN '<img src="/a.webp">' WHEN 1 THEN concat('<img src="/img1.jpg" alt="', repeat('a', 126), '" width="1" height="1" loading="lazy">') WHEN 2 THEN repeat('<img src="/p1.png" alt="a" width="1" height="1">', 3) WHEN 3 THEN repeat('<img src="/b.webp" alt="a" width="1" height="1">', 9) ELSE '' END,
 CASE WHEN k % 4 = 2 THEN '<h2>What is it?</h2>' WHEN k % 8 = 7 THEN '<h2>Prices</h2><h4>Old prices</h4>' WHEN k % 4 = 3 THEN '<h2>Prices</h2>' ELSE '' END,
 CASE WHEN k % 5 = 2 THEN '<a href="https://x.com/us" target="_blank">see us</a>' WHEN k % 5 = 3 THEN concat('<a href="', url, '">this page</a>') ELSE '' END,
 CASE WHEN k % 7 = 2 THEN '<a href="/about-us">click here</a>' ELSE '' END, CASE WHEN k % 6 = 5 THEN '<a href="/empty"></a>' ELSE '' END,
 CASE WHEN k % 9 = 2 THEN '<a href="http://old.example/p">old</a>' ELSE '' END, CASE WHEN k % 23 = 0 THEN '<a href="#" onclick="location.href=1">go</a>' ELSE '' END, '</aside>')"""
#: The markup itself in other ways: without a language or character set, with no or an empty heading, with the main element hidden, replaced by one
#: that many pages share, or with Arabic words; sites whose name has a length of 3 modulo 11 have no lists.
_MARKUP = (
    ("k % 59 = 0", "<html ", "<html data-"), ("k % 59 = 1", "<meta charset", "<meta data-charset"), ("k % 61 = 0", "<h1>", "<p>"), ("k % 61 = 2", "<h1>", "<h1></h1><p>"),
    ("length(site) % 11 = 3", "<ul>", "<div>"), ("length(site) % 11 = 3", "</ul>", "</div>"), ("k % 73 < 2", "<article>", "<article><p>سلام دنیا</p>"), ("k % 73 = 1", "<html ", '<html dir="rtl" '),
    ("k % 51 = 0", "<article>", "<template>"), ("k % 51 = 0", "</article>", "</template>"), ("k % 51 <> 0 AND k % 14 = 5", "<article>", "<main><p>" + "same words again " * 60 + "</p></main><section>"), ("k % 51 <> 0 AND k % 14 = 5", "</article>", "</section>"),
)
_SITE = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_ROOT = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
#: A noindex page that canonicals of some sites name, a page that alternates name and that names none back; urls with capitals and underscores,
#: with three parameters, and long ones.
_URL = f"""CASE WHEN k % 22 = 11 THEN concat({_ROOT}, '/hidden') WHEN k % 26 = 14 THEN concat({_ROOT}, '/alt') ELSE CASE k % 71 WHEN 0 THEN replace(url, {_SITE}, concat({_SITE}, '/Some_Path')) WHEN 1 THEN concat(split_part(url, '#', 1), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'a=1&b=2&c=3')
 WHEN 2 THEN replace(url, {_SITE}, concat({_SITE}, '/', repeat('long-', 25))) ELSE url END END"""


def _with_markup(html: str) -> str:
    for when, old, new in _MARKUP:
        html = f"CASE WHEN {when} THEN replace({html}, '{old}', '{new}') ELSE {html} END" if html == "html" else f"replace({html}, '{old}', CASE WHEN {when} THEN '{new}' ELSE '{old}' END)"
    return html


_STATUS, _ERROR = "CASE WHEN k % 29 = 0 THEN 500 WHEN k % 31 = 0 THEN 404 WHEN k % 37 = 0 THEN 403 ELSE 200 END", "CASE WHEN k % 41 = 0 THEN 'timeout' END"
#: What a site's robots.txt says, by the length of its name; none for the first.
ROBOTS = ("User-agent: *\nDisallow: /", "User-agent: GPTBot\nDisallow: /\n\nSitemap: x", "User-agent: *\nDisallow: /assets/\nDisallow: /fr/\nDisallow: /en/1\nDisallow: /de/\nSitemap: x")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").withColumn("k", F.col("page_id")).withColumn("url", F.expr(_URL)).withColumn("site", F.expr(_SITE))
    rows = once(rows, {"_h": F.expr(_HEAD), "_b": F.expr(_BODY), "html": F.expr(_with_markup("html"))})
    html = F.replace(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), "_h")), F.lit("<body>"), F.concat(F.lit("<body>"), "_b"))
    hop = lambda code: F.struct(F.lit(code).alias("code"), F.col("url"))
    chain = F.when(F.expr("k % 43 = 0"), F.array(hop(302))).when(F.expr("k % 43 = 1"), F.array(hop(301), hop(301))).otherwise(F.expr("cast(array() as array<struct<code:int,url:string>>)"))
    out = rows.select(
        "page_id", "url", html.alias("html"), F.expr(_STATUS).alias("status_code"), F.expr(_ERROR).alias("error"), chain.alias("redirect_chain"),
        F.expr("CASE WHEN k % 2 = 0 THEN map('Content-Encoding', 'gzip', 'Strict-Transport-Security', 'max-age=1', 'Cache-Control', 'max-age=60') ELSE map('Cache-Control', 'no-store') END").alias("headers"),
        F.expr("CASE WHEN k % 47 = 0 THEN 'application/pdf' ELSE 'text/html' END").alias("content_type"), F.expr("cast(k * 37 % 1000 AS INT)").alias("elapsed_ms"), F.expr("cast(k % 6 AS INT)").alias("depth"), F.col("k").alias("crawl_seq"),
    )
    return once(out, {c: F.col(c) for c in ("html",)})


#: What the crawl puts behind a body's tag, of the tables page_id and url.
BODY_BY_PAGE = _BODY.replace("k %", "page_id %")
CRAWL = f"""raw_ AS (SELECT page_id, page_id AS k, {_URL.replace("k %", "page_id %")} AS url, html FROM pages), raw1 AS (SELECT *, {_SITE} AS site FROM raw_), raw0 AS (SELECT page_id, k, url, site, {_with_markup("html")} AS html FROM raw1), crawled AS (SELECT page_id, k, url, replace(replace(html, '<head>', '<head>' || {_HEAD}), '<body>', '<body>' || {_BODY}) AS html FROM raw0)"""
#: Fetch facts and flags of the crawl, by the number of the page.
CRAWL_FLAGS = f"""f1 AS (SELECT *, {_STATUS} AS status, {_ERROR} AS error, k % 47 <> 0 AS is_html, k % 11 = 0 AS is_noindex, k % 43 < 2 AS redirected, k * 37 % 1000 AS elapsed FROM facts),
f2 AS (SELECT *, is_html AND error IS NULL AND status = 200 AS good FROM f1), f3 AS (SELECT *, good AND NOT is_noindex AS idx FROM f2)"""


def site_files(starts: DataFrame) -> DataFrame:
    """What was fetched beside the pages of each site (site, start_url), by the length of its name."""
    n = F.length("site")
    robots = F.coalesce(*(F.when(n % 4 == k + 1, text) for k, text in enumerate(ROBOTS)))
    return starts.withColumns({"robots_txt": robots, "llms_txt": n % 3 == 0, "security_txt": n % 5 == 0, "sitemap_errors": F.when(n % 2 == 0, F.array(F.concat(F.lit("https://"), "site", F.lit("/sitemap-2.xml")))).otherwise(F.array().cast("array<string>"))})


def sitemaps(pages: DataFrame) -> DataFrame:
    """Every third page of the sites that have a sitemap; where the name's length is 1 modulo 7 none of these was crawled."""
    loc = F.when(F.expr("length(site) % 7 = 1"), F.concat(F.expr("split_part(url, '#', 1)"), F.lit("-gone"))).otherwise(F.col("url"))
    return pages.filter("length(site) % 7 <> 0 and crawl_seq % 3 = 0").select("site", loc.alias("loc"))


#: Page-speed answers, by the length of a site's name modulo 3: metrics on both sides of their limits, none, and more opportunities than are shown.
VITALS = (
    '{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":4100},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":12},"INTERACTION_TO_NEXT_PAINT":{"percentile":200}}},'
    '"lighthouseResult":{"audits":{"unused-css":{"score":0.5,"details":{"overallSavingsMs":300}},"modern-images":{"score":0.9,"details":{"overallSavingsMs":900}},"redirects":{"details":{"overallSavingsMs":150}}}}}',
    '{"lighthouseResult":{"audits":{"redirects":{"score":0,"details":{"overallSavingsMs":700}}}}}',
    '{"loadingExperience":{"metrics":{"EXPERIMENTAL_TIME_TO_FIRST_BYTE":{"percentile":1801},"FIRST_CONTENTFUL_PAINT_MS":{"percentile":1800}}},'
    '"lighthouseResult":{"audits":{' + ",".join(f'"{k}":{{"score":0.1,"details":{{"overallSavingsMs":{n}}}}}' for k, n in zip("edcba", (160, 200, 300, 400, 149), strict=True)) + ',"f":{"score":0.89,"details":{"overallSavingsMs":161}}}}}',
)
#: What these give: site length modulo 3, finding, severity.
VITALS_FOUND = (
    (0, "cwv-lcp", "high"), (0, "cwv-cls", "medium"), (0, "psi-unused-css", "low"), (0, "psi-redirects", "low"), (2, "cwv-ttfb", "high"),
    *((2, f"psi-{k}", "low") for k in "bcdf"),
)


def vitals(starts: DataFrame) -> DataFrame:
    return starts.select("site", F.coalesce(*(F.when(F.length("site") % 3 == k, payload) for k, payload in enumerate(VITALS))).alias("payload"))


def probes(sample: DataFrame) -> DataFrame:
    """What external links (site, href, found_on) answered: nothing, or 404 for sites with a name of even length, else 200."""
    old = F.col("href").startswith("http://old.example")
    return sample.select("site", "href", "found_on", F.when(~old, F.when(F.length("site") % 2 == 0, 404).otherwise(200)).alias("status"), F.when(old, "timeout").alias("error"))

def words_of_text() -> str:
    return r"[\p{L}\p{N}_]+"


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the first line is the title, the second the description, the third a heading of level 1."""
    lines = F.split("text", "\n")
    line = lambda k: F.get(lines, F.lit(k))
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("site"), F.concat(F.lit("https://"), "source", F.lit(".example/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.trim(line(0)).alias("title"), F.trim(F.coalesce(line(1), F.lit(""))).alias("description"),
        F.when(line(2).isNotNull(), F.array(F.struct(F.lit(1).alias("level"), line(2).alias("text")))).otherwise(F.array().cast("array<struct<level:int,text:string>>")).alias("headings"),
        F.size(F.regexp_extract_all("text", F.lit(words_of_text()), F.lit(0))).alias("words"), (F.col("doc_id") % 7 != 0).alias("indexable"), F.col("doc_id").alias("seq"), F.col("text"),
    )


PAGE_ROWS = r"""page_rows AS (SELECT source AS site, 'https://' || source || '.example/doc/' || doc_id AS url, trim(split_part(text, chr(10), 1), ' ') AS title,
 trim(split_part(text, chr(10), 2), ' ') AS description, CASE WHEN len(string_split(text, chr(10))) > 2 THEN split_part(text, chr(10), 3) END AS h1,
 len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, doc_id % 7 <> 0 AS indexable, doc_id AS seq, text FROM documents)"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a site could be looked for by: the words of each benchmark item, its pairs of neighbouring words, and the whole of it."""
    rows = once(read(spark, sf_dir, "benchmark").select(F.lower(F.trim("text")).alias("t")), {"t": F.col("t"), "w": F.regexp_extract_all("t", F.lit(words_of_text()), F.lit(0))})
    pairs = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select(F.explode(F.concat(F.array("t"), "w", pairs)).alias("keyword")).filter("keyword <> ''").distinct()


PHRASES = r"""words_ AS (SELECT lower(trim(text, ' ')) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT keyword FROM (SELECT t AS keyword FROM words_ UNION ALL SELECT unnest(w) FROM words_ UNION ALL SELECT w[k] || ' ' || w[k + 1] FROM (SELECT w, unnest(range(1, len(w))) AS k FROM words_)) WHERE keyword <> '')"""


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring words of the benchmark items, with a demand and an intent made of its number."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(words_of_text()), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.concat_ws(" ", a, b))
    found = once(rows, {"w": F.col("w")}).select("item_id", F.posexplode(pairs).alias("k", "keyword"))
    return found.groupBy("keyword").agg(F.min(F.col("item_id") * 10_000 + F.col("k")).alias("seq")).select("keyword", (F.col("seq") * 37 % 101).cast("int").alias("demand"), F.when(F.col("seq") % 2 == 0, "informational").otherwise("commercial").alias("intent"), "seq")


KEYWORDS = r"""keywords AS (SELECT keyword, CAST(seq * 37 % 101 AS INTEGER) AS demand, CASE WHEN seq % 2 = 0 THEN 'informational' ELSE 'commercial' END AS intent, seq FROM
 (SELECT w[k] || ' ' || w[k + 1] AS keyword, min(item_id * 10000 + k - 1) AS seq FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)) GROUP BY 1))"""


#: Positions that the numbers of a document's suggestions leave room for.
DOC_SPAN = 10_000_000


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring words of a document, as if suggested by its source for its language's seed: position in twos."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).filter("size(w) >= 2")
    # the words are an attribute here, so that they are taken out of the text once and not once for each pair
    rows = once(rows, {"w": F.col("w")})
    pairs = F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat_ws(" ", a, b))
    found = rows.select(F.concat(F.lit("seed "), "lang").alias("seed"), F.posexplode(pairs).alias("position", "keyword"), "source", (F.col("doc_id") * DOC_SPAN).alias("_d"))
    return found.select("seed", "keyword", "source", F.floor(F.col("position") / 2).cast("int").alias("position"), (F.col("_d") + F.col("position")).alias("seq"))


SUGGESTIONS = rf"""suggestions AS (SELECT 'seed ' || lang AS seed, w[k] || ' ' || w[k + 1] AS keyword, source, CAST((k - 1) // 2 AS INTEGER) AS position, doc_id * {DOC_SPAN} + k - 1 AS seq FROM
 (SELECT *, unnest(range(1, len(w))) AS k FROM (SELECT *, regexp_extract_all(text, '\p{{L}}+') AS w FROM documents) WHERE len(w) >= 2))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten suppliers that sell most of a brand, as results for the brand's name."""
    sold = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    ranked = sold.withColumn("position", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("revenue"), "l_suppkey"))).filter("position <= 10")
    key = F.col("s_suppkey")
    domain = F.concat(F.when(key % 3 == 0, "blog.").otherwise(""), F.lit("shop"), (key % 7).cast("string"))
    return ranked.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("keyword"), "position", F.concat(F.lit("https://"), domain, F.lit(".example/")).alias("url"), F.concat(domain, F.lit(".example")).alias("domain"), F.col("s_name").alias("title"))


RESULTS = """results AS (SELECT p_brand AS keyword, position, 'https://' || d || '.example/' AS url, d || '.example' AS domain, s_name AS title FROM
 (SELECT p_brand, l_suppkey, row_number() OVER (PARTITION BY p_brand ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, l_suppkey) AS position FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey) r
 JOIN (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'blog.' ELSE '' END || 'shop' || s_suppkey % 7 AS d FROM supplier) s ON l_suppkey = s_suppkey WHERE position <= 10)"""


def target_domain(spark: SparkSession, sf_dir: str) -> str:
    """The site whose rank is looked for; some of its suppliers are on a host below it."""
    return "shop3.example"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a region and month as a run of the region's site."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    month = F.date_trunc("month", "o_orderdate")
    grouped = rows.groupBy("r_name", month.alias("created_at")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"), F.count_distinct("o_custkey").alias("c"),
    )
    score = F.col("c") * 100 % 101
    metrics = F.create_map(F.lit("overall_score"), score.cast("double"), F.lit("total_issues"), F.col("f").cast("double"), F.lit("keywords_found"), F.col("c").cast("double"), F.lit("orphan_pages"), F.col("u").cast("double"), F.lit("keyword_coverage"), F.when(F.col("n") % 3 != 0, (F.col("u") * 2).cast("double")))
    scores = F.create_map(F.lit("content"), (F.col("n") % 100).cast("int"), F.lit("links"), (F.col("f") % 100).cast("int"))
    return grouped.select(
        F.concat_ws("/", "r_name", F.date_format("created_at", "yyyy-MM")).alias("run_id"), F.col("r_name").alias("site"), F.lit("audit").alias("goal"), F.lit(None).cast("string").alias("tenant"),
        F.when(F.month("created_at") == 7, "failed").otherwise("completed").alias("status"), "created_at", F.col("n").cast("int").alias("pages_crawled"), metrics.alias("metrics"), scores.alias("category_scores"),
    )


RUNS = """runs AS (SELECT r_name || '/' || strftime(m, '%Y-%m') AS run_id, r_name AS site, CASE WHEN month(m) = 7 THEN 'failed' ELSE 'completed' END AS status, m AS created_at, CAST(n AS INTEGER) AS pages_crawled,
  CAST(c * 100 % 101 AS DOUBLE) AS overall_score, CAST(f AS DOUBLE) AS total_issues, CAST(c AS DOUBLE) AS keywords_found, CAST(u AS DOUBLE) AS orphan_pages, CASE WHEN n % 3 <> 0 THEN CAST(u * 2 AS DOUBLE) END AS keyword_coverage,
  CAST(n % 100 AS INTEGER) AS content, CAST(f % 100 AS INTEGER) AS links FROM
 (SELECT r_name, date_trunc('month', o_orderdate) AS m, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (starts_with(o_orderpriority, '1')) AS u, count(DISTINCT o_custkey) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2))"""
