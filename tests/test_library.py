"""The site operators on small tables with known outcomes, and streams against their batch twins."""

import datetime as dt
import json
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from sitesieve.functions import markup, selection
from sitesieve.functions import text as t
from sitesieve.functions import urls as u
from sitesieve.operators import audit, compare, coverage, graph, keywords, pages, rankings, schedules, trends
from sitesieve.plans import keyword_queries, page_queries, source_queries
from sitesieve.sources import tables
from sitesieve.streaming import batches, events


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "normal", "node"),
    [
        ("HTTP://Example.com:80/A/?b=1#x", "http://example.com/A/?b=1", "http://example.com:80/A?b=1"),
        ("https://example.com", "https://example.com/", "https://example.com/"),
        ("https://example.com:443/a/", "https://example.com/a/", "https://example.com:443/a"),
        ("https://example.com/?q", "https://example.com/?q", "https://example.com/?q"),
    ],
)
def test_two_url_normalisers(spark, raw, normal, node):
    assert one(spark, u.normalize_url(F.col("x")), x=raw) == normal
    assert one(spark, u.normalise_node(F.col("x")), x=raw) == node


@pytest.mark.parametrize(("href", "want"), [("b", "https://a.org/x/b"), ("../b?q#f", "https://a.org/b?q#f"), ("/b/./c/../d", "https://a.org/b/d"), ("//c.org/e", "https://c.org/e"), ("?n=1", "https://a.org/x/y?n=1"), ("#z", "https://a.org/x/y?k=1#z"), ("http://d.org", "http://d.org"), ("", "https://a.org/x/y?k=1")])
def test_resolve(spark, href, want):
    from urllib.parse import urljoin

    assert one(spark, u.resolve(F.lit("https://a.org/x/y?k=1"), F.col("h")), h=href) == want == urljoin("https://a.org/x/y?k=1", href)


def test_url_predicates(spark):
    inside = lambda a, b, s=False: one(spark, u.is_internal(F.col("a"), F.col("b"), s), a=a, b=b)
    assert inside("https://www.a.org/x", "https://a.org") and not inside("https://b.a.org", "https://a.org") and inside("https://b.a.org", "https://a.org", True) and not inside("https://nota.org", "https://a.org", True)
    assert one(spark, u.strip_tracking(F.col("x")), x="https://a.org/p?utm_source=1&id=2&ref=3&sourcey=4#f") == "https://a.org/p?id=2&sourcey=4#f"
    public = lambda x: one(spark, u.is_public_target(F.col("x")), x=x)
    assert public("https://a.org/x") and not any(map(public, ("ftp://a.org", "http://127.0.0.1/", "http://10.1.2.3:80/", "http://[::1]/", "http://169.254.169.254/latest", "http://x.internal/", "http://172.20.0.1", "nothing")))
    assert one(spark, u.is_crawlable(F.col("x")), x="https://a.org/a.PDF?x") is False


def test_text(spark):
    count = lambda x: one(spark, t.count_words(F.col("x")), x=x)
    assert [count(x) for x in ("one two-three it's", "سلام دنیا", "漢字 a", "", "été")] == [3, 2, 3, 0, 1]
    same = lambda a, b: one(spark, t.normalise(F.col("a"), True), a=a) == one(spark, t.normalise(F.col("b"), True), b=b)
    assert same("كتاب", "کتاب") and same("می‌روم", "می روم") and same("مسابقه،", "مسابقه") and same("ＡＢＣ", "abc")
    assert one(spark, t.words(F.col("x")), x="The best of the Shoes") == ["best", "shoes"]
    import uuid

    assert one(spark, t.uuid5(str(uuid.NAMESPACE_URL), F.col("x")), x="https://a.org/") == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a.org/"))
    assert one(spark, t.number(F.col("x")), x="n/a") == 0.0


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [("s", f"https://a.org/{p}", p, 200, True, 1, n) for p, n in (("", 900), ("blog", 800), ("about", 100), ("alone", 700))]
    edges = [("", "blog"), ("about", "blog"), ("blog", ""), ("", "blog"), ("", "about")]
    schema = "site string, url string, title string, status int, indexable boolean, depth int, words int"
    rows = [("s", f"https://a.org/{a}", f"https://a.org/{b}", "here" if b == "about" else "The blog", False) for a, b in edges]
    return spark.createDataFrame(nodes, schema), spark.createDataFrame(rows, "site string, source string, target string, anchor string, nofollow boolean")


def test_graph(small_graph):
    nodes, edges = small_graph
    rank = {r.url.rsplit("/", 1)[1]: r.authority for r in graph.authority(nodes, edges).collect()}
    assert max(rank.values()) == 100.0 and rank["about"] < rank["blog"] and rank["alone"] > 0
    assert {r.url[14:]: r.inlinks for r in graph.inlink_counts(edges).collect()} == {"": 1, "blog": 2, "about": 1}
    assert [r.url[14:] for r in graph.orphans(nodes, edges, F.lit("https://a.org/")).collect()] == ["alone"]
    assert sorted(r.url[14:] for r in graph.dead_ends(nodes, edges).collect()) == ["alone"]
    assert [r.url[14:] for r in graph.undescribed(nodes, edges, 1).collect()] == ["about"]
    assert graph.authority(nodes.limit(0), edges).count() == 0
    assert graph.authority(nodes, edges.limit(0)).filter("authority > 0").count() == 4


def test_order_statistics_without_ordering_a_site(spark):
    rng = random.Random(1)
    rows = [("big", rng.randrange(5000)) for _ in range(20_000)] + [("ties", 7)] * 500 + [("ties", 9)] * 501 + [("one", 3), ("none", None)] + [("two", 4), ("two", 5)]
    frame = spark.createDataFrame(rows, "site string, v int")
    for ordered in (50, 1_000_000):
        found = {r.site: r.v for r in selection.kth(frame, "v", F.floor(F.col("n") / 2), ordered=ordered).collect()}
        of = lambda s: sorted(v for x, v in rows if x == s and v is not None)
        assert found == {s: of(s)[len(of(s)) // 2] for s in ("big", "ties", "one", "two")}
    many = spark.range(2_000_000).select(F.lit("s").alias("site"), (F.col("id") * 7919 % 10_000_019).alias("v"))
    assert selection.kth(many, "v", F.floor(F.col("n") / 2)).first().v == sorted(k * 7919 % 10_000_019 for k in range(2_000_000))[1_000_000]


def test_pagerank_equals_a_plain_model(spark):
    import random

    rng = random.Random(4)
    urls = [f"u{k}" for k in range(30)]
    pairs = [(rng.choice(urls), rng.choice(urls + ["unknown"])) for _ in range(80)]
    pairs = [p for p in pairs if p[0] != p[1]]
    nodes = spark.createDataFrame([("s", x) for x in urls], "site string, url string")
    edges = spark.createDataFrame([("s", *p) for p in pairs], "site string, source string, target string")
    rank, out = dict.fromkeys(urls, 1 / 30), {x: [b for a, b in pairs if a == x and b in urls] for x in urls}
    for _ in range(40):
        leaked = sum(r for x, r in rank.items() if not out[x])
        rank = {x: 0.15 / 30 + 0.85 * leaked / 30 + 0.85 * sum(rank[a] * out[a].count(x) / len(out[a]) for a in urls if out[a]) for x in urls}
    top = max(rank.values())
    assert all(abs(r.authority - rank[r.url] / top * 100) < 0.051 for r in graph.authority(nodes, edges).collect())


def test_click_depth(small_graph, spark):
    _, edges = small_graph
    starts = spark.createDataFrame([("s", "https://a.org/", 0)], "site string, url string, depth int")
    assert {r.url[14:]: r.depth for r in graph.click_depth(edges, starts).collect()} == {"": 0, "blog": 1, "about": 1}


def test_keyword_scores(spark):
    got = lambda s, h, p, w: one(spark, F.struct(keywords.demand(F.lit(s), F.lit(h), F.lit(p)).alias("d"), keywords.opportunity(keywords.demand(F.lit(s), F.lit(h), F.lit(p)), F.lit(w)).alias("o")), x=1)
    assert got(4, 10, 0, 3).d == 100 and got(1, 1, 9, 3).d == 16 and tuple(got(2, 8, 0, 1)) == (73, 41) and got(2, 8, 0, 6).o == 81
    for s in range(1, 6):
        for h in range(1, 12):
            for p in (0, 3, 9, 40):
                exact = Decimal(min(s, 4)) / 4 * 40 + Decimal(min(h, 10)) / 10 * 35 + max(Decimal(0), Decimal(10 - min(p, 10)) / 10) * 25
                assert abs(got(s, h, p, 3).d - int(exact.quantize(Decimal(1), ROUND_HALF_EVEN))) <= (exact % 1 == Decimal("0.5"))


@pytest.mark.parametrize(("keyword", "intent"), [("buy shoes", "transactional"), ("best shoes", "commercial"), ("shoes near me", "local"), ("shoes", "informational"), ("nike shoes", "navigational"), ("shoes online order", "local"), ("قیمت کفش", "commercial"), ("how to tie shoes", "informational")])
def test_intent(spark, keyword, intent):
    assert one(spark, keywords.classify_intent(F.col("k"), F.array(F.lit("Nike"))), k=keyword) == intent


def test_clusters_and_expansion(spark):
    rows = [("shoes", k, 4 - n, 10 - n, 50 - n) for n, k in enumerate(("running shoes", "trail running shoes", "leather shoes", "shoes"))]
    found = spark.createDataFrame(rows, "seed string, keyword string, hits int, best_position int, demand int").withColumn("intent", F.lit("commercial"))
    clusters = keywords.cluster(keywords.rank_keywords(found)).collect()
    assert sum(c["size"] for c in clusters) == 4 and clusters[0].label == "running" and clusters[0].primary == "running shoes"
    plan = keywords.content_plan(keywords.cluster(keywords.rank_keywords(found))).filter("place = 1").first()
    assert plan.supporting_keywords == ["trail running shoes"] and "running shoes" in plan.suggested_title
    seeds = spark.createDataFrame([("coffee",)], "seed string")
    en, fa = ([r.query for r in keywords.build_queries(seeds, lang).orderBy("seq").collect()] for lang in ("en", "fa"))
    assert en[0] == fa[0] == "coffee" and len(set(en)) == len(en) and "how to coffee" in en and "coffee چیست" in fa
    merged = keywords.merge_suggestions(spark.createDataFrame([("s", "Red Shoe", "g", 3, 1), ("s", "red shoe ", "b", 1, 2), ("s", "x", "g", 0, 3)], "seed string, keyword string, source string, position int, seq bigint")).collect()
    assert [(m.keyword, m.sources, m.hits, m.best_position) for m in merged] == [("Red Shoe", ["b", "g"], 2, 1)]


HEADINGS = "array<struct<level:int,text:string>>"
PAGE_ROW = f"site string, url string, title string, description string, headings {HEADINGS}, words int, indexable boolean, seq bigint"


def test_coverage_and_plans(spark):
    rows = [
        ("s", "https://a.org/1", "Running shoes for men", None, [(1, "Running shoes")], 500, True, 1),
        ("s", "https://a.org/2", "Men running shoes sale", None, [], 900, True, 2),
        ("s", "https://a.org/contact-us", "", "", [], 50, True, 3),
        ("s", "https://a.org/4", "Running shoes hidden", None, [], 900, False, 4),
    ]
    page_rows = spark.createDataFrame(rows, PAGE_ROW)
    kws = spark.createDataFrame([("running shoes", 900, "commercial", 1), ("men running shoes", 400, "commercial", 2), ("leather boots", 700, "commercial", 3), ("shoes shoes", 1, "x", 4)], "keyword string, demand int, intent string, seq bigint")
    matched = coverage.match(page_rows, kws)
    assert {(r.keyword, r.url[-1]) for r in matched.collect()} == {(k, p) for k in ("running shoes", "men running shoes", "shoes shoes") for p in "12"}
    assert [r.keyword for r in coverage.gaps(page_rows, kws, matched).collect()] == ["leather boots"]
    assert {r.keyword: [p.url[-1] for p in r.pages] for r in coverage.cannibalisation(page_rows, matched).collect()}["running shoes"] == ["2", "1"]
    assert [r.url[-2:] for r in coverage.untargeted(page_rows, matched).collect()] == ["us"]
    assert coverage.coverage(page_rows, kws, matched).first().coverage == 75.0
    best = {r.url[-1]: r.keyword for r in coverage.best_keyword(page_rows, kws).collect()}
    assert best == {"1": "men running shoes", "2": "men running shoes"}
    plans = {r.url[-1]: {f.field: (f.problem, f.candidate) for f in r.fixes} for r in coverage.page_plans(page_rows, kws).collect()}
    assert plans["s"]["title"] == ("missing", "contact us") and plans["1"]["title"][0] == "too_short" and plans["1"]["description"][0] == "missing" and plans["2"]["h1"] == ("missing", "Men running shoes sale")
    rewrites = spark.createDataFrame([("https://a.org/1", "title", "Men running shoes that last for years"), ("https://a.org/2", "title", "Short")], "url string, field string, text string")
    done = {(r.url[-1], r.field): r.source for r in coverage.apply_rewrites(coverage.page_plans(page_rows, kws), rewrites).collect()}
    assert done["1", "title"] == "ai" and done["2", "title"] == "rules"
    assert one(spark, coverage.trim_title(F.col("x")), x="A long title about running shoes and how to choose them | The Brand of Shoes") == "A long title about running shoes and how to choose them"


def test_overlap_by_rarest_terms(spark):
    """Against all pairs, with a term on all pages and in most keywords; it is no join key where a keyword has a rarer one."""
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(80)]
    rows = [("s", f"u{k}", "common " + " ".join(rng.choices(vocabulary, k=rng.randrange(8))), None, [], 9, True, k) for k in range(150)]
    keys = [("common " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 5))), k) for k in range(60)] + [("common", 60), ("common common t1", 61), ("the of", 62)]
    frame = spark.createDataFrame(rows, "site string, url string, title string, description string, headings array<struct<level:int,text:string>>, words int, indexable boolean, seq int")
    kw = spark.createDataFrame([(k, 1, "i", n) for k, n in dict(keys).items()], "keyword string, demand int, intent string, seq int")
    for ratio in (0.5, 0.67, 1.0):
        got = {(r.url, r.keyword): r.hits for r in coverage.overlaps(frame, kw, coverage.declared(), ratio).collect()}
        want = {}
        for _, url, title, *_ in rows:
            for k in dict(keys):
                terms = [w for w in k.split() if w not in ("the", "of")]
                hits = sum(w in title.split() for w in terms)
                if terms and hits / len(terms) >= ratio:
                    want[url, k] = hits
        assert got == want
    has = frame.select("site", "url", F.array_distinct(F.split("title", " +")).alias("_has"))
    only_rare = coverage.keyword_terms(kw.filter("size(split(keyword, ' ')) = 2 and keyword like 'common t%'"))
    pairs = only_rare.select("keyword").distinct().count() * has.count()
    assert coverage.candidates(has, only_rare, 0.67).count() < pairs / 5


def test_words_are_composed_and_case_folded(spark):
    pages_ = [("s", "u1", "STRASSE ｆｕｌｌ ﬁne"), ("s", "u2", "Straße full fine"), ("s", "u3", "plain ascii words"), ("s", "u4", None), ("s", "u5", "e\u0301te\u0301 ﷺ ＡＢＣ１２"), ("s", "u6", "\u00e9t\u00e9\u00a0x")]
    frame = spark.createDataFrame(pages_, "site string, url string, title string")
    got = {r.url: r.w for r in t.with_words(frame, F.col("title"), "w").collect()}
    assert got["u1"] == got["u2"] == ["strasse", "full", "fine"] and got["u3"] == ["plain", "ascii", "words"] and got["u4"] == []
    import unicodedata

    for url, title in ((u, x) for _, u, x in pages_ if x):
        whole = frame.filter(F.col("url") == url).select(t.words(F.lit(unicodedata.normalize("NFKC", title).casefold()))).first()[0]
        assert got[url] == whole, url
    rows = frame.select("*", F.lit(None).cast("string").alias("description"), F.expr("cast(array() as array<struct<level:int,text:string>>)").alias("headings"), F.lit(True).alias("indexable"))
    kw = spark.createDataFrame([("strasse fine", 1, "i", 1), ("été", 1, "i", 2), ("abc12", 1, "i", 3)], "keyword string, demand int, intent string, seq int")
    assert {(r.url, r.keyword) for r in coverage.match(rows, kw).collect()} == {("u1", "strasse fine"), ("u2", "strasse fine"), ("u5", "été"), ("u6", "été"), ("u5", "abc12")}


def test_comparison(spark):
    def site(name, n, title, words):
        return [(name, f"{name}/{k}", title, "d" * 80, [(1, "Head")], words, True, k) for k in range(n)]

    rows = site("mine", 6, "", 100) + site("a", 6, "A title of a good length here", 900) + site("b", 6, "A title of a good length there", 1000) + site("tiny", 2, "Only tiny", 10)
    df = spark.createDataFrame(rows, PAGE_ROW)
    profile = compare.profile(df)
    verdicts = {r.metric: r.verdict for r in compare.rate_verdicts(profile.filter("site = 'mine'"), profile).collect()}
    assert verdicts == {"titled": "behind", "title_in_range": "behind", "described": "level", "has_h1": "level", "thin": "behind"}
    assert compare.length_verdict(profile.filter("site = 'mine'"), profile).first().verdict == "behind"
    terms = compare.terms(df, F.concat_ws(" ", "title", F.get("headings", F.lit(0))["text"]))
    assert {r.term for r in compare.themes(terms, profile, "mine").collect()} == {"title", "good", "length"}
    assert [r.term for r in compare.shared_themes(terms, profile, "mine").collect()] == ["head"]


def test_rankings(spark):
    rows = [("k1", p, f"https://{d}/", d, d) for p, d in enumerate(("other.org", "x.org", "other.org", "blog.mine.org"), 1)] + [("k2", 1, "https://notmine.org/", "notmine.org", "n")]
    ranked = {r.keyword: r for r in rankings.rank(spark.createDataFrame(rows, "keyword string, position int, url string, domain string, title string"), "www.Mine.org").collect()}
    assert ranked["k1"].position == 4 and ranked["k1"].competitors_above == ["other.org", "x.org"] and ranked["k2"].position is None
    got = {p: one(spark, rankings.opportunity(F.lit(p).cast("int")), x=1) for p in (None, 1, 2, 3, 5, 8, 11)}
    assert got == {None: 100, 1: 0, 2: 42, 3: 55, 5: 71, 8: 80, 11: 87}


def test_trends(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    m = lambda **k: {a: float(b) for a, b in k.items()}
    rows = [
        ("r1", "s", "audit", None, "completed", day(1), 40, m(overall_score=60, total_issues=10, orphan_pages=1), {"content": 68}),
        ("rx", "s", "audit", None, "failed", day(2), 40, m(overall_score=1), {}),
        ("r2", "s", "audit", None, "completed", day(3), 40, m(overall_score=70, total_issues=20), {"content": 76, "links": 5}),
        ("r3", "s", "audit", "t", "completed", day(4), 40, m(overall_score=1), {}),
        ("r4", "s", "audit", None, "completed", day(5), 80, m(overall_score=71, total_issues=90), {"content": 75}),
    ]
    runs = spark.createDataFrame(rows, "run_id string, site string, goal string, tenant string, status string, created_at timestamp, pages_crawled int, metrics map<string,double>, category_scores map<string,int>")
    assert {r.run_id: r.previous_run_id for r in trends.previous_run(runs).collect()} == {"r1": None, "r2": "r1", "r3": None, "r4": "r2"}
    found = {(r.run_id, r.metric): r.direction for r in trends.metric_trend(runs).collect()}
    assert found == {("r2", "overall_score"): "better", ("r2", "total_issues"): "worse", ("r4", "overall_score"): "level"}
    assert [(r.run_id, r.category, r.direction) for r in trends.category_trend(runs).orderBy("run_id").collect()] == [("r2", "content", "better"), ("r4", "content", "level")]


@pytest.mark.parametrize(
    ("after", "row", "want"),
    [
        ("2024-09-10 10:00", ("monthly", 9, 0, 31, "UTC"), "2024-09-30 09:00"),
        ("2023-02-01 10:00", ("monthly", 9, 0, 30, "UTC"), "2023-02-28 09:00"),
        ("2024-01-31 10:00", ("monthly", 9, 0, 31, "UTC"), "2024-02-29 09:00"),
        ("2024-05-01 09:00", ("daily", 9, 0, 1, "UTC"), "2024-05-02 09:00"),
        ("2024-05-01 03:00", ("daily", 9, 0, 1, "Asia/Tehran"), "2024-05-01 05:30"),
        ("2024-05-01 10:00", ("weekly", 9, 0, 1, "UTC"), "2024-05-06 09:00"),
        ("2024-05-06 09:00", ("weekly", 9, 0, 1, "UTC"), "2024-05-13 09:00"),
    ],
)
def test_next_run(spark, after, row, want):
    c, h, w, d, z = row
    got = one(spark, schedules.next_run(F.lit(after).cast("timestamp"), F.lit(c), F.lit(h), F.lit(w), F.lit(d), F.lit(z)).cast("string"), x=1)
    assert got == want + ":00"


FAULTY = {
    "": "<html><head><title>Home</title><script src=a.js></script><script src=b.js></script><script src=c.js></script><link rel=stylesheet href=x.css></head><body><h1></h1><h2>A</h2><h4>B</h4><img src=/IMG_001.jpg><img src=b.jpg><img src=c.png><a href='/about'>here</a><a href='/p?a=1&b=2&c=3'></a><span onclick=\"location='/x'\">go</span><img src='http://a.org/i.png'></body></html>",
    "about": "<html lang=en><head><title>Home</title><meta name=robots content='noindex,follow'></head><body><h1>A</h1><h1>B</h1></body></html>",
    "p?a=1&b=2&c=3": "<html><head><title>Page not found</title></head><body><h1>404</h1></body></html>",
}
SOUND = "<html lang='en'><head><meta charset=utf-8><title>A sound title of a good length, page {k}</title><meta content='{d} {k}' name='description'><meta name=viewport content='width=device-width'><link rel=canonical href='https://b.org/{k}'><meta property=og:title content=t><meta property='og:image' content=i><script type='application/ld+json'>{{\"@type\": \"Organization\", \"name\": \"B\"}}</script></head><body><main><h1>Heading {k}</h1><h2>What is it?</h2><p>{w}</p><ul><li>x</li></ul><a href='/1'>first page</a><a href='/about'>about us</a><a href='/contact'>contact</a><a href='/privacy'>privacy</a></main></body></html>"


def page_of(body, head=""):
    return markup.facts_of(f"<html><head>{head}</head><body>{body}</body></html>")


WORDS_60 = " ".join(f"w{k}" for k in range(60))


@pytest.mark.parametrize(("opens", "closes"), [
    ("<main>", "</main>"), ("<ARTICLE class=x>", "</ARTICLE>"), ("<div role='main'>", "</div>"), ("<div id=content>", "</div>"), ('<div class="a content b">', "</div>"), ("<section id='main'>", "</section>"),
    ("<article><article>", "</article></article>"), ("<div id=content><div><div>", "</div></div></div>"), ("<main>", ""), ("<div id=content></span></p>", "</div>"), ("<ul><li class=content>", "<li>not this</ul>"),
])
def test_main_text_by_tree(opens, closes):
    found = page_of(f"<nav>menu {WORDS_60}</nav>{opens}<p>{WORDS_60}<p>more &amp; <b>more</b><script>no()</script>{closes}<footer>foot {WORDS_60}</footer>")
    rest = f" foot {WORDS_60}" if closes == "" else ""  # never closed: up to the end
    assert (found["main"], found["text"]) == ("main", f"{WORDS_60} more & more{rest}")


def test_markup_of_broken_and_odd_pages():
    assert page_of(f"<header>{WORDS_60}</header><div class=contents>{WORDS_60} x</div>")["text"] == WORDS_60 + " x"  # a class of another name
    assert page_of("<nav>a b</nav><p>c")["text"] == "a b c" and page_of("")["text"] == "" and markup.facts_of(None)["text"] == ""
    inner = page_of(f"<article>{WORDS_60}<article>{WORDS_60} y</article> z</article>")
    assert inner["text"] == f"{WORDS_60} {WORDS_60} y z"
    f = page_of("<h1>A<h2></h2><h3>b <i>c</i><noscript>n</noscript></h3><svg><title>t</title><h1>no</h1></svg><a href=' /x '>one <a href=#>two</a><img data-src=i.png alt=''>")
    assert f["headings"] == [(1, "A"), (2, ""), (3, "b c")] and [(r, t) for r, t, _ in f["anchors"]] == [("/x", "one")] and f["images"] == [("i.png", "", None, None, None)]
    f = page_of("", "<title>A &lt;b&gt; &eacute;</title><script src=a.js></script><script src=b.js defer></script><script type='application/LD+json'>{\"a\": \"</p>\"}</script><style>p{}</style><link rel='SHORTCUT icon' href=f.ico><meta name=Robots content=' noindex '>")
    assert (f["title"], f["external_scripts"], f["blocking_scripts"], f["jsonld"], f["inline_style_bytes"], f["favicon"], f["robots"]) == ("A <b> é", 2, 1, ['{"a": "</p>"}'], 3, "f.ico", "noindex")
    assert markup.facts_of("<title>x<p a='unclosed>y <b>z</b> <a href=/q>l</a>")["anchors"] == [("/q", "l", "")]
    for bad in ("<div>" * 30_000, '<a "' * 30_000, "<!--" * 30_000, "<title>" * 30_000, "<main>" * 30_000, "</x>" * 30_000, "<a b=\"<a b='" * 20_000, "<" * 100_000):
        assert isinstance(markup.facts_of(bad)["text"], str)


def audited(spark, name, host, html, robots):
    rows = [(name, f"https://{host}/{k}", 404 if k == "gone" else 200, h, n) for n, (k, h) in enumerate(html.items())]
    facts = pages.page_facts(pages.with_defaults(spark.createDataFrame(rows, "site string, url string, status_code int, html string, crawl_seq int")))
    ready = audit.ready(pages.with_flags(facts).checkpoint()).checkpoint()
    sites = spark.createDataFrame([(name, f"https://{host}/", robots, True, True)], "site string, start_url string, robots_txt string, llms_txt boolean, security_txt boolean")
    sitemap = spark.createDataFrame([(name, f"https://{host}/{k}") for k in html if k != "gone"], "site string, loc string")
    hits, notes = audit.run_all({"pages": ready, "sites": sites, "sitemap": sitemap})
    assert not notes
    return ready, audit.roll_up(hits).checkpoint()


def test_audit(spark):
    bad, bad_issues = audited(spark, "bad", "a.org", FAULTY | {"gone": "<html></html>"}, "User-agent: *\nDisallow: /\n")
    ids = {r.issue_id for r in bad_issues.collect()}
    assert ids >= {
        "title-too-short", "h1-empty", "heading-order", "image-alt-missing", "image-no-dimensions", "image-filename", "mixed-content", "js-navigation", "generic-anchor-text", "empty-anchor-text",
        "viewport-missing", "html-lang-missing", "charset-missing", "meta-description-missing", "canonical-missing", "og-missing", "thin-content", "broken-internal-links", "soft-404", "url-parameters",
        "robots-blocks-site", "robots-no-sitemap", "noindex-pages", "no-structured-data", "missing-contact-page", "render-blocking-resources",
    }
    words = " ".join(f"word{k}" for k in range(650))
    good, good_issues = audited(spark, "good", "b.org", {k: SOUND.format(k=k, d="A description that is long enough to be shown in full by anyone who reads.", w=words + f" {k}") for k in ("1", "2", "3", "about")}, "User-agent: *\nAllow: /\nSitemap: https://b.org/sitemap.xml\n")
    ids = {r.issue_id for r in good_issues.collect()}
    assert not ids & {"title-missing", "title-duplicate", "meta-description-missing", "canonical-missing", "canonical-mismatch", "h1-missing", "thin-content", "viewport-missing", "no-structured-data", "og-missing", "robots-blocks-site", "sitemap-missing", "schema-missing-required", "missing-about-page", "heading-order"}, ids
    score = lambda p, i: audit.overall_scores(audit.category_scores(p, i), i).first().overall_score
    assert score(bad, bad_issues) <= 45 < score(good, good_issues)
    order = [r.severity for r in audit.quick_wins(bad_issues).orderBy("place").collect()]
    assert order == sorted(order, key=lambda s: audit.SEVERITY[s][1]) and len(order) == 8
    assert {r.inlinks for r in good.filter("url = 'https://b.org/about'").collect()} == {4}
    assert audit.site_stats(bad, bad_issues).first().errors == 1


def test_robots_folds(spark):
    robots = "User-agent: gptbot\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 1\nDisallow: /\n"
    assert one(spark, audit.blocks_site(F.col("r")), r=robots) is True
    assert one(spark, audit.blocked_ai_crawlers(F.col("r")), r=robots) == []
    assert one(spark, audit.blocked_ai_crawlers(F.col("r")), r="User-agent: GPTBot\nUser-agent: CCBot # x\nDisallow: /\n") == ["ccbot", "gptbot"]
    assert one(spark, audit.blocks_site(F.col("r")), r="User-agent: other\nDisallow: /") is False
    rules = tables.parse_robots(spark.createDataFrame([("s", "User-agent: *\nAllow: /a/b\nDisallow: /a # c\n\nUser-agent: x\nDisallow: /")], "site string, body string"))
    urls = spark.createDataFrame([("s", p, p) for p in ("/a", "/a/b/c", "/z")], "site string, url string, path string")
    assert {r.url: r.blocked for r in tables.robots_blocked(urls, rules).collect()} == {"/a": True, "/a/b/c": False, "/z": False}


def test_sources(spark, tmp_path):
    report = {"start_url": "https://a.org", "pages": [{"url": "https://a.org/", "status": 200}], "links": {"edges": [{"from": "a", "to": "b", "anchor": "x", "nofollow": True}]}, "issues": [{"id": "i", "severity": "low"}]}
    parts = tables.explode_report(spark.createDataFrame([("s", json.dumps(report))], "site string, report string"))
    assert parts["edges"].first().target == "b" and parts["pages"].first().status == 200 and parts["issues"].first().id == "i"
    bodies = spark.createDataFrame([("s", 1, "<sitemapindex><loc> https://a.org/m.xml </loc></sitemapindex>"), ("s", 2, "<urlset><loc>https://a.org/?a=1&amp;b=2</loc><loc>https://a.org/m.xml</loc></urlset>")], "site string, seq int, body string")
    assert [(r.loc, r.child) for r in tables.extract_sitemap_locs(bodies).orderBy("seq", "pos").collect()] == [("https://a.org/m.xml", True), ("https://a.org/?a=1&b=2", False)]
    payload = {"loadingExperience": {"metrics": {"CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 30}, "LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2500}}}, "lighthouseResult": {"audits": {"a": {"score": 0.5, "details": {"overallSavingsMs": 200}}, "b": {"score": 0.95, "details": {"overallSavingsMs": 900}}}}}
    metrics, chances = tables.explode_vitals(spark.createDataFrame([("s", json.dumps(payload))], "site string, payload string"))
    assert {r.metric: (r.value, r.status) for r in metrics.collect()} == {"CLS": (0.3, "poor"), "LCP": (2500.0, "good")}
    assert {r.issue_id for r in tables.vitals_hits(metrics, chances).collect()} == {"cwv-cls", "psi-a"}
    page = '<div class="result"><a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.org%2F">A <b>b</b></a></div><div class="result result--ad"><a class="result__a" href="https://ad.org">ad</a></div><div class="web result"><a class="result__a" href="https://www.c.org/x">C</a></div>'
    assert [(r.position, r.domain, r.title) for r in tables.extract_serp(spark.createDataFrame([("k", page)], "keyword string, html string")).orderBy("position").collect()] == [(1, "a.org", "A b"), (2, "c.org", "C")]
    rows = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (bytearray(b"<meta charset=windows-1252>\x80"), None), (bytearray(b"\xff"), None)], "body binary, content_type string")
    assert [r.text for r in tables.decode_bodies(rows).collect()] == ["é", "<meta charset=windows-1252>€", "�"]
    good, bad = tables.validate(spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"b": "x"}'), (3, '{"a": 1, "c": 2}'), (4, "no")], "id int, payload string"), "a int, b string", ("a",))
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]
    tables.write_results({"issues": spark.createDataFrame([("s", "i")], "site string, id string")}, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/issues").first().id == "i"


ENVELOPE = {"type": "site.page.updated", "version": 1, "occurred_at": "2024-01-01T00:00:00Z", "producer": "crawl", "payload": "{}"}


def test_events(spark, tmp_path):
    rows = [{"id": "1"} | ENVELOPE, {"id": "1"} | ENVELOPE, ENVELOPE, {"id": "2"} | ENVELOPE | {"type": "site.run.done"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    stream = spark.readStream.schema("value string").text(f"file://{tmp_path}/in")
    parsed = events.drain(events.parse(stream), "test-parse")
    sound, dead = events.split_dead_letters(parsed)
    assert sound.count() == 3 and dead.count() == 2
    once = events.drain(events.dedup(events.split_dead_letters(events.parse(stream))[0]).select("id", "type"), "test-dedup")
    assert sorted(r.id for r in once.collect()) == ["1", "2"] == sorted(r.id for r in events.dedup(sound).select("id").collect())
    assert [r.id for r in events.route(once, "site.*.updated").collect()] == ["1"] and events.route(once, "site.#").count() == 2
    channels = spark.createDataFrame([("c1", None, [], True), ("c2", None, ["site.run.done"], True), ("c3", "t", [], True), ("c4", None, [], False)], "channel_id string, tenant_id string, events array<string>, active boolean")
    sent = events.deliveries(channels, once.withColumn("tenant_id", F.lit(None).cast("string")))
    assert sorted((r.channel_id, r.id) for r in sent.collect()) == [("c1", "1"), ("c1", "2"), ("c2", "2")]
    steps = spark.createDataFrame([("r1", 0, "completed", False, None), ("r1", 1, "failed", True, "e"), ("r2", 0, "failed", False, "x"), ("r3", 0, "pending", False, None)], "run_id string, position int, status string, optional boolean, error string")
    assert {r.run_id: r.status for r in events.run_status(steps).collect()} == {"r1": "completed", "r2": "failed", "r3": "running"}


@pytest.mark.parametrize("fails_at", [0, 2])
def test_micro_batches_with_a_failure(spark, tmp_path, fails_at):
    """Sinks and state by batch number: after a failure half way and a restart every sink equals its batch twin, and old keys are forgotten."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot", *"abcdef"]), rng.choice(["x", "y", None]), k) for k in range(400)]
    for k in range(4):  # a file is a batch
        (tmp_path / f"in-{k}").mkdir()
        part = rows[k * 100 : (k + 1) * 100]
        rng.shuffle(part)
        spark.createDataFrame([(u, h, dt.datetime(2024, 1, 1) + dt.timedelta(hours=a)) for u, h, a in part], "url string, content_hash string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in-{k}/p")
    folder = f"{tmp_path}/run"
    state = batches.State(spark, f"{folder}/state", ("url",), batches.CHANGE_STATE, "2 days", compacted=2)
    failed = []

    def step(batch, before):
        sinks, changed = batches.change_step(batch, before)
        if len(failed) == 0 and fails_at is not None and batch.filter(F.col("at") >= dt.datetime(2024, 1, 1) + dt.timedelta(hours=100 * fails_at)).count():
            failed.append(1)
            sinks |= {"later": batch.select(F.raise_error(F.lit("no disk")).cast("string").alias("x"))}  # the first sink is written, the second fails
        return sinks, changed

    for k in (1, 3):
        stream = spark.readStream.schema("url string, content_hash string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in-[0-{k}]/p")
        for _ in range(2):
            try:
                batches.process(stream, folder, step, state)
                break
            except Exception:  # the stream's own: it is started again
                assert failed
    assert bool(failed) == (fails_at is not None)
    last, want = {}, []
    for url, value, at in rows:
        if url not in last or last[url] != value:
            if not (url not in last and value is None):
                want.append((url, last.get(url), value))
        last[url] = value
    found = batches.sink(spark, folder, "changes", batches.CHANGES)
    assert sorted(((r.url, r.previous_hash, r.content_hash) for r in found.collect()), key=str) == sorted(want, key=str)
    old = spark.createDataFrame([("gone", "x", dt.datetime(2020, 1, 1)), ("a", "y", dt.datetime(2024, 1, 1))], batches.CHANGE_STATE)
    other = batches.State(spark, f"{tmp_path}/other", ("url",), batches.CHANGE_STATE, "2 days", compacted=1)
    other.write(0, other.before(0), old)
    other.write(1, other.before(1), old.filter("url = 'a'"))
    other.write(2, other.before(2), old.limit(0))
    assert [r.url for r in other.before(3).collect()] == ["a"]


def test_robots_prefixes_against_a_scan_of_all_rules(spark):
    """One site with 100,000 rules: its rules are never in one row, and a url is looked up by its prefixes."""
    rng = random.Random(2)
    path = lambda n: "/" + "/".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(n))
    rules = [("big", k, f"/x{k:06d}", "disallow") for k in range(100_000)]
    rules += [(site, 100_000 + k, rng.choice([path(rng.randrange(1, 4)), "", "/"] if k % 50 == 0 else [path(rng.randrange(1, 4))]), rng.choice(["allow", "disallow"])) for k in range(400) for site in ("big", "s")]
    urls = [(site, f"{site}{k}", rng.choice([path(4), path(1), "", "/", "/x000007/y", "/x0999"])) for k in range(300) for site in ("big", "s", "none")]
    frame = spark.createDataFrame([(s, n, v, d, ["*"]) for s, n, v, d in rules], "site string, line_no int, value string, directive string, agents array<string>")
    found = {r.url: r.blocked for r in tables.robots_blocked(spark.createDataFrame(urls, "site string, url string, path string"), frame).collect()}
    small = [r for r in rules if not r[2].startswith("/x")]
    for site, url, p in urls:
        first = min(((n, d) for s, n, v, d in small if s == site and v and p.startswith(v)), default=None)
        if site == "big" and (p[:8] == "/x000007" or (first and p.startswith("/x"))):
            first = (7, "disallow")
        assert found[url] == (first is not None and first[1] == "disallow"), (site, p)
    marked = spark.createDataFrame([(s, u, p, True) for s, u, p in urls], "site string, url string, path string, is_noindex boolean")
    hits = {r.url for r in tables.noindex_blocked(marked, frame).collect()}
    assert hits == {u for s, u, p in urls if any(s == x and v not in ("", "/") and d == "disallow" and p.startswith(v) for x, _, v, d in small) or (s == "big" and p.startswith("/x000007"))}


def test_rule_registry_goes_on_after_a_failure(spark):
    audit.REGISTRY["broken"] = lambda frames: 1 / 0
    try:
        facts = pages.page_facts(pages.with_defaults(spark.createDataFrame([("s", "https://a.org/", "<title>x</title>")], "site string, url string, html string")))
        hits, notes = audit.run_all({"pages": audit.ready(pages.with_flags(facts))}, ("pages", "broken"))
        assert hits.count() > 0 and notes == ["broken: division by zero"]
    finally:
        del audit.REGISTRY["broken"]


def test_folding_of_documents(spark):
    import unicodedata

    from sitesieve.plans import page_queries

    rows = page_queries.arrow_udf_text(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.folded for r in rows} == {i: x and unicodedata.normalize("NFKC", x).casefold() for i, x in texts.items()}


def test_joined_reports_and_headline(spark):
    wanted = spark.createDataFrame([("a", "mine", 1), ("a", "competitor", 2), ("a", "competitor", 2), ("a", "competitor", 9), ("b", "mine", 8), ("b", "competitor", 1), ("c", "competitor", None)], "comparison_id string, role string, crawl_id int")
    reports = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "crawl_id int, site string")
    got = {(r.comparison_id, r.role, r.crawl_id): (r.site, r.available, r.status) for r in compare.assemble(wanted, reports).collect()}
    assert got == {
        ("a", "mine", 1): ("one", True, "completed"), ("a", "competitor", 2): ("two", True, "completed"), ("a", "competitor", 9): (None, False, "completed"),
        ("b", "mine", 8): (None, False, "failed"), ("b", "competitor", 1): ("one", True, "failed"), ("c", "competitor", None): (None, False, "failed"),
    }
    assert compare.assemble(wanted.limit(0), reports).count() == 0
    steps = [("r", 1, "crawl", "{}"), ("r", 3, "crawl", '{"overall_score": 71.5, "total_issues": 4}'), ("r", 4, "crawl", '{"overall_score": 9}'), ("r", 2, "competitor_check", '{"compared_against": 3}'), ("q", 1, "serp_check", None), ("q", 2, "keyword_research", '{"total": "many"}')]
    rows = {r.run_id: r for r in events.headline(spark.createDataFrame(steps, "run_id string, position int, kind string, result string")).collect()}
    assert (rows["r"].overall_score, rows["r"].total_issues, rows["r"].competitors_compared, rows["r"].behind_on, rows["r"].orphan_pages) == (71.5, 4, 3, 0, None)
    assert set(rows["q"].asDict().values()) == {"q", None}


def test_next_actions_are_per_site(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    opportunities = of([("s", f"k{i}", float(i)) for i in range(5)] + [("t", "k", None)], "site string, keyword string, opportunity double")
    broken, gaps = of([("s", "/b", 4)], "site string, url string, linked_from int"), of([("s", "g", 1.0), ("s", "h", 2.0)], "site string, keyword string, demand double")
    issues = of([("t", "no-https", 3), ("t", "h1-missing", 3)], "site string, issue_id string, affected int")
    got = sorted(tuple(r) for r in tables.next_actions(opportunities, broken, gaps, issues).collect())
    assert got == [
        ("s", 1, "rank", "k4"), ("s", 2, "rank", "k3"), ("s", 3, "rank", "k2"), ("s", 4, "link", "/b"), ("s", 5, "content", "h"),
        ("t", 1, "rank", "k"), ("t", 2, "issue", "h1-missing"), ("t", 3, "issue", "no-https"),
    ]


def test_site_labels(spark):
    urls = {"https://www.Site.example/a": "site.example", "http://site.example:8080": "site.example:8080", "no host": "no host", "": "unknown", None: "unknown"}
    rows = spark.createDataFrame([(k,) for k in urls], "url string").select("url", u.site_label(F.col("url")).alias("label")).collect()
    assert {r.url: r.label for r in rows} == urls


@pytest.mark.parametrize(("raw", "want"), [("a &amp; b&amp", "a & b&amp"), ("&ampx;&#39;&#39", "&ampx;'&#39"), ("&notit;&eacute;&#xE9;", "&notit;éé"), ("&amp;lt;", "&lt;")])
def test_references_end_with_a_semicolon(raw, want):
    """A text that was cut within a reference keeps what is left of it."""
    found = markup.facts_of(f"<title>{raw}</title><h1>{raw}</h1><a href='/?a=1&copy=2'>x</a>")
    assert found["title"] == want and found["headings"] == [(1, want)] and found["anchors"][0][0] == "/?a=1&copy=2"


@pytest.fixture(scope="module")
def shared_urls(spark, tmp_path_factory):
    """Two pages of one url, of which the second has external links, and another page with the same links."""
    folder = tmp_path_factory.mktemp("shared-urls")
    html = "<html><head></head><body><a href='/x'>x</a></body></html>"
    rows = [(1, "https://a.org/p", html), (12, "https://a.org/p", html), (2, "https://a.org/q", html)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_change_feed_has_a_row_for_each_page_of_a_shared_url(spark, shared_urls):
    found = source_queries.page_change_feed(spark, shared_urls).select("url", "changed").collect()
    assert sorted(map(tuple, found)) == [("https://a.org/p", False), ("https://a.org/p", True), ("https://a.org/q", False)]


def test_external_links_are_found_on_the_page_that_has_them(spark, shared_urls):
    """Page 1 has none of the links of page 12, which has its url."""
    assert {r.href: r.found_on for r in source_queries.external_probe_sample(spark, shared_urls).collect()} == {"https://x.com/us": "https://a.org/q", "http://old.example/p": "https://a.org/q"}


def test_alternates_and_canonicals_of_both_schemes(spark):
    """A page of a site is the same by http and https, so an alternate that doesn't name the page back is found by either."""
    head = lambda *links: "<html><head>" + "".join(f'<link rel="alternate" hreflang="{c}" href="{h}">' for c, h in links) + "</head><body>x</body></html>"
    rows = [("http://a.org/p", head(("en", "http://a.org/p"), ("de", "/alt"))), ("https://a.org/alt", head(("en", "/x"))), ("http://a.org/q", head(("de", "/both"))), ("https://a.org/both", head(("en", "/q")))]
    facts = pages.with_flags(pages.page_facts(pages.with_defaults(spark.createDataFrame(rows, "url string, html string"))))
    assert [r.url for r in audit.hreflang_hits({"pages": facts}).collect()] == ["http://a.org/p"]
    shown = [("http://a.org/c", '<html><head><link rel="canonical" href="/hidden"></head><body>x</body></html>'), ("https://a.org/hidden", '<html><head><meta name="robots" content="noindex"></head><body>x</body></html>')]
    facts = pages.with_flags(pages.page_facts(pages.with_defaults(spark.createDataFrame(shown, "url string, html string"))))
    assert [(r.url, r.issue_id) for r in audit.canonical_hits({"pages": facts}).collect()] == [("http://a.org/c", "canonical-to-noindex")]


def test_pairs_are_made_without_a_shuffle_of_pages(spark, monkeypatch):
    """In one part or in several: a page meets the keywords' index where it is, and each pair is made once."""
    rows = [("s", f"u{k}", f"common t{k % 7} t{k % 5} t{k % 3}", None, [], 9, True, k) for k in range(60)]
    frame = spark.createDataFrame(rows, PAGE_ROW)
    kw = spark.createDataFrame([(f"t{a} t{b}", a, "i", 10 * a + b) for a in range(7) for b in range(7)], "keyword string, demand int, intent string, seq bigint")
    found = {}
    for size in (100_000, 9):
        monkeypatch.setattr(coverage, "BROADCAST_TERMS", size)
        pairs = coverage.overlaps(frame, kw, coverage.declared(), 0.5)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        found[size] = sorted(map(tuple, pairs.select("url", "keyword", "hits").collect()))
        best = {r.url: (r.keyword, r.demand) for r in coverage.best_keyword(frame, kw).collect()}
        for url in best:
            of = max((h / 2, 2, int(k[1]), -int(k[1] + k[-1]), k) for u, k, h in found[size] if u == url)
            assert best[url] == (of[-1], of[2])
    assert found[9] == found[100_000] and len(set(found[9])) == len(found[9]) and any(h == 1 for *_, h in found[9])


def test_covered_keywords_are_folded_and_texts_are_not(spark):
    """As the SQL of the fixes has it."""
    both = lambda text, keyword: one(spark, coverage.covers(F.col("t"), F.col("k")), t=text, k=keyword)
    assert both("das strasse Haus", "straße haus") and not both("die Straße und Haus", "Straße Haus") and both("Haus am See", "haus see")


def test_few_pages_are_python_objects_at_once(spark):
    """However long an Arrow batch is: the facts are those of the whole batch, and no more pages are read before the first are put away."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    kind, most = StructType.fromDDL(markup.FACTS), []
    html = [f"<title>{k}</title><img src=/{k}.png>" if k % 9 else None for k in range(1000)]

    class Slices:
        def __len__(self):
            return len(html)

        def slice(self, at, n):
            most.append(n)
            return pa.array(html[at : at + n], pa.string())

    got = pages.facts_array(Slices(), kind).to_pylist()
    assert [x["title"] for x in got] == [str(k) if k % 9 else None for k in range(1000)] and max(most) <= 64
    assert pages.facts_array(pa.array([], pa.string()), kind).to_pylist() == []


@pytest.mark.parametrize(
    ("raw", "node"),
    [("", "/"), (" /a/#top ", "/a"), ("/a?", "/a"), ("/a/?b/#c?d", "/a?b/"), ("//Host.org", "//host.org/"), ("Http:", "http:/"), ("MAILTO:A@b", "mailto:A@b"), ("a/B:c/", "a/B:c"), ("?Q", "/?Q"), ("a//", "a/"), ("12", "12"), ("/é/ß/", "/é/ß"), (None, None)],
)
def test_nodes_of_odd_urls(spark, raw, node):
    rows = spark.createDataFrame([(raw,)], "x string")
    assert rows.select(u.normalise_node(F.col("x"))).first()[0] == node


def test_nodes_are_spelled_once_for_each_edge(spark):
    """The filter of self links reads both ends and doesn't make them anew."""
    rows = [("s", "http://A.org/x/", "http://a.org/x#y", "self", False), ("s", "http://A.org/x/", "/y", " to y ", True), ("s", "/y", "/y?a", None, False), ("s", None, "/y", "", False)]
    links = spark.createDataFrame(rows, "site string, source string, target string, anchor string, nofollow boolean")
    edges = graph.build_graph(links.select("site", F.col("source").alias("url")), links)[1]
    assert sorted(map(tuple, edges.collect())) == [("s", "/y", "/y?a", "", False), ("s", "http://a.org/x", "/y", "to y", True)]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]


def test_duplicate_groups_of_pages_cut_within_a_reference(spark, tmp_path):
    """Headings are cut anywhere; what is left of a reference is text, so these copies have the hash that the SQL gives them, and not that of the last page."""
    import duckdb

    page = "<html><head><title>x</title></head><body><article><h1>one&amp;&amp;&{}</h1><p>" + "more words &amp; &quot;words&quot; " * 30 + "</p></article></body></html>"
    rows = [(k, f"https://a.org/{k}", page.format(cut)) for k, cut in enumerate(("amp", "amp", "am", "am", "quo", "quot", "quot", "amp;"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(page_queries.SQL["duplicate_groups"]).fetchall())
    assert sorted(map(tuple, page_queries.duplicate_groups(spark, str(tmp_path)).collect())) == want and [n for *_, n in want] == [2, 2, 2]


def test_duplicate_groups_of_pages_without_html(spark, tmp_path):
    """They are no copies of empty pages, and the feed of changes has them as its SQL has."""
    import duckdb

    from sitesieve.plans import source_queries

    rows = [(k, f"https://{host}.org/{k}", html) for k, (host, html) in enumerate([("a", None), ("a", None), ("a", ""), ("a", ""), ("a", "<body></body>"), ("b", None), ("b", ""), ("c", None), ("c", None), ("c", None), ("c", "<body>x</body>")])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for plan, name in ((page_queries, "duplicate_groups"), (source_queries, "page_change_feed")):
        got = sorted(map(str, map(tuple, plan.QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(str, con.execute(plan.SQL[name]).fetchall())) and len(got) == {"duplicate_groups": 3, "page_change_feed": 10}[name]


@pytest.mark.parametrize(("name", "rows"), [("page_jsonld_blocks", 33), ("scan_sitemap_locs", 25)])
def test_pages_that_share_a_url(spark, tmp_path, name, rows):
    """Each has its own structured data and stands for itself in the sitemaps, whether it is in the same file or in another."""
    import duckdb

    urls = [(k, f"https://a.org/{'shared' if k % 6 in (2, 3, 5) else k}?a&amp;b&c") for k in range(22)]
    html = "<html><head><title>x</title></head><body><p>words</p></body></html>"
    spark.createDataFrame([(k, url, html) for k, url in urls], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    plan = page_queries if name in page_queries.QUERIES else source_queries
    want = sorted(con.execute(plan.SQL[name]).fetchall())
    assert sorted(map(tuple, plan.QUERIES[name](spark, str(tmp_path)).collect())) == want and len(want) == rows


def test_best_keywords_are_found_without_pairs(spark, monkeypatch):
    """Against all pairs, in one part or in several; no row stands for a page and a keyword."""
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(60)]
    rows = [("s", f"u{k}", " ".join(rng.choices(vocabulary, k=rng.randrange(9))), None, [], 9, True, k) for k in range(300)]
    keys = dict.fromkeys([*(" ".join(rng.choices(vocabulary[: rng.choice((9, 60))], k=rng.choice((1, 2, 2, 2, 3, 4, 5)))) for _ in range(90)), "t1 t1", "t2 t2 t3", "the of"])
    kw = spark.createDataFrame([(k, n % 4, "i", n) for n, k in enumerate(keys)], "keyword string, demand int, intent string, seq bigint")
    want = {}
    for _, url, title, *_ in rows:
        for n, k in enumerate(keys):
            terms = [w for w in k.split() if w not in ("the", "of")]
            overlap = sum(w in title.split() for w in terms) / max(len(terms), 1)
            if overlap >= 0.5:
                want[url] = max(want.get(url, (0,)), (overlap, len(terms), n % 4, -n, k))
    assert {x[0] for x in want.values()} > {0.5, 1.0} and {0.6, 0.75} & {x[0] for x in want.values()}
    for size in (100_000, 20):
        monkeypatch.setattr(coverage, "BROADCAST_TERMS", size)
        best = coverage.best_keyword(spark.createDataFrame(rows, PAGE_ROW).repartition(3), kw)
        assert "Generate" not in best._jdf.queryExecution().optimizedPlan().toString()
        assert {r.url: (r.keyword, r.demand) for r in best.collect()} == {url: (x[-1], x[2]) for url, x in want.items()}
    assert coverage.best_keyword(spark.createDataFrame(rows, PAGE_ROW), kw.limit(0)).collect() == []


def test_fixes_are_made_once_for_each_page(spark):
    """The filter of pages without fixes reads them and doesn't make them anew."""
    rows = [("s", "https://a.org/1", "Running shoes for men", None, [(1, "Running shoes")], 500, True, 1)]
    kws = spark.createDataFrame([("running shoes", 900, "commercial", 1)], "keyword string, demand int, intent string, seq bigint")
    plans = coverage.page_plans(spark.createDataFrame(rows, PAGE_ROW), kws)
    plan = plans._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
