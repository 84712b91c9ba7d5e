"""Rules over page facts: hits, issues, penalties and scores of many sites.

A page rule is a predicate on one page, so all page rules are evaluated in one scan that emits an array of hits.
Rules that compare a site's share of hits with a bound are filtered afterwards on the site's counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.functions.urls import host_of, is_internal, normalize_url, url_parts
from sitesieve.operators.coverage import DESC_MAX, DESC_MIN, TITLE_MAX, TITLE_MIN
from sitesieve.operators.graph import GENERIC_ANCHORS
from sitesieve.operators.pages import page_links, term_density
from sitesieve.operators.robots import noindex_blocked
from sitesieve.operators.structured import jsonld_blocks
from sitesieve.operators.usage import texts_with
from sitesieve.sources.tables import broken_external, explode_vitals, vitals_hits

# Weights and order of severities, weights of categories.
SEVERITY = {"critical": (30, 0), "high": (15, 1), "medium": (7, 2), "low": (3, 3), "info": (0, 4)}
CATEGORY_WEIGHT = {
    "indexing": 1.4, "content": 1.4, "technical": 1.2, "performance": 1.2, "structured_data": 0.8,
    "links": 1.0, "images": 0.7, "eeat": 1.0, "international": 0.5, "ai_search": 0.7,
}
# Labels of severities, and of categories in both languages.
SEVERITY_LABEL = {"critical": "بحرانی", "high": "زیاد", "medium": "متوسط", "low": "کم", "info": "اطلاعی"}
CATEGORY_LABEL = {
    "indexing": ("ایندکس‌شدن و خزش", "Indexing & Crawling"), "content": ("محتوا و کلمات کلیدی", "Content & Keywords"), "technical": ("فنی", "Technical"), "performance": ("سرعت و Core Web Vitals", "Speed & Core Web Vitals"),
    "structured_data": ("داده ساختاریافته", "Structured Data"), "links": ("لینک‌سازی", "Linking"), "images": ("تصاویر", "Images"), "eeat": ("اعتبار و E-E-A-T", "Trust & E-E-A-T"), "international": ("چندزبانه", "Internationalization"),
    "ai_search": ("جستجوی هوش مصنوعی", "AI Search"),
}
OPTIONAL = ("images", "international")
GRADES = ((90, "عالی"), (75, "خوب"), (60, "قابل قبول"), (40, "ضعیف"))
LOWEST_GRADE = "بحرانی"
QUICK = (
    "title-missing", "title-too-long", "title-too-short", "meta-description-missing", "h1-missing", "image-alt-missing", "viewport-missing", "canonical-missing",
    "robots-no-sitemap", "html-lang-missing", "og-missing", "image-no-dimensions", "no-lazy-loading", "sitemap-missing", "charset-missing", "missing-rtl-direction",
    "no-breadcrumb-schema", "empty-anchor-text", "url-uppercase", "no-hsts",
)
# The patterns and lists of the rules.
SOFT_404 = r"(?i)(صفحه\s*(?:مورد نظر\s*)?(?:پیدا|یافت)\s*نشد|۴۰۴|404\b|page\s+not\s+found|چنین صفحه‌ای وجود ندارد|nothing\s+found|no\s+results\s+found)"
QUESTION = r"(?i)(چیست|چگونه|چطور|چرا|کدام|چه\s|آیا|کجا|چند|\?|؟|^(what|how|why|when|where|which|who|is|are|can|does|do)\b)"
AUTHOR = r"(?i)(rel=[\"']author|itemprop=[\"']author|class=[\"'][^\"']*author|\"author\"\s*:|نویسنده|نوشته[‌ ]?ی|written\s+by|by\s+[A-Z][a-z]+)"
HREFLANG = r"^([a-z]{2,3})(-[A-Za-z]{4})?(-[A-Za-z]{2}|-\d{3})?$"
JS_LINK = r"(?i)<(?:a|span|div|button)[^>]*\bonclick\s*=\s*[\"'][^\"']*(?:location|href)"
IMAGE_NAME = r"(?i)^(img|image|photo|dsc|screenshot|untitled)[-_ ]?\d*\.\w+$"
TRUST = {
    "about": ("medium", r"(?i)(درباره[\-_ ]?ما|درباره|about[\-_ ]?us|about|who[\-_ ]?we[\-_ ]?are|معرفی)"),
    "contact": ("medium", r"(?i)(تماس|ارتباط[\-_ ]?با[\-_ ]?ما|contact|پشتیبانی|support)"),
    "privacy": ("low", r"(?i)(حریم[\-_ ]?خصوصی|privacy|policy|قوانین|terms|شرایط)"),
}
SOCIAL = ("instagram.com", "linkedin.com", "twitter.com", "x.com", "t.me", "telegram", "youtube.com", "facebook.com", "aparat.com", "github.com", "virgool.io")
AI_CRAWLERS = ("gptbot", "chatgpt-user", "oai-searchbot", "claudebot", "anthropic-ai", "perplexitybot", "google-extended", "ccbot", "bytespider", "applebot-extended")
MODERN_IMAGES, LEGACY_IMAGES = (".webp", ".avif", ".svg"), (".jpg", ".jpeg", ".png", ".gif", ".bmp")
REQUIRED_FIELDS = {
    "Article": ("headline",), "NewsArticle": ("headline",), "BlogPosting": ("headline",), "Product": ("name",), "Recipe": ("name", "image"), "Event": ("name", "startDate", "location"),
    "JobPosting": ("title", "datePosted", "hiringOrganization"), "LocalBusiness": ("name", "address"), "Organization": ("name",), "BreadcrumbList": ("itemListElement",),
    "VideoObject": ("name", "thumbnailUrl", "uploadDate"), "SoftwareApplication": ("name",), "Course": ("name",),
}
DEPRECATED_TYPES = ("FAQPage", "HowTo")
#: Keywords that are sent to every executor at most, to stand beside each site.
KEYWORDS = 100_000
_ROWS = {"ALL": "true", "HTML": "is_html and is_ok", "IDX": "is_indexable"}


@dataclass(frozen=True)
class Rule:
    """A predicate on a page; ``emitted`` says from a site's hits (n), html pages, indexable pages and all pages whether it counts."""

    id: str
    severity: str
    category: str
    rows: str
    when: Callable[[], Column]
    emitted: Callable[[Column, dict[str, Column]], Column] | None = None


def _lower_src(i: Column) -> Column:
    return F.lower(F.substring_index(i["src"], "?", 1))


def _ends(text: Column, endings: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.endswith(e) for e in endings))


def _h1s() -> Column:
    return F.filter("headings", lambda h: h["level"] == 1)


def _path() -> Column:
    return url_parts(F.col("url"))["path"]


def _header(name: str) -> Column:
    return F.coalesce(F.element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), F.lit(name)), F.lit(""))


def _jump() -> Column:
    levels = F.transform("headings", lambda h: h["level"])
    pairs = F.zip_with(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b - a)
    return F.exists(pairs, lambda d: d > 1)


def _title() -> Column:
    return F.trim(F.coalesce("title", F.lit("")))


def _description() -> Column:
    return F.trim(F.coalesce("meta_description", F.lit("")))


def _has(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(pattern)


def _first_paragraph_words() -> Column:
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<p[^>]*>(.*?)</p>", 1), r"<[^>]+>", " "), r"\s+", " "))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, " ")))


def _own(target: Column) -> Column:
    return normalize_url(target) == normalize_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))


def _mixed() -> Column:
    found = F.regexp_extract_all("html", F.lit(r"(?i)(?:src|href)=[\"'](http://[^\"']+)"), F.lit(1))
    return F.size(F.filter(found, lambda u: ~u.contains("localhost") & ~u.contains("127.0.0.1") & ~u.contains("schema.org"))) > 0


_status = lambda: F.col("status_code")
_words = lambda: F.col("words")
_ok_page = lambda: F.col("error").isNull()

PAGE_RULES = (
    Rule("server-error", "critical", "technical", "ALL", lambda: _ok_page() & (_status() >= 500)),
    Rule("broken-internal-links", "high", "links", "ALL", lambda: _ok_page() & _status().isin(404, 410)),
    Rule("forbidden-pages", "high", "indexing", "ALL", lambda: _ok_page() & _status().isin(401, 403)),
    Rule("unreachable-pages", "critical", "technical", "ALL", lambda: F.col("error").isNotNull()),
    Rule("redirect-chain", "medium", "technical", "ALL", lambda: F.size("redirect_chain") > 1),
    Rule("temporary-redirect", "medium", "technical", "ALL", lambda: F.exists("redirect_chain", lambda h: h["code"].isin(302, 307))),
    Rule("mixed-content", "high", "technical", "HTML", lambda: F.col("https") & _mixed()),
    Rule("viewport-missing", "critical", "technical", "HTML", lambda: F.coalesce("viewport", F.lit("")) == ""),
    Rule("viewport-invalid", "medium", "technical", "HTML", lambda: (F.coalesce("viewport", F.lit("")) != "") & (~F.lower("viewport").contains("width=device-width") | _has("viewport", r"(?i)user-scalable=no|maximum-scale=1(\.0)?\b"))),
    Rule("url-too-long", "low", "technical", "IDX", lambda: F.length("url") > 115),
    Rule("url-underscores", "low", "technical", "IDX", lambda: _path().contains("_")),
    Rule("url-uppercase", "low", "technical", "IDX", lambda: _path().rlike(r"\p{Lu}")),
    Rule("url-parameters", "medium", "indexing", "IDX", lambda: (url_parts(F.col("url"))["query"] != "") & (F.size(F.split(url_parts(F.col("url"))["query"], "&")) >= 3)),
    Rule("html-lang-missing", "medium", "international", "HTML", lambda: F.coalesce("lang", F.lit("")) == ""),
    Rule("charset-missing", "medium", "technical", "HTML", lambda: (F.coalesce("charset", F.lit("")) == "") & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("charset") & ~F.lower(_header("content-type")).contains("charset")),
    Rule("no-compression", "medium", "performance", "HTML", lambda: (_header("content-encoding") == "") & (F.col("byte_size") > 50_000)),
    Rule("noindex-pages", "info", "indexing", "HTML", lambda: F.col("is_noindex"), lambda n, s: n < s["html"]),
    Rule("site-wide-noindex", "critical", "indexing", "HTML", lambda: F.col("is_noindex"), lambda n, s: n == s["html"]),
    Rule("soft-404", "medium", "indexing", "HTML", lambda: (_status() == 200) & (_words() <= 250) & F.concat_ws(" ", "title", F.transform(_h1s(), lambda h: h["text"])).rlike(SOFT_404)),
    Rule("crawl-budget-waste", "medium", "indexing", "ALL", lambda: (F.size("redirect_chain") > 0) | (F.expr(_ROWS["HTML"]) & F.col("is_noindex")) | (_status() >= 400), lambda n, s: (s["pages"] >= 10) & (n > 0.25 * s["pages"])),
    Rule("title-missing", "critical", "content", "IDX", lambda: _title() == ""),
    Rule("title-too-short", "medium", "content", "IDX", lambda: (_title() != "") & (F.length(_title()) < TITLE_MIN)),
    Rule("title-too-long", "low", "content", "IDX", lambda: F.length(_title()) > TITLE_MAX),
    Rule("meta-description-missing", "medium", "content", "IDX", lambda: _description() == ""),
    Rule("meta-description-short", "low", "content", "IDX", lambda: (_description() != "") & (F.length(_description()) < DESC_MIN)),
    Rule("meta-description-long", "low", "content", "IDX", lambda: F.length(_description()) > DESC_MAX),
    Rule("canonical-missing", "medium", "indexing", "IDX", lambda: F.col("canonical").isNull()),
    Rule("canonical-external", "critical", "indexing", "IDX", lambda: F.col("canonical").isNotNull() & ~is_internal(F.col("canonical"), F.col("url"), True)),
    Rule("og-missing", "low", "content", "IDX", lambda: F.element_at("og", F.lit("og:title")).isNull() & F.element_at("og", F.lit("og:description")).isNull()),
    Rule("og-image-missing", "low", "content", "IDX", lambda: (F.element_at("og", F.lit("og:title")).isNotNull() | F.element_at("og", F.lit("og:description")).isNotNull()) & F.element_at("og", F.lit("og:image")).isNull()),
    Rule("h1-missing", "high", "content", "IDX", lambda: F.size(_h1s()) == 0),
    Rule("h1-multiple", "low", "content", "IDX", lambda: F.size(_h1s()) > 1),
    Rule("h1-empty", "medium", "content", "IDX", lambda: (F.size(_h1s()) == 1) & (F.length(F.trim(F.get(_h1s(), F.lit(0))["text"])) < 3)),
    Rule("heading-order", "low", "content", "IDX", _jump),
    Rule("no-subheadings", "medium", "ai_search", "IDX", lambda: (_words() > 600) & ~F.exists("headings", lambda h: h["level"] == 2)),
    Rule("thin-content", "high", "content", "IDX", lambda: _words() < 300),
    Rule("shallow-content", "low", "content", "IDX", lambda: (_words() >= 300) & (_words() < 600)),
    Rule("no-publish-date", "medium", "eeat", "IDX", lambda: (_words() >= 400) & ~F.lower("html").rlike("<time|article:published_time|datepublished|datemodified")),
    Rule("no-structured-data", "high", "structured_data", "IDX", lambda: (F.size("jsonld") == 0) & (F.size("microdata") == 0), lambda n, s: n == s["idx"]),
    Rule("structured-data-partial", "medium", "structured_data", "IDX", lambda: (F.size("jsonld") == 0) & (F.size("microdata") == 0), lambda n, s: (n < s["idx"]) & (n > 0.5 * s["idx"])),
    Rule("jsonld-invalid", "high", "structured_data", "HTML", lambda: F.exists("jsonld", lambda x: F.try_parse_json(x).isNull())),
    Rule("orphan-pages", "high", "links", "IDX", lambda: (F.col("inlinks") == 0) & (F.col("url") != F.col("start_url")), lambda n, s: s["idx"] >= 3),
    Rule("weak-internal-linking", "medium", "links", "IDX", lambda: (F.col("inlinks") == 1) & (F.col("url") != F.col("start_url")), lambda n, s: (s["idx"] >= 3) & (n > 0.3 * s["idx"])),
    Rule("deep-pages", "medium", "links", "IDX", lambda: F.col("depth") >= 4),
    Rule("empty-anchor-text", "low", "links", "HTML", lambda: F.exists("links", lambda x: x["internal"] & (F.trim(x["anchor"]) == ""))),
    Rule("js-navigation", "high", "links", "HTML", lambda: _has("html", JS_LINK)),
    Rule("unsafe-target-blank", "low", "links", "HTML", lambda: F.col("html").contains('target="_blank"') & F.exists("links", lambda x: ~x["internal"] & ~F.lower(x["rel"]).contains("noopener")), lambda n, s: n > 2),
    Rule("image-alt-missing", "medium", "images", "HTML", lambda: F.exists("images", lambda i: i["alt"].isNull())),
    Rule("image-alt-too-long", "low", "images", "HTML", lambda: F.exists("images", lambda i: F.length(F.coalesce(i["alt"], F.lit(""))) > 125)),
    Rule("image-no-dimensions", "medium", "performance", "HTML", lambda: F.exists("images", lambda i: (i["src"] != "") & (i["width"].isNull() | i["height"].isNull()) & ~F.lower(i["src"]).endswith(".svg"))),
    Rule("lcp-image-lazy", "medium", "performance", "HTML", lambda: F.exists(F.slice("images", 1, 3), lambda i: F.lower(F.coalesce(i["loading"], F.lit(""))) == "lazy")),
    Rule("no-lazy-loading", "low", "performance", "HTML", lambda: F.size(F.filter(F.slice("images", 4, 1_000_000), lambda i: i["loading"].isNull())) >= 5),
    Rule("legacy-image-format", "medium", "performance", "HTML", lambda: (F.size(F.filter("images", lambda i: _ends(_lower_src(i), LEGACY_IMAGES))) >= 3) & ~F.exists("images", lambda i: _ends(_lower_src(i), MODERN_IMAGES)) & ~F.lower("html").rlike("<picture|srcset")),
    Rule("image-filename", "low", "images", "HTML", lambda: F.exists("images", lambda i: F.substring_index(url_parts(i["src"])["path"], "/", -1).rlike(IMAGE_NAME))),
    Rule("heavy-html", "medium", "performance", "HTML", lambda: F.col("byte_size") > 500_000),
    Rule("slow-response", "high", "performance", "HTML", lambda: F.col("elapsed_ms") > 800),
    Rule("too-many-scripts", "medium", "performance", "HTML", lambda: F.col("external_scripts") > 15),
    Rule("large-inline-script", "low", "performance", "HTML", lambda: F.col("inline_script_bytes") > 100_000),
    Rule("render-blocking-resources", "medium", "performance", "HTML", lambda: F.col("blocking_scripts") + F.col("blocking_styles") >= 4),
    Rule("no-author-byline", "medium", "eeat", "IDX", lambda: (_words() >= 500) & ~_has("html", AUTHOR), lambda n, s: (s["w500"] >= 2) & (n >= F.greatest(F.lit(2.0), 0.5 * s["w500"]))),
    Rule("no-external-citations", "low", "eeat", "IDX", lambda: (_words() >= 700) & ~F.exists("links", lambda x: ~x["internal"]), lambda n, s: (s["w700"] >= 2) & (n >= F.greatest(F.lit(2.0), 0.6 * s["w700"]))),
    Rule("hreflang-invalid-code", "high", "international", "HTML", lambda: F.exists("hreflang", lambda h: (F.lower(h["code"]) != "x-default") & ~h["code"].rlike(HREFLANG))),
    Rule("hreflang-no-self", "high", "international", "HTML", lambda: (F.size("hreflang") > 0) & ~F.exists("hreflang", lambda h: _own(h["href"]))),
    Rule("hreflang-no-x-default", "medium", "international", "HTML", lambda: (F.size("hreflang") > 0) & ~F.exists("hreflang", lambda h: F.lower(h["code"]) == "x-default"), lambda n, s: n == s["hreflang"]),
    Rule("missing-rtl-direction", "medium", "international", "HTML", lambda: F.substring("text", 1, 2000).rlike("[؀-ۿ]") & ~F.lower(F.substring("html", 1, 3000)).rlike("dir=[\"']rtl[\"']") & ~F.regexp_replace(F.lower(F.substring("html", 1, 3000)), " ", "").contains("direction:rtl")),
    Rule("no-question-headings", "medium", "ai_search", "IDX", lambda: (_words() >= 400) & F.exists("headings", lambda h: h["level"].isin(2, 3)) & ~F.exists("headings", lambda h: h["level"].isin(2, 3) & h["text"].rlike(QUESTION))),
    Rule("buried-answer", "medium", "ai_search", "IDX", lambda: (_words() >= 400) & (_first_paragraph_words() > 120)),
    Rule("no-lists-or-tables", "low", "ai_search", "IDX", lambda: (_words() >= 400) & ~_has("html", r"(?i)<(ul|ol|table)\b"), lambda n, s: n > 0.6 * s["w400"]),
    Rule("client-side-rendered", "high", "ai_search", "HTML", lambda: (_words() < 50) & (F.col("external_scripts") >= 1) & (F.col("byte_size") > 2000)),
)

_HIT = ["site", "issue_id", "severity", "category", "url"]
Frames = dict[str, DataFrame]
REGISTRY: dict[str, Callable[[Frames], DataFrame]] = {}


def rule(name: str):
    """Register a function of the frames ``pages`` and ``sites`` that returns hits: site, issue_id, severity, category, url."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def _hits(df: DataFrame, issue: str, severity: str, category: str, url: Column | None = None) -> DataFrame:
    return df.select("site", F.lit(issue).alias("issue_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), (F.col("url") if url is None else url).alias("url"))


def site_counts(pages: DataFrame) -> DataFrame:
    idx = F.expr(_ROWS["IDX"])
    return pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.expr(_ROWS["HTML"])).alias("html"), F.count_if(idx).alias("idx"), F.count_if(F.expr(_ROWS["HTML"]) & (F.size("hreflang") > 0)).alias("hreflang"),
        *(F.count_if(idx & (F.col("words") >= n)).alias(f"w{n}") for n in (400, 500, 700)),
    )


@rule("pages")
def page_hits(frames: Frames, rules: tuple[Rule, ...] = PAGE_RULES) -> DataFrame:
    """Hits of all page rules in one scan; then the rules that depend on a site's share."""
    pages = frames["pages"]
    one = lambda r: F.when(F.expr(_ROWS[r.rows]) & F.coalesce(r.when(), F.lit(False)), F.struct(F.lit(r.id).alias("issue_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")))
    hits = pages.select("site", "url", F.inline(F.array_compact(F.array(*map(one, rules))))).select(*_HIT)
    shared = {r.id: r.emitted for r in rules if r.emitted}
    counted = hits.filter(F.col("issue_id").isin(*shared)).groupBy("site", "issue_id").agg(F.count(F.lit(1)).alias("_n")).join(site_counts(pages), "site")
    sizes = {c: F.col(c) for c in ("pages", "html", "idx", "hreflang", "w400", "w500", "w700")}
    fits = reduce(lambda a, b: a | b, ((F.col("issue_id") == i) & f(F.col("_n"), sizes) for i, f in shared.items()), F.lit(False))
    failed = counted.filter(~fits).select("site", "issue_id")
    return hits.join(failed, ["site", "issue_id"], "left_anti").select(*_HIT)


@rule("duplicates")
def duplicate_hits(frames: Frames) -> DataFrame:
    idx = frames["pages"].filter(_ROWS["IDX"])

    def shared(df: DataFrame, key: Column, issue: str, severity: str, category: str) -> DataFrame:
        keyed = df.withColumn("_k", key)
        many = keyed.groupBy("site", "_k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("site", "_k")
        return _hits(keyed.join(many, ["site", "_k"], "left_semi"), issue, severity, category)

    return (
        shared(idx.filter(_title() != ""), F.lower(_title()), "title-duplicate", "high", "content")
        .unionByName(shared(idx.filter(_description() != ""), F.lower(_description()), "meta-description-duplicate", "low", "content"))
        .unionByName(shared(idx.filter("words >= 100"), F.col("content_hash"), "duplicate-content", "high", "indexing"))
    )


@rule("stuffing")
def stuffing_hits(frames: Frames) -> DataFrame:
    dense = term_density(frames["pages"].filter(F.expr(_ROWS["IDX"]) & (F.col("words") >= 150)))
    return _hits(dense.filter((F.col("tokens") >= 80) & (F.col("density") > 0.06) & (F.col("hits") >= 15) & ~F.col("term").rlike(r"^[^\p{L}]+$")), "keyword-stuffing", "high", "content")


def _place(url: Column) -> Column:
    """Which page of its site a url is; a site's pages are the same by http and https."""
    return F.regexp_replace(normalize_url(url), "^https?://", "")


@rule("canonical")
def canonical_hits(frames: Frames) -> DataFrame:
    """Canonicals to noindex pages; only where a site has none of these, canonicals that differ from the page's own url."""
    pages = frames["pages"]
    other = pages.filter(F.expr(_ROWS["IDX"]) & F.col("canonical").isNotNull() & is_internal(F.col("canonical"), F.col("url"), True) & ~_own(F.col("canonical"))).withColumn("_c", _place(F.col("canonical")))
    hidden = pages.filter(F.expr(_ROWS["HTML"]) & F.col("is_noindex")).select("site", _place(F.coalesce(F.nullif("final_url", F.lit("")), "url")).alias("_c")).distinct()
    to_hidden = _hits(other.join(hidden, ["site", "_c"], "left_semi"), "canonical-to-noindex", "high", "indexing")
    rest = other.join(to_hidden.select("site").distinct(), "site", "left_anti")
    return to_hidden.unionByName(_hits(rest, "canonical-mismatch", "medium", "indexing"))


@rule("reciprocity")
def hreflang_hits(frames: Frames) -> DataFrame:
    """Pages whose alternates are crawled, have alternates and don't point back."""
    own = _place(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))
    html = frames["pages"].filter(F.expr(_ROWS["HTML"]) & (F.size("hreflang") > 0)).withColumn("_own", own)
    pairs = html.select("site", "url", "_own", F.explode("hreflang").alias("h")).select("site", "url", "_own", _place(F.col("h.href")).alias("_to")).filter("_own <> _to").distinct()
    known = html.select("site", F.col("_own").alias("_to")).distinct()
    back = pairs.select("site", F.col("_to").alias("_own"), F.col("_own").alias("_to"))
    missing = pairs.join(known, ["site", "_to"], "left_semi").join(back, ["site", "_own", "_to"], "left_anti")
    return _hits(missing.select("site", "url").distinct(), "hreflang-not-reciprocal", "high", "international")


@rule("anchors")
def anchor_hits(frames: Frames) -> DataFrame:
    inner = page_links(frames["pages"].filter(_ROWS["HTML"])).filter("internal")
    share = inner.groupBy("site").agg(F.avg(F.lower(F.trim("anchor")).isin(*GENERIC_ANCHORS).cast("int")).alias("share"))
    return _hits(share.filter("share > 0.1"), "generic-anchor-text", "medium", "links", F.lit(None).cast("string"))


@rule("trust")
def trust_hits(frames: Frames) -> DataFrame:
    """Sites without an about, contact or privacy page among the urls and internal links, or without social profiles."""
    pages = frames["pages"]
    links = page_links(pages.filter(_ROWS["HTML"]))
    seen = pages.select("site", F.col("url").alias("t")).unionByName(links.filter("internal").select("site", F.concat_ws(" ", "href", "anchor").alias("t")))
    found = seen.groupBy("site").agg(*(F.bool_or(F.col("t").rlike(p)).alias(k) for k, (_, p) in TRUST.items()))
    social = links.filter(~F.col("internal")).groupBy("site").agg(F.bool_or(F.lower("href").rlike("|".join(s.replace(".", r"\.") for s in SOCIAL))).alias("social"))
    rows = found.join(social, "site", "left").join(pages.filter(_ROWS["HTML"]).select("site").distinct(), "site", "left_semi")
    none = F.lit(None).cast("string")
    parts = [_hits(rows.filter(~F.col(k)), f"missing-{k}-page", s, "eeat", none) for k, (s, _) in TRUST.items()]
    return reduce(DataFrame.unionByName, [*parts, _hits(rows.filter(~F.coalesce("social", F.lit(False))), "no-social-profiles", "low", "eeat", none)])


@rule("structured")
def structured_hits(frames: Frames) -> DataFrame:
    """Blocks of JSON-LD: required fields, missing types, types that are no longer shown; types that a site lacks."""
    pages = frames["pages"].filter(_ROWS["HTML"])
    typed = jsonld_blocks(pages).filter("part <> 'error'")
    each = typed.select("site", "url", "block", F.explode("types").alias("type"))
    need = reduce(lambda a, b: a | b, ((F.col("type") == t) & reduce(lambda x, y: x | y, (F.coalesce(F.get_json_object("block", f"$.{f}"), F.lit("")).isin("", "[]", "{}", "0", "false", "null") for f in fields)) for t, fields in REQUIRED_FIELDS.items()))
    none = F.lit(None).cast("string")
    kinds = each.select("site", "type").unionByName(pages.select("site", F.explode("microdata").alias("type"))).groupBy("site").agg(F.collect_set("type").alias("types"))
    lacking = kinds.join(site_counts(frames["pages"]).select("site", "idx"), "site")
    organisations = F.array(*map(F.lit, ("Organization", "LocalBusiness", "Person", "Corporation", "EducationalOrganization", "OnlineStore")))
    return reduce(DataFrame.unionByName, (
        _hits(each.filter(need).select("site", "url").distinct(), "schema-missing-required", "medium", "structured_data"),
        _hits(typed.filter(F.size("types") == 0).select("site", "url").distinct(), "schema-no-type", "medium", "structured_data"),
        _hits(each.filter(F.col("type").isin(*DEPRECATED_TYPES)).select("site", "url").distinct(), "schema-deprecated-type", "info", "structured_data"),
        _hits(lacking.filter(~F.arrays_overlap("types", organisations)), "no-organization-schema", "medium", "eeat", none),
        _hits(lacking.filter(~F.array_contains("types", "BreadcrumbList") & (F.col("idx") > 3)), "no-breadcrumb-schema", "low", "structured_data", none),
    ))


def robots_lines(robots: Column) -> Column:
    return F.transform(F.split(F.lower(robots), r"\r?\n|\r"), lambda r: F.trim(F.substring_index(r, "#", 1)))


def _fold(robots: Column, reset_on_blank: bool) -> Column:
    """Agents that ``disallow: /`` applies to. One fold starts a new group at a blank line, the other at any other directive."""
    after = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    empty = F.array().cast("array<string>")

    def turn(at: Column, x: Column) -> Column:
        state = lambda a, b: F.struct(a.alias("agents"), b.alias("blocked"))
        agents, blocked = at["agents"], at["blocked"]
        found = F.when(x.startswith("user-agent:"), state(F.concat(agents, F.array(after(x))), blocked)).when(x.startswith("disallow:"), state(agents, F.when(after(x) == "/", F.concat(blocked, agents)).otherwise(blocked)))
        if reset_on_blank:
            return found.when(x == "", state(empty, blocked)).otherwise(at)
        return found.when((x == "") | x.startswith("allow:"), at).otherwise(state(empty, blocked))

    return F.aggregate(robots_lines(robots), F.struct(empty.alias("agents"), empty.alias("blocked")), turn, lambda at: at["blocked"])


def blocks_site(robots: Column) -> Column:
    return F.exists(_fold(robots, False), lambda a: a.isin("*", "googlebot"))


def blocked_ai_crawlers(robots: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_fold(robots, True), lambda a: a.isin(*AI_CRAWLERS))))


@rule("sites")
def site_hits(frames: Frames) -> DataFrame:
    """Rules on a site's robots.txt, origin, first headers and flags. ``sites``: site, start_url, robots_txt, llms_txt, security_txt."""
    pages = frames["pages"]
    head = pages.groupBy("site").agg(F.min_by("headers", F.struct("crawl_seq", "url")).alias("headers"), F.bool_or(F.expr(_ROWS["HTML"])).alias("any_html"))
    s = frames["sites"].join(head, "site", "left")
    robots, https = F.col("robots_txt"), F.lower(url_parts(F.col("start_url"))["scheme"]) == "https"
    local = host_of(F.col("start_url")).rlike(r"^(localhost|127\.0\.0\.1|0\.0\.0\.0)(:|$)")
    headers = F.coalesce(F.size("headers"), F.lit(0)) > 0
    mentioned = F.lower(F.coalesce(robots, F.lit(""))).rlike("|".join(AI_CRAWLERS))
    none = F.lit(None).cast("string")
    tests = (
        ("no-https", "critical", "technical", ~https & ~local),
        ("no-hsts", "low", "technical", https & headers & (_header("strict-transport-security") == "")),
        ("robots-missing", "low", "indexing", robots.isNull()),
        ("robots-blocks-site", "critical", "indexing", blocks_site(robots)),
        ("robots-no-sitemap", "low", "indexing", ~F.lower(robots).contains("sitemap:")),
        ("robots-blocks-assets", "high", "indexing", F.lower(robots).rlike(r"disallow:\s*/?.*\.(css|js)\b|(?m)disallow:\s*/(wp-content|assets|static|dist)/?\s*$")),
        ("no-cache-headers", "low", "performance", headers & ((_header("cache-control") == "") | _header("cache-control").contains("no-store"))),
        ("no-security-txt", "info", "eeat", ~F.coalesce("security_txt", F.lit(False))),
        ("no-llms-txt", "info", "ai_search", ~F.coalesce("llms_txt", F.lit(False))),
        ("ai-crawlers-blocked", "info", "ai_search", F.size(blocked_ai_crawlers(robots)) > 0),
        ("ai-crawler-policy-undefined", "info", "ai_search", robots.isNotNull() & ~mentioned),
    )
    each = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(i).alias("issue_id"), F.lit(v).alias("severity"), F.lit(c).alias("category"))) for i, v, c, t in tests)))
    return s.select("site", F.inline(each)).withColumn("url", none).select(*_HIT)


@rule("robots_conflicts")
def conflict_hits(frames: Frames) -> DataFrame:
    """Noindex pages whose path the site's robots file closes, for whichever agent."""
    lines = frames["sites"].select("site", F.explode(robots_lines(F.col("robots_txt"))).alias("line")).filter(F.col("line").startswith("disallow:"))
    rules = lines.select("site", F.lit("disallow").alias("directive"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    pages = frames["pages"].filter(_ROWS["HTML"]).select("site", "url", url_parts(F.col("url"))["path"].alias("path"), "is_noindex")
    return _hits(noindex_blocked(pages, rules), "noindex-blocked-by-robots", "high", "indexing")


@rule("external")
def external_hits(frames: Frames) -> DataFrame:
    """External links that were probed (``probes``: site, href, found_on, status, error) and failed; none without probes."""
    if "probes" not in frames:
        return _hits(frames["pages"].filter("false"), "broken-external-links", "medium", "links")
    return _hits(broken_external(frames["probes"]), "broken-external-links", "medium", "links", F.col("href"))


@rule("vitals")
def vital_hits(frames: Frames) -> DataFrame:
    """Field metrics and opportunities of page-speed answers (``vitals``: site, payload) for a site's start page; none without answers."""
    if "vitals" not in frames:
        return _hits(frames["pages"].filter("false"), "cwv-lcp", "medium", "performance")
    found = vitals_hits(*explode_vitals(frames["vitals"])).drop("url")
    return found.join(frames["sites"].select("site", F.col("start_url").alias("url")), "site").select(*_HIT)


#: Broken sitemap addresses that a hit of a site lists.
SITEMAP_ERRORS = 10


@rule("sitemaps")
def sitemap_hits(frames: Frames) -> DataFrame:
    """Pages held against the sitemap (site, loc); ``sitemap_errors`` of a site, if it has the column, are addresses that answered with HTML."""
    pages, none = frames["pages"], F.lit(None).cast("string")
    locs = frames["sitemap"].select("site", normalize_url(F.col("loc")).alias("_u")).distinct()
    keyed = pages.withColumn("_u", normalize_url(F.col("url")))
    known = frames["sites"].select("site").join(locs.select("site").distinct(), "site", "left_anti")
    bad = keyed.join(locs, ["site", "_u"], "left_semi").filter(F.col("error").isNotNull() | (F.col("status_code") >= 400) | (F.size("redirect_chain") > 0) | F.col("is_noindex"))
    absent = keyed.filter(_ROWS["IDX"]).join(locs.select("site").distinct(), "site", "left_semi").join(locs, ["site", "_u"], "left_anti")
    many = absent.groupBy("site").agg(F.count(F.lit(1)).alias("n")).join(site_counts(pages).select("site", "idx"), "site").filter(F.col("n") > F.greatest(F.lit(2.0), 0.2 * F.col("idx")))
    met = keyed.join(locs, ["site", "_u"], "left_semi").select("site").distinct()
    apart = locs.select("site").distinct().join(pages.select("site").distinct(), "site", "left_semi").join(met, "site", "left_anti")
    errors = F.col("sitemap_errors") if "sitemap_errors" in frames["sites"].columns else F.array().cast("array<string>")
    invalid = frames["sites"].select("site", errors.alias("e")).join(locs.select("site").distinct(), "site", "left_semi").select("site", F.explode(F.slice("e", 1, SITEMAP_ERRORS)).alias("url"))
    return reduce(DataFrame.unionByName, (
        _hits(invalid, "sitemap-invalid", "medium", "indexing"), _hits(known, "sitemap-missing", "medium", "indexing", none), _hits(bad, "sitemap-bad-entries", "medium", "indexing"),
        _hits(absent.join(many, "site", "left_semi"), "sitemap-incomplete", "low", "indexing"), _hits(apart, "sitemap-mismatch", "medium", "indexing", none),
    ))


def keyword_usage(pages: DataFrame, keywords: DataFrame, every_site: bool = False) -> DataFrame:
    """Hits for target keywords (rows site, keyword; with ``every_site`` keywords that each site has): absent, weak (in no
    title or H1), cannibal (several titles). A page is read once, however many keywords there are.
    """
    idx = pages.filter(_ROWS["IDX"]).select("site", F.lower("text").alias("body"), F.lower(_title()).alias("title"), F.lower(F.array_join(F.transform(_h1s(), lambda h: h["text"]), "\n")).alias("h1"))
    kw = keywords.select(*([] if every_site else ["site"]), F.lower(F.trim("keyword")).alias("k")).filter("k <> ''").distinct()
    found = texts_with(idx, kw.select("k").distinct(), ("body", "title", "h1")).withColumnRenamed("keyword", "k")
    sites = idx.select("site").distinct()
    # every keyword of a site is a row of the result's own: one that no page has is a finding
    asked = sites.crossJoin(F.broadcast(kw)) if every_site and kw.count() <= KEYWORDS else sites.crossJoin(kw) if every_site else kw.join(sites, "site", "left_semi")
    rows = asked.join(found, ["site", "k"], "left").na.fill(0, ["body", "title", "h1"])
    suffix = (F.crc32(F.encode("k", "UTF-8")) % 1_000_000).cast("string")
    kind = F.array_compact(F.array(F.when(F.col("body") == 0, F.struct(F.lit("absent").alias("p"), F.lit("high").alias("severity"))), F.when((F.col("body") > 0) & (F.col("title") == 0) & (F.col("h1") == 0), F.struct(F.lit("weak").alias("p"), F.lit("medium").alias("severity"))), F.when(F.col("title") > 1, F.struct(F.lit("cannibal").alias("p"), F.lit("medium").alias("severity")))))
    return rows.select("site", "k", F.inline(kind)).select("site", F.concat(F.lit("keyword-"), "p", F.lit("-"), suffix).alias("issue_id"), "severity", F.lit("content").alias("category"), F.lit(None).cast("string").alias("url"), F.col("k").alias("keyword"), "p")


def ready(facts: DataFrame) -> DataFrame:
    """Page facts with inlinks (link tags), start_url and https of the site."""
    inner = page_links(facts).filter("internal").select("site", normalize_url(F.col("href")).alias("_u"))
    tags = inner.groupBy("site", "_u").agg(F.count(F.lit(1)).alias("inlinks"))
    start = facts.groupBy("site").agg(F.min_by("url", F.struct("crawl_seq", "url")).alias("start_url"))
    out = facts.withColumn("_u", normalize_url(F.coalesce(F.nullif("final_url", F.lit("")), "url"))).join(tags, ["site", "_u"], "left").join(start, "site")
    return out.withColumns({"inlinks": F.coalesce("inlinks", F.lit(0)), "https": F.lower("start_url").startswith("https://")}).drop("_u")


def run_all(frames: Frames, names: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """Hits of all registered rules in one frame, and notes on rules that can't be built; the others go on."""
    parts, notes = [], []
    for name, f in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            parts.append(f(frames))
        except Exception as e:  # a user's rule must not end the audit
            notes.append(f"{name}: {e}")
    return reduce(DataFrame.unionByName, parts), notes


def roll_up(hits: DataFrame, shown: int = 50, slices: int = 64) -> DataFrame:
    """One issue per site and id: affected pages (site rules count one) and the first urls.

    The first urls are found in slices of each issue and then among those, so that no task orders a whole issue.
    """
    keys = ["site", "issue_id", "severity", "category"]
    part = hits.withColumn("_s", F.pmod(F.xxhash64("url"), F.lit(slices)))
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected"))
    by_slice = Window.partitionBy(*keys, "_s").orderBy("url")
    few = part.filter("url is not null").withColumn("_k", F.row_number().over(by_slice)).filter(F.col("_k") <= shown)
    first = few.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("url"))).filter(F.col("_k") <= shown)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return counts.join(listed, keys, "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def _of(column: str, table: dict) -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in table.items()))


def with_labels(issues: DataFrame) -> DataFrame:
    """``issues`` with severity_label, category_label and category_name."""
    part = lambda k: _of("category", {c: v[k] for c, v in CATEGORY_LABEL.items()})
    return issues.withColumns({"severity_label": _of("severity", SEVERITY_LABEL), "category_label": part(0), "category_name": part(1)})


def penalties(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """Weight of the severity, scaled by the root of the share of html pages that are affected."""
    weight = _of("severity", {k: v[0] for k, v in SEVERITY.items()})
    share = F.least(F.lit(1.0), F.greatest(F.lit(1), F.col("affected")) / F.greatest(F.lit(1), F.col("html")))
    return issues.join(counts.select("site", "html"), "site").withColumn("penalty", F.when(weight == 0, 0.0).otherwise(weight * (0.55 + 0.45 * F.sqrt(share)))).drop("html")


def grade(score: Column) -> Column:
    out = F.lit(LOWEST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def active_categories(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Categories that are scored for a site: images only with images, international only with alternates or issues."""
    flags = pages.filter(_ROWS["HTML"]).groupBy("site").agg(F.bool_or(F.size("images") > 0).alias("images"), F.bool_or(F.size("hreflang") > 0).alias("hreflang"))
    foreign = issues.filter("category = 'international'").select("site", F.lit(True).alias("foreign")).distinct()
    rows = pages.select("site").distinct().join(flags, "site", "left").join(foreign, "site", "left")
    rows = rows.select("site", F.explode(F.array(*map(F.lit, CATEGORY_WEIGHT))).alias("category"), "images", "hreflang", "foreign")
    no = F.lit(False)
    return rows.filter(~F.col("category").isin(*OPTIONAL) | ((F.col("category") == "images") & F.coalesce("images", no)) | ((F.col("category") == "international") & (F.coalesce("hreflang", no) | F.coalesce("foreign", no)))).select("site", "category")


def category_scores(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """site, category, score, issues (without notes), grade."""
    fined = penalties(issues, site_counts(pages)).groupBy("site", "category").agg(F.sum("penalty").alias("p"), F.count_if(F.col("severity") != "info").alias("issues"))
    rows = active_categories(pages, issues).join(fined, ["site", "category"], "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(100 - F.coalesce("p", F.lit(0.0)), 9)).cast("int")))
    return rows.withColumn("score", score).select("site", "category", "score", F.coalesce("issues", F.lit(0)).alias("issues"), grade(F.col("score")).alias("grade"))


def overall_scores(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Weighted mean of a site's category scores; at most 45 with a critical issue."""
    weight = _of("category", CATEGORY_WEIGHT).cast("decimal(4,1)")
    bad = issues.filter("severity = 'critical'").select("site", F.lit(True).alias("critical")).distinct()
    rows = scores.groupBy("site").agg((F.sum(F.col("score") * weight).cast("double") / F.sum(weight).cast("double")).alias("mean")).join(bad, "site", "left")
    score = F.bround(F.round("mean", 9)).cast("int")
    return rows.select("site", F.when(F.col("critical"), F.least(score, F.lit(45))).otherwise(score).alias("overall_score"))


def order_issues(issues: DataFrame) -> DataFrame:
    return issues.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(_of("severity", {k: v[1] for k, v in SEVERITY.items()}), F.desc("affected"), "issue_id")))


def quick_wins(issues: DataFrame, limit: int = 8) -> DataFrame:
    cheap = issues.filter(F.col("issue_id").isin(*QUICK) | F.col("severity").isin("critical", "high"))
    return order_issues(cheap).filter(F.col("place") <= limit)


def site_stats(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Headline counts and averages of each site; averages are cut to whole numbers."""
    words = F.avg(F.when(F.expr(_ROWS["IDX"]), F.col("words")))
    facts = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.count_if(F.expr(_ROWS["HTML"])).alias("html_pages"), F.count_if(F.expr(_ROWS["IDX"])).alias("indexable_pages"),
        F.count_if(F.col("error").isNotNull() | (F.col("status_code") >= 400)).alias("errors"), F.count_if(F.size("redirect_chain") > 0).alias("redirects"),
        F.coalesce(words, F.lit(0.0)).cast("int").alias("avg_words"), F.avg("elapsed_ms").cast("int").alias("avg_load_ms"),
    )
    totals = issues.groupBy("site").agg(F.count(F.lit(1)).alias("total_issues"), F.count_if(F.col("severity") == "critical").alias("critical_count"), F.count_if(F.col("severity") == "high").alias("high_count"))
    return facts.join(totals, "site", "left").na.fill(0, ["total_issues", "critical_count", "high_count"])


def by_category(issues: DataFrame) -> DataFrame:
    """Issues of each site by category; 0 where there are none."""
    return issues.groupBy("site").pivot("category", list(CATEGORY_WEIGHT)).agg(F.count(F.lit(1))).na.fill(0)


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site").pivot("severity", list(SEVERITY)).agg(F.count(F.lit(1))).na.fill(0)
