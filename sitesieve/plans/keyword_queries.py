"""Queries of keyword studies, coverage, rewrite plans and comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesieve.functions.shared import shared_folder
from sitesieve.functions.text import STOPWORDS, TOKEN_STOPWORDS, tokens_of, word_count
from sitesieve.operators import compare, coverage, keywords
from sitesieve.plans import bindings as b

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(column: str, terms) -> str:
    quoted = "|".join(t.replace("?", r"\?") for t in dict.fromkeys(terms))
    return f"regexp_matches({column}, '{quoted}')"


_STUDY = rf"""{b.SUGGESTIONS},
merged AS (SELECT seed, lower(trim(keyword)) AS key, min_by(trim(keyword), seq) AS keyword, list_sort(list(DISTINCT source)) AS sources, count(*) AS hits, least(min(position), 99) AS best_position, min(seq) AS seq
 FROM suggestions WHERE length(trim(keyword)) >= 2 GROUP BY 1, 2),
sc0 AS (SELECT *, len(regexp_extract_all(keyword, '[\p{{L}}\p{{N}}_]+')) AS words, CASE
  WHEN list_has_any(regexp_extract_all(lower(keyword), '[\p{{L}}\p{{N}}_]+'), list_filter(string_split(lower(seed), ' '), lambda t: length(t) > 3)) THEN 'navigational'
  WHEN {_any("lower(keyword)", keywords.LOCAL)} THEN 'local' WHEN {_any("lower(keyword)", keywords.TRANSACTIONAL)} THEN 'transactional' WHEN {_any("lower(keyword)", keywords.COMMERCIAL)} THEN 'commercial' ELSE 'informational' END AS intent,
  CAST(round_even(least(len(sources), 4)::DOUBLE / 4 * 40 + least(hits, 10)::DOUBLE / 10 * 35 + greatest(0.0::DOUBLE, (10 - least(best_position, 10))::DOUBLE / 10) * 25, 0) AS INTEGER) AS demand FROM merged),
scored AS (SELECT *, greatest(0, least(100, CAST(round_even(demand * 0.7::DOUBLE + least(words, 6)::DOUBLE / 6 * 30 - CASE WHEN words <= 2 THEN 15 ELSE 0 END, 0) AS INTEGER))) AS opportunity FROM sc0),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY demand DESC, hits DESC, keyword) AS rank FROM scored) WHERE rank <= {keywords.RANKED})"""
_S = f"WITH {_STUDY}"


def _scored(spark, d):
    return keywords.scored(keywords.merge_suggestions(b.suggestions(spark, d)))


def _ranked(spark, d):
    """Written once, as clusters read them several times."""
    shared_folder(spark)
    return keywords.rank_keywords(_scored(spark, d)).checkpoint()


@query(f"{_S} SELECT seed, key, keyword, array_to_string(sources, ',') AS sources, hits, best_position FROM merged")
def suggestion_dedup(spark, d):
    return keywords.merge_suggestions(b.suggestions(spark, d)).select("seed", "key", "keyword", F.array_join("sources", ",").alias("sources"), "hits", "best_position")


@query(f"{_S} SELECT seed, keyword, demand FROM scored")
def demand_score(spark, d):
    return _scored(spark, d).select("seed", "keyword", "demand")


@query(f"{_S} SELECT seed, keyword, opportunity FROM scored")
def opportunity_score(spark, d):
    return _scored(spark, d).select("seed", "keyword", "opportunity")


@query(f"{_S} SELECT seed, keyword, words, words >= 4 AS long_tail FROM scored")
def keyword_features(spark, d):
    return _scored(spark, d).select("seed", "keyword", "words", "long_tail")


@query(f"{_S} SELECT seed, keyword, intent FROM scored")
def classify_intent(spark, d):
    return _scored(spark, d).select("seed", "keyword", "intent")


@query(f"{_S} SELECT seed, intent, count(*) AS keywords FROM scored GROUP BY 1, 2")
def intent_breakdown(spark, d):
    return keywords.by_intent(_scored(spark, d))


@query(f"{_S} SELECT seed, keyword, rank FROM ranked")
def keyword_rank(spark, d):
    return _ranked(spark, d).select("seed", "keyword", "rank")


@query(f"{_S} SELECT seed, keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank) AS k FROM ranked WHERE {_any('lower(keyword)', keywords.QUESTION_MARKERS)}) WHERE k <= 40")
def questions_topk(spark, d):
    return keywords.questions(_ranked(spark, d))


@query(f"{_S}, f AS (SELECT *, row_number() OVER (PARTITION BY seed, lower(trim(keyword)) ORDER BY rank) AS k FROM ranked) SELECT seed, place, keyword FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank) AS place FROM f WHERE k = 1) WHERE place <= 10")
def keywords_to_track(spark, d):
    return keywords.keywords_to_track(_ranked(spark, d))


_LABELS = rf"""tok AS (SELECT seed, keyword, t, min(pos) AS pos FROM (SELECT seed, keyword, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos, lower(seed) AS s FROM (SELECT *, regexp_extract_all(lower(keyword), '[\p{{L}}\p{{N}}_]+') AS ts FROM ranked))
 WHERE length(t) > 1 AND t NOT IN ({_list(TOKEN_STOPWORDS)}) AND NOT list_contains(string_split(s, ' '), t) GROUP BY 1, 2, 3),
freq AS (SELECT seed, t, count(*) AS f FROM tok GROUP BY 1, 2), n AS (SELECT seed, count(*) AS n FROM ranked GROUP BY 1),
lab AS (SELECT seed, keyword, t AS label FROM (SELECT tok.*, row_number() OVER (PARTITION BY seed, keyword ORDER BY (f >= 2 AND f <= n * 0.6) DESC, f DESC, length(t), pos) AS k FROM tok JOIN freq USING (seed, t) JOIN n USING (seed)) WHERE k = 1),
lk AS (SELECT r.*, coalesce(label, r.seed) AS label FROM ranked r LEFT JOIN lab USING (seed, keyword)),
ic AS (SELECT seed, label, intent, count(*) AS n, min((-demand, rank)) AS first FROM lk GROUP BY 1, 2, 3),
im AS (SELECT seed, label, min_by(intent, (-n, first)) AS intent FROM ic GROUP BY 1, 2),
cg AS (SELECT seed, label, count(*) AS size, CAST(round_even(avg(demand), 0) AS INTEGER) AS avg_demand, list(keyword ORDER BY demand DESC, rank) AS kws, min(rank) AS first FROM lk GROUP BY 1, 2),
cl AS (SELECT * FROM (SELECT cg.*, im.intent, row_number() OVER (PARTITION BY seed ORDER BY size DESC, avg_demand DESC, first) AS place FROM cg JOIN im USING (seed, label)) WHERE place <= {keywords.CLUSTERS})"""


@query(f"{_S}, {_LABELS} SELECT seed, keyword, label FROM lk")
def topic_cluster(spark, d):
    return keywords.cluster_labels(_ranked(spark, d)).select("seed", "keyword", "label")


@query(f"{_S}, {_LABELS} SELECT seed, place, label, size, intent, avg_demand, kws[1] AS primary, array_to_string(kws[1:25], '|') AS keywords FROM cl")
def cluster_aggregate(spark, d):
    return keywords.cluster(_ranked(spark, d)).withColumn("keywords", F.array_join("keywords", "|"))


def _plan_case(k: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN '{row[k]}'" for i, row in keywords.PLANS.items()) + f" ELSE '{keywords.PLANS['informational'][k]}' END"


@query(f"{_S}, {_LABELS} SELECT seed, place, kws[1] AS primary_keyword, {_plan_case(0)} AS page_type, {_plan_case(1)} AS must_include, array_to_string(kws[2:8], '|') AS supporting_keywords, size AS cluster_size, replace({_plan_case(2)}, '%s', kws[1]) AS suggested_title FROM cl WHERE place <= 10")
def content_plan(spark, d):
    return keywords.content_plan(keywords.cluster(_ranked(spark, d))).withColumn("supporting_keywords", F.array_join("supporting_keywords", "|"))


def _expansion_sql() -> str:
    from sitesieve.operators.keywords import COMMERCIAL_EN, COMPARISON_EN, INFORMATIONAL_EN, LATIN_ALPHABET, LOCAL_EN, QUESTIONS_EN, TIME_EN

    shapes = ["s", *(f"'{w} ' || s" for w in QUESTIONS_EN)]
    for w in (*COMMERCIAL_EN, *INFORMATIONAL_EN):
        shapes += [f"s || ' {w}'", f"'{w} ' || s"]
    shapes += [f"s || ' {w}'" for w in (*LOCAL_EN, *TIME_EN, *COMPARISON_EN, *LATIN_ALPHABET)]
    return ", ".join(shapes)


@query(f"WITH {b.KEYWORDS} SELECT s AS seed, q AS query, min(k) - 1 AS seq FROM (SELECT s, unnest(a) AS q, generate_subscripts(a, 1) AS k FROM (SELECT s, [{_expansion_sql()}] AS a FROM (SELECT DISTINCT trim(keyword) AS s FROM keywords) WHERE s <> '')) GROUP BY 1, 2")
def query_expansion_union(spark, d):
    return keywords.build_queries(b.keywords(spark, d).select(F.col("keyword").alias("seed")))


@query(rf"WITH {b.SUGGESTIONS} SELECT DISTINCT keyword, len(list_filter(regexp_extract_all(lower(keyword), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({_list(TOKEN_STOPWORDS)}))) AS n_tokens, len(regexp_extract_all(keyword, '[\p{{L}}\p{{N}}_]+')) AS n_words FROM suggestions")
def tokens_of_keywords(spark, d):
    return b.suggestions(spark, d).select("keyword").distinct().select("keyword", F.size(tokens_of(F.col("keyword"))).alias("n_tokens"), word_count(F.col("keyword")).alias("n_words"))


# coverage


def _words(x: str) -> str:
    """Words as the operators fold them; of what the tables hold, case folding differs from lower case in one letter."""
    return rf"list_filter(string_split(trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_list(STOPWORDS)}))"


_DECLARED = "coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(h1, '')"
_COVER = f"""{b.PAGE_ROWS}, {b.KEYWORDS}, kt AS (SELECT *, {_words("keyword")} AS t FROM keywords), pt AS (SELECT site, url, words, title, list_distinct({_words(_DECLARED)}) AS t FROM page_rows WHERE indexable),
pairs AS (SELECT site, url, title, words, keyword, demand, intent, seq, len(kt.t) AS n, len(list_filter(kt.t, lambda x: list_contains(pt.t, x))) AS hits FROM pt, kt WHERE len(kt.t) > 0),
matched AS (SELECT * FROM pairs WHERE hits::DOUBLE / n >= 0.67)"""
_M = f"WITH {_COVER}"


def _tables(spark, d):
    pages, words = b.page_rows(spark, d), b.keywords(spark, d)
    return pages, words, coverage.match(pages, words)


@query(f"{_M} SELECT site, url, keyword, demand, intent FROM matched")
def overlap_join_keyword_page(spark, d):
    return _tables(spark, d)[2]


@query(f"WITH {b.PAGE_ROWS} SELECT url, rtrim({_DECLARED}, ' ') AS declared FROM page_rows")
def declared_text(spark, d):
    return b.page_rows(spark, d).select("url", F.rtrim(coverage.declared()).alias("declared"))


@query(f"{_M} SELECT s.site, k.keyword, demand, intent FROM (SELECT DISTINCT site FROM page_rows) s, keywords k WHERE (s.site, k.keyword) NOT IN (SELECT (site, keyword) FROM matched) QUALIFY row_number() OVER (PARTITION BY s.site ORDER BY demand DESC, k.keyword) <= 25")
def gaps_topk(spark, d):
    pages, words, matched = _tables(spark, d)
    return coverage.gaps(pages, words, matched)


@query(f"""{_M}, g AS (SELECT site, keyword, count(*) AS count, list(url ORDER BY words DESC, url) AS u FROM matched GROUP BY 1, 2 HAVING count(*) > 1)
SELECT site, keyword, count, array_to_string(u[1:5], ' ') AS pages FROM g QUALIFY row_number() OVER (PARTITION BY site ORDER BY count DESC, keyword) <= 25""")
def cannibalisation_topk(spark, d):
    pages, _, matched = _tables(spark, d)
    return coverage.cannibalisation(pages, matched).withColumn("pages", F.array_join("pages.url", " "))


@query(f"{_M} SELECT site, url, title, words FROM page_rows p WHERE indexable AND url NOT IN (SELECT url FROM matched) QUALIFY row_number() OVER (PARTITION BY site ORDER BY seq) <= 25")
def untargeted_topk(spark, d):
    pages, _, matched = _tables(spark, d)
    return coverage.untargeted(pages, matched)


@query(f"""{_M} SELECT p.site, count(*) AS pages, count(*) FILTER (indexable) AS indexable_pages, (SELECT count(DISTINCT keyword) FROM keywords) AS keywords, coalesce(max(c), 0) AS covered,
 round_even(coalesce(max(c), 0)::DOUBLE / (SELECT count(DISTINCT keyword) FROM keywords) * 100, 1) AS coverage FROM page_rows p LEFT JOIN (SELECT site, count(DISTINCT keyword) AS c FROM matched GROUP BY 1) m ON p.site = m.site GROUP BY 1""")
def coverage_rate(spark, d):
    return coverage.coverage(*_tables(spark, d))


_BEST = "best AS (SELECT site, url, max_by(keyword, (hits::DOUBLE / n, n, demand, -seq)) AS keyword, max_by(demand, (hits::DOUBLE / n, n, demand, -seq)) AS demand FROM pairs WHERE hits::DOUBLE / n >= 0.5 GROUP BY 1, 2)"


@query(f"{_M}, {_BEST} SELECT * FROM best")
def best_keyword_for_page(spark, d):
    return coverage.best_keyword(b.page_rows(spark, d), b.keywords(spark, d))


def _covers_sql(text: str) -> str:
    return f"(len({_words('keyword')}) > 0 AND len(list_filter({_words('keyword')}, lambda t: list_contains(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), t)))::DOUBLE / len({_words('keyword')}) >= 0.67)"


_PLAN = f"""{_BEST}, pp AS (SELECT p.site, p.url, trim(coalesce(title, ''), ' ') AS title, trim(coalesce(description, ''), ' ') AS description, trim(coalesce(h1, ''), ' ') AS h1, words, best.keyword, coalesce(best.demand, 0) AS demand FROM page_rows p LEFT JOIN best USING (site, url) WHERE indexable),
fx AS (SELECT *, CASE WHEN title = '' THEN 'missing' WHEN length(title) > 60 THEN 'too_long' WHEN keyword IS NOT NULL AND NOT {_covers_sql("title")} THEN 'missing_keyword' WHEN length(title) < 25 THEN 'too_short' END AS tp,
 CASE WHEN description = '' THEN 'missing' WHEN length(description) > 160 THEN 'too_long' WHEN length(description) < 70 THEN 'too_short' WHEN keyword IS NOT NULL AND NOT {_covers_sql("description")} THEN 'missing_keyword' END AS dp,
 CASE WHEN h1 = '' THEN 'missing' WHEN keyword IS NOT NULL AND NOT {_covers_sql("h1")} THEN 'missing_keyword' END AS hp FROM pp),
lst AS (SELECT *, list_filter([('title', tp), ('description', dp), ('h1', hp)], lambda f: f[2] IS NOT NULL) AS fixes FROM fx)"""


def _plans(spark, d):
    return coverage.page_plans(b.page_rows(spark, d), b.keywords(spark, d))


@query(f"{_M}, {_PLAN} SELECT site, url, keyword, demand, words, array_to_string(list_transform(fixes, lambda f: f[1] || ':' || f[2]), ' ') AS fixes FROM lst WHERE len(fixes) > 0")
def page_plan(spark, d):
    return _plans(spark, d).withColumn("fixes", F.array_join(F.transform("fixes", lambda f: F.concat_ws(":", f["field"], f["problem"])), " "))


@query(f"{_M}, {_PLAN} SELECT site, url, demand FROM lst WHERE len(fixes) > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY demand DESC, len(fixes) DESC, url) <= 5")
def plan_rank(spark, d):
    return coverage.rank_plans(_plans(spark, d)).select("site", "url", "demand")


@query(f"{_M}, {_PLAN} SELECT site, f[2] AS problem, count(*) AS fixes FROM (SELECT site, unnest(fixes) AS f FROM lst) GROUP BY 1, 2")
def problem_counts(spark, d):
    return coverage.problem_counts(_plans(spark, d))


@query(f"{_M}, {_PLAN} SELECT url, tp AS problem FROM fx WHERE tp IS NOT NULL")
def title_fix(spark, d):
    return _plans(spark, d).select("url", F.inline("fixes")).filter("field = 'title'").select("url", "problem")


@query(f"{_M}, {_PLAN} SELECT url, dp AS problem FROM fx WHERE dp IS NOT NULL")
def description_fix(spark, d):
    return _plans(spark, d).select("url", F.inline("fixes")).filter("field = 'description'").select("url", "problem")


@query(f"{_M}, {_PLAN} SELECT url, hp AS problem, CASE WHEN h1 = '' THEN nullif(title, '') END AS candidate FROM fx WHERE hp IS NOT NULL")
def h1_fix(spark, d):
    return _plans(spark, d).select("url", F.inline("fixes")).filter("field = 'h1'").select("url", "problem", "candidate")


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
_CUT = "CASE WHEN contains(substr(t, 1, 60), ' ') THEN regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') ELSE substr(t, 1, 60) END"


@query(rf"""SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE coalesce({", ".join(f"CASE WHEN length(trim(regexp_extract(t, '(?s)^(.*) {'[|]' if s == '|' else s} ', 1), ' ')) BETWEEN 1 AND 60 THEN trim(regexp_extract(t, '(?s)^(.*) {'[|]' if s == '|' else s} ', 1), ' ') END" for s in coverage.BRAND_SEPARATORS)},
 regexp_replace({_CUT}, '[ ،\-|–—:]+$', '')) END AS title FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)""")
def title_trim(spark, d):
    return b.read(spark, d, "documents").select("doc_id", coverage.trim_title(F.col("text")).alias("title"))


@query(f"{_M}, {_PLAN} SELECT url, coalesce(length(title) BETWEEN 25 AND 60 AND (keyword IS NULL OR {_covers_sql('title')}), false) AS accepted FROM pp")
def rewrite_acceptance(spark, d):
    pages = b.page_rows(spark, d)
    rows = pages.filter("indexable").select("site", "url", "title").join(coverage.best_keyword(pages, b.keywords(spark, d)), ["site", "url"], "left")
    return rows.select("url", coverage.accepts(F.trim(F.coalesce("title", F.lit(""))), F.col("keyword"), F.lit(25), F.lit(60)).alias("accepted"))


# comparison

_RATE = "round_even(avg(CAST({} AS INTEGER)) * 100, 1)"
_PROFILE = f"""prof AS (SELECT site, count(*) AS sampled, count(*) >= 5 AS comparable, {_RATE.format("trim(coalesce(title, ''), ' ') <> ''")} AS titled, {_RATE.format("length(coalesce(title, '')) BETWEEN 25 AND 60")} AS title_in_range,
 {_RATE.format("trim(coalesce(description, ''), ' ') <> ''")} AS described, {_RATE.format("trim(coalesce(h1, ''), ' ') <> ''")} AS has_h1, CAST(trunc(median(words)) AS INTEGER) AS median_words, {_RATE.format("words < 300")} AS thin,
 CAST(trunc(median(CASE WHEN h1 IS NULL THEN 0 ELSE 1 END)) AS INTEGER) AS median_headings FROM page_rows WHERE indexable GROUP BY site)"""
_P = f"WITH {b.PAGE_ROWS}, {_PROFILE}"
_V = "v AS (SELECT site, metric, yours, round_even(median(their), 1) AS competitor_median FROM (SELECT m.site, m.metric, m.value AS yours, o.value AS their FROM long m JOIN long o ON m.metric = o.metric AND m.site <> o.site WHERE m.site = 'src1' AND o.comparable) GROUP BY 1, 2, 3), w AS (SELECT *, round_even(yours - competitor_median, 1) AS difference FROM v), x AS (SELECT *, CASE WHEN abs(difference) < 10 THEN 'level' WHEN (metric <> 'thin') = (difference > 0) THEN 'ahead' ELSE 'behind' END AS verdict FROM w)"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT site, comparable, '{m}' AS metric, {m} AS value FROM prof" for m in compare.METRICS) + ")"


def _profiles(spark, d):
    return compare.profile(b.page_rows(spark, d))


def _verdicts(spark, d):
    p = _profiles(spark, d)
    return compare.rate_verdicts(p.filter("site = 'src1'"), p)


@query(f"{_P} SELECT * FROM prof")
def site_profile(spark, d):
    return _profiles(spark, d)


@query(f"{_P}, {_LONG}, {_V} SELECT * FROM x")
def rate_verdicts(spark, d):
    return _verdicts(spark, d).select("site", "metric", "yours", "competitor_median", "difference", "verdict")


@query(f"{_P}, {_LONG}, {_V} SELECT site, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (verdict = 'behind'), '') AS behind_on, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (verdict = 'ahead'), '') AS ahead_on FROM x GROUP BY 1")
def comparison_summary(spark, d):
    return compare.comparison_summary(_verdicts(spark, d)).select("site", F.array_join("behind_on", ",").alias("behind_on"), F.array_join("ahead_on", ",").alias("ahead_on"))


@query(f"""{_P}, l AS (SELECT m.site, m.median_words AS yours, CAST(trunc(median(o.median_words)) AS INTEGER) AS competitor_median FROM prof m JOIN prof o ON m.site <> o.site WHERE m.site = 'src1' AND m.median_words > 0 AND o.comparable AND o.median_words > 0 GROUP BY 1, 2)
SELECT *, round_even(competitor_median::DOUBLE / yours, 2) AS ratio, CASE WHEN competitor_median::DOUBLE / yours >= 1.5 THEN 'behind' WHEN competitor_median::DOUBLE / yours <= 1 / 1.5::DOUBLE THEN 'ahead' ELSE 'level' END AS verdict FROM l""")
def length_verdict(spark, d):
    p = _profiles(spark, d)
    return compare.length_verdict(p.filter("site = 'src1'"), p)


_TERMS = f"terms AS (SELECT site, term, count(*) AS pages FROM (SELECT site, unnest(list_distinct(list_filter({_words('text')}, lambda w: length(w) >= 3))) AS term FROM page_rows WHERE indexable) GROUP BY 1, 2)"
_MARKET = "market AS (SELECT term, count(*) AS competitors, sum(pages) AS their_pages FROM terms WHERE site <> 'src1' AND site IN (SELECT site FROM prof WHERE sampled >= 5) GROUP BY 1 HAVING count(*) >= 2)"


def _terms(spark, d):
    return compare.terms(b.page_rows(spark, d), F.col("text"))


@query(f"{_P}, {_TERMS} SELECT * FROM terms")
def term_page_frequency(spark, d):
    return _terms(spark, d)


@query(f"{_P}, {_TERMS}, {_MARKET} SELECT term, competitors, their_pages FROM market WHERE term NOT IN (SELECT term FROM terms WHERE site = 'src1') ORDER BY competitors DESC, their_pages DESC, term LIMIT 25")
def themes_topk(spark, d):
    return compare.themes(_terms(spark, d), _profiles(spark, d), "src1")


@query(f"{_P}, {_TERMS}, {_MARKET} SELECT term, competitors, pages AS your_pages FROM market JOIN terms USING (term) WHERE site = 'src1' ORDER BY competitors DESC, your_pages DESC, term LIMIT 15")
def shared_themes_topk(spark, d):
    return compare.shared_themes(_terms(spark, d), _profiles(spark, d), "src1")


@query(f"{_P}, {_TERMS}, {_MARKET} SELECT term FROM market EXCEPT SELECT term FROM terms WHERE site = 'src1'")
def missing_themes_set(spark, d):
    t = _terms(spark, d)
    return compare.market(t, _profiles(spark, d), "src1").select("term").join(t.filter("site = 'src1'").select("term"), "term", "left_anti")


@query(f"{_P}, {_TERMS}, {_MARKET} SELECT term FROM market INTERSECT SELECT term FROM terms WHERE site = 'src1'")
def shared_themes_set(spark, d):
    t = _terms(spark, d)
    return compare.market(t, _profiles(spark, d), "src1").select("term").join(t.filter("site = 'src1'").select("term"), "term", "left_semi")
