"""Keyword studies: suggestions merged, scored, classified and clustered; every operator is keyed by ``seed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesieve.functions.text import TOKEN, tokens_of, word_count

# The shapes of queries and the terms that tell an intent.
PERSIAN_ALPHABET = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
LATIN_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
QUESTIONS_FA = ("چیست", "چگونه", "چطور", "چرا", "کدام", "کجا", "چند", "آیا", "یعنی چه", "چه زمانی", "چه کسی", "چقدر")
QUESTIONS_EN = ("what is", "how to", "why", "when", "where", "which", "who", "can", "is", "does", "vs", "how much", "how many")
COMMERCIAL_FA = ("قیمت", "خرید", "بهترین", "ارزان", "تخفیف", "فروش", "سفارش", "هزینه", "نمایندگی", "اقساطی", "دست دوم", "اورجینال", "تعرفه")
COMMERCIAL_EN = ("price", "buy", "best", "cheap", "discount", "cost", "review", "top", "for sale", "deals", "pricing", "alternative")
INFORMATIONAL_FA = (
    "آموزش", "راهنما", "معرفی", "مقایسه", "تفاوت", "مزایا", "معایب", "کاربرد", "انواع", "نمونه", "مثال", "روش", "مراحل", "اصول", "نکات", "ترفند",
    "رایگان", "آنلاین", "pdf", "دانلود", "شرایط", "قوانین",
)
INFORMATIONAL_EN = ("tutorial", "guide", "examples", "template", "checklist", "tips", "free", "online", "pdf", "course", "meaning", "types", "benefits")
LOCAL_FA = ("در تهران", "نزدیک من", "در ایران", "در مشهد", "در اصفهان", "در شیراز")
LOCAL_EN = ("near me", "in tehran", "online")
COMPARISON_FA = ("یا", "در مقابل", "بهتر است یا", "و")
COMPARISON_EN = ("vs", "or", "alternative to", "compared to")
TIME_FA = ("۱۴۰۵", "2026", "جدید", "امسال", "به روز")
TIME_EN = ("2026", "latest", "new", "updated")
TRANSACTIONAL = (
    "خرید", "سفارش", "ثبت نام", "ثبت‌نام", "دانلود", "رزرو", "استعلام", "پرداخت",
    "buy", "order", "download", "signup", "sign up", "book", "subscribe", "hire",
)
COMMERCIAL = (*COMMERCIAL_FA, *COMMERCIAL_EN, "مقایسه", "بررسی", "نقد", "review", "vs", "بهترین")
LOCAL = (*LOCAL_FA, *LOCAL_EN, "نزدیک من", "near me", "تهران", "شیراز", "مشهد", "اصفهان", "کرج", "تبریز")
QUESTION_MARKERS = (*QUESTIONS_FA, *QUESTIONS_EN, "؟", "?")
# What a page for an intent is, what it holds, and the pattern of its title.
PLANS = {
    "transactional": ("صفحه‌ی محصول یا خدمت", "قیمت، مشخصات، فراخوان خرید و نشانه‌گذاری Product", "%s با بهترین قیمت و ارسال سریع"),
    "commercial": ("مقاله‌ی مقایسه‌ای یا بررسی", "جدول مقایسه، مزایا و معایب، تجربه‌ی واقعی استفاده", "بهترین %s — مقایسه و راهنمای انتخاب"),
    "informational": ("مقاله‌ی آموزشی جامع", "پاسخ کوتاه در ابتدا، سپس مراحل، مثال و پرسش‌های متداول", "%s: راهنمای کامل و کاربردی"),
    "local": ("صفحه‌ی محلی", "آدرس، نقشه، ساعت کاری و نشانه‌گذاری LocalBusiness", "%s — نزدیک شما"),
    "navigational": ("صفحه‌ی برند", "معرفی، تماس و لینک به صفحات اصلی", "%s"),
}
RANKED, QUESTIONS, CLUSTERS, MEMBERS, PLANNED, SUPPORTING = 200, 40, 12, 25, 10, 7


def merge_suggestions(suggestions: DataFrame) -> DataFrame:
    """One row per seed and spelling without case: the first spelling, its sources, how often and how high it came up.

    Suggestions are dealt once, as they come (so that neighbours that are alike stay together), and are counted where they arrive by spelling
    and source in buffers of fixed width; only what differs in these goes on to sets and first spellings.
    """
    text = F.trim("keyword")
    rows = suggestions.select("seed", text.alias("keyword"), "source", "position", "seq").filter(F.length("keyword") >= 2)
    dealt = rows.repartition("seed", F.lower("keyword"))
    each = dealt.groupBy("seed", F.lower("keyword").alias("key"), "keyword", "source").agg(F.count(F.lit(1)).alias("hits"), F.min("position").alias("position"), F.min("seq").alias("seq"))
    return each.groupBy("seed", "key").agg(
        F.min_by("keyword", "seq").alias("keyword"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum("hits").alias("hits"),
        F.least(F.min("position"), F.lit(99)).alias("best_position"),
        F.min("seq").alias("seq"),
    )


def demand(n_sources: Column, hits: Column, position: Column) -> Column:
    """0 to 100, half-even: sources, hits and the (0-based) best position."""
    points = F.least(n_sources, F.lit(4)) / 4 * 40 + F.least(hits, F.lit(10)) / 10 * 35 + F.greatest(F.lit(0.0), (10 - F.least(position, F.lit(10))) / 10) * 25
    return F.bround(points).cast("int")


def opportunity(demand_score: Column, words: Column) -> Column:
    points = demand_score * 0.7 + F.least(words, F.lit(6)) / 6 * 30 - F.when(words <= 2, 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(points).cast("int")))


def _any_in(text: Column, terms: tuple[str, ...]) -> Column:
    # a token of a term is also a substring of the text, so one test covers both
    quoted = "|".join("\\Q" + t + "\\E" for t in dict.fromkeys(terms))
    return text.rlike(quoted)


def classify_intent(keyword: Column, brands: Column | None = None) -> Column:
    """navigational (a brand token), local, transactional, commercial or informational, the first that fits."""
    lowered = F.lower(keyword)
    tokens = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))
    branded = F.lit(False) if brands is None else F.coalesce(F.arrays_overlap(tokens, F.transform(brands, F.lower)), F.lit(False))
    return (
        F.when(branded, "navigational").when(_any_in(lowered, LOCAL), "local").when(_any_in(lowered, TRANSACTIONAL), "transactional")
        .when(_any_in(lowered, COMMERCIAL), "commercial").otherwise("informational")
    )


def brand_terms(seed: Column) -> Column:
    return F.filter(F.split(F.trim(seed), r"\s+"), lambda t: F.length(t) > 3)


def scored(merged: DataFrame) -> DataFrame:
    """Merged suggestions with words, long_tail, intent, demand and opportunity."""
    words = word_count(F.col("keyword"))
    out = merged.withColumns({"words": words, "long_tail": words >= 4, "intent": classify_intent(F.col("keyword"), brand_terms(F.col("seed"))), "demand": demand(F.size("sources"), F.col("hits"), F.col("best_position"))})
    return out.withColumn("opportunity", opportunity(F.col("demand"), F.col("words")))


def rank_keywords(keywords: DataFrame, limit: int = RANKED) -> DataFrame:
    """The first ``limit`` of each seed by demand, hits and spelling, with their rank."""
    order = Window.partitionBy("seed").orderBy(F.desc("demand"), F.desc("hits"), "keyword")
    return keywords.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def questions(ranked: DataFrame, limit: int = QUESTIONS) -> DataFrame:
    asked = ranked.filter(_any_in(F.lower("keyword"), QUESTION_MARKERS))
    return asked.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("rank"))).filter(F.col("_k") <= limit).select("seed", "keyword", "rank")


def by_intent(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("seed", "intent").agg(F.count(F.lit(1)).alias("keywords"))


def source_failures(requests: DataFrame) -> DataFrame:
    return requests.groupBy("seed", "source").agg(F.count_if(F.col("error").isNotNull()).alias("failures"), F.count(F.lit(1)).alias("requests"))


def cluster_labels(ranked: DataFrame) -> DataFrame:
    """The label of each keyword: its most shared token that 2 to 60 % of the seed's keywords have, or else its best, or the seed.

    Tokens go to a shuffle by seed and token with partial counts, so a frequent token is pre-aggregated.
    """
    keys = ["seed", "keyword"]
    own = F.array_except(tokens_of(F.col("keyword")), tokens_of(F.col("seed")))
    sized = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("seed")))
    tokens = sized.select(*keys, "_n", F.posexplode(own).alias("_pos", "_token"))
    frequency = tokens.groupBy("seed", "_token").agg(F.count(F.lit(1)).alias("_freq"))
    order = [F.desc("_freq"), F.length("_token"), F.col("_pos")]
    marked = tokens.join(frequency, ["seed", "_token"]).withColumn("_fits", (F.col("_freq") >= 2) & (F.col("_freq") <= F.col("_n") * 0.6))
    best = marked.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_fits"), *order))).filter("_k = 1").select(*keys, F.col("_token").alias("label"))
    return ranked.join(best, keys, "left").withColumn("label", F.coalesce("label", "seed"))


def cluster(ranked: DataFrame, limit: int = CLUSTERS, members: int = MEMBERS) -> DataFrame:
    """Clusters of each seed, the largest first: label, size, intent, avg_demand, primary keyword, keywords."""
    labelled = cluster_labels(ranked)
    row = F.struct((-F.col("demand")).alias("o"), F.col("rank").alias("k"), "keyword")
    intents = labelled.groupBy("seed", "label", "intent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("demand")).alias("o"), "rank")).alias("first"))
    main = intents.groupBy("seed", "label").agg(F.min_by("intent", F.struct((-F.col("n")).alias("o"), "first")).alias("intent"))
    groups = labelled.groupBy("seed", "label").agg(F.count(F.lit(1)).alias("size"), F.bround(F.avg("demand")).cast("int").alias("avg_demand"), F.array_sort(F.collect_list(row)).alias("_rows"), F.min("rank").alias("_first"))
    order = Window.partitionBy("seed").orderBy(F.desc("size"), F.desc("avg_demand"), "_first")
    out = groups.join(main, ["seed", "label"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return out.withColumn("keywords", F.transform(F.slice("_rows", 1, members), lambda r: r["keyword"])).select("seed", "place", "label", "size", "intent", "avg_demand", F.get("keywords", F.lit(0)).alias("primary"), "keywords")


def content_plan(clusters: DataFrame, limit: int = PLANNED) -> DataFrame:
    """A page for each of the first clusters: kind, what it must include, supporting keywords and a title."""

    def of(k: int) -> Column:
        found = F.lit(PLANS["informational"][k])
        for intent, row in PLANS.items():
            found = F.when(F.col("intent") == intent, row[k]).otherwise(found)
        return found

    title = F.replace(of(2), F.lit("%s"), F.col("primary"))
    return clusters.filter(F.col("place") <= limit).select("seed", "place", F.col("primary").alias("primary_keyword"), of(0).alias("page_type"), of(1).alias("must_include"), F.slice("keywords", 2, SUPPORTING).alias("supporting_keywords"), F.col("size").alias("cluster_size"), title.alias("suggested_title"))


def modifiers(spark: SparkSession, lang: str) -> DataFrame:
    """The shapes of queries of a language, in order: seq, before, after."""
    fa = lang.lower().startswith(("fa", "ar"))
    pick = lambda a, b: a if fa else b
    rows = [("", "")]
    rows += [("", w) if lang.lower().startswith("fa") else (w, "") for w in pick(QUESTIONS_FA, QUESTIONS_EN)]
    for w in (*pick(COMMERCIAL_FA, COMMERCIAL_EN), *pick(INFORMATIONAL_FA, INFORMATIONAL_EN)):
        rows += [("", w), (w, "")]
    rows += [("", w) for w in (*pick(LOCAL_FA, LOCAL_EN), *pick(TIME_FA, TIME_EN), *pick(COMPARISON_FA, COMPARISON_EN), *pick(PERSIAN_ALPHABET, LATIN_ALPHABET))]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, before string, after string")


def build_queries(seeds: DataFrame, lang: str = "en") -> DataFrame:
    """All queries to ask for each seed, in order, each once: seed, seq, query. The modifiers are a fixed table of some dozens."""
    shapes = [tuple(r) for r in modifiers(seeds.sparkSession, lang).collect()]
    each = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(b).alias("before"), F.lit(a).alias("after")) for k, b, a in shapes))
    rows = seeds.select(F.trim("seed").alias("seed")).filter("seed <> ''").distinct().select("seed", F.inline(each))
    query = F.trim(F.concat_ws(" ", F.when(F.col("before") != "", F.col("before")), "seed", F.when(F.col("after") != "", F.col("after"))))
    return rows.withColumn("query", query).groupBy("seed", "query").agg(F.min("seq").alias("seq"))


def keywords_to_track(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The head of the ranked list without case, from 1 to 50 keywords."""
    first = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("seed", F.lower(F.trim("keyword"))).orderBy("rank"))).filter("_k = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("rank"))).filter(F.col("place") <= max(1, min(n, 50))).select("seed", "place", "keyword")
