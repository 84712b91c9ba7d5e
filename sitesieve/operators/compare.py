"""Comparison of sites by rates and medians, and of what they write about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.functions.shared import shared_folder
from sitesieve.functions.text import with_words
from sitesieve.operators.coverage import THIN_WORDS, TITLE_MAX, TITLE_MIN
from sitesieve.operators.graph import top

MIN_SAMPLE, RATE_MARGIN, LENGTH_MARGIN, MIN_COMPETITORS, MIN_TERM = 5, 10.0, 1.5, 2, 3
#: Ranges that the values of a metric are ranked in.
SLICES = 64
#: The rates that are compared, and which way is better.
METRICS = {"titled": "higher", "title_in_range": "higher", "described": "higher", "has_h1": "higher", "thin": "lower"}


def profile(pages: DataFrame) -> DataFrame:
    """Habits of each site over its indexable pages: rates in per cent, medians cut to whole numbers."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rate = lambda p: F.bround(F.avg(p.cast("int")) * 100, 1)
    length = F.length(F.coalesce("title", F.lit("")))
    return pages.filter("indexable").groupBy("site").agg(
        F.count(F.lit(1)).alias("sampled"),
        (F.count(F.lit(1)) >= MIN_SAMPLE).alias("comparable"),
        rate(has(F.col("title"))).alias("titled"),
        rate(length.between(TITLE_MIN, TITLE_MAX)).alias("title_in_range"),
        rate(has(F.col("description"))).alias("described"),
        rate(F.exists("headings", lambda h: h["level"] == 1) & has(F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"])).alias("has_h1"),
        F.median("words").cast("int").alias("median_words"),
        rate(F.col("words") < THIN_WORDS).alias("thin"),
        F.median(F.size("headings")).cast("int").alias("median_headings"),
    )


def _ranked(values: DataFrame) -> DataFrame:
    """``values`` (metric, site, v) with rank and n (rows of the metric), by ranges: v is cut at its quantiles, ranges are counted, and a row's
    rank is the rows of the ranges before and its place in its own. Equal values are told apart by the site."""
    cut = values.groupBy("metric").agg(F.percentile_approx("v", [k / SLICES for k in range(1, SLICES)], 1000).alias("cuts"))
    sliced = values.join(F.broadcast(cut), "metric").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")  # a row for each metric
    counts = sliced.groupBy("metric", "slice").agg(F.count(F.lit(1)).alias("m"))
    over = Window.partitionBy("metric").orderBy("slice")
    ahead = counts.select("metric", "slice", (F.sum("m").over(over) - F.col("m")).alias("ahead"), F.sum("m").over(Window.partitionBy("metric")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("metric", "slice").orderBy("v", "site"))
    return sliced.withColumn("inside", inside).join(F.broadcast(ahead), ["metric", "slice"]).select("metric", "site", "v", (F.col("ahead") + F.col("inside")).alias("rank"), "n")


def median_of_others(mine: DataFrame, others: DataFrame) -> DataFrame:
    """Each row of ``mine`` (metric, site, v) with median: that of the rows of ``others`` of the metric but its own site's.

    Every value is ranked once. Without a row of rank r the median of the n - 1 others is one of the order statistics around
    the middle, on either side of r; so three values of a metric are all that is looked up. Rows whose metric has no others are left out.
    """
    shared_folder(mine.sparkSession)
    ranked = _ranked(others).checkpoint()
    half = F.floor(F.col("n") / 2)
    middle = ranked.filter(F.col("rank").between(half, half + 2)).groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"), F.max("n").alias("all"))  # up to three values
    rows = mine.join(ranked.select("metric", "site", "rank"), ["metric", "site"], "left").join(F.broadcast(middle), "metric")
    n = F.col("all") - F.col("rank").isNotNull().cast("long")
    kth = lambda k: F.element_at("at", k + F.coalesce((F.col("rank") <= k).cast("long"), F.lit(0)))  # noqa: E731  the k-th of those that are left
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return rows.filter(n > 0).select("metric", "site", "v", ((kth(low) + kth(high)) / 2).alias("median"))


def rate_verdicts(mine: DataFrame, others: DataFrame) -> DataFrame:
    """Each rate of each site of ``mine`` beside the median of the comparable ``others``; ``others`` may hold ``mine``, which is left out."""
    stack = F.expr("stack(%d, %s) as (metric, v)" % (len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS)))
    found = median_of_others(mine.select("site", stack), others.filter("comparable").select("site", stack).filter("v is not null"))
    rows = found.select("site", "metric", F.col("v").alias("yours"), F.bround("median", 1).alias("competitor_median"))
    gap = F.bround(F.col("yours") - F.col("competitor_median"), 1)
    better = F.when(F.col("metric").isin(*(m for m, d in METRICS.items() if d == "higher")), F.col("difference") > 0).otherwise(F.col("difference") < 0)
    return rows.withColumn("difference", gap).withColumn("verdict", F.when(F.abs("difference") < RATE_MARGIN, "level").when(better, "ahead").otherwise("behind"))


def length_verdict(mine: DataFrame, others: DataFrame) -> DataFrame:
    sized = lambda df: df.filter("median_words > 0").select(F.lit("words").alias("metric"), "site", F.col("median_words").alias("v"))
    rows = median_of_others(sized(mine), sized(others.filter("comparable"))).select("site", F.col("v").alias("yours"), F.col("median").cast("int").alias("competitor_median"))
    ratio = F.col("competitor_median") / F.col("yours")
    return rows.withColumns({"ratio": F.bround(ratio, 2), "verdict": F.when(ratio >= LENGTH_MARGIN, "behind").when(ratio <= 1 / LENGTH_MARGIN, "ahead").otherwise("level")})


def comparison_summary(verdicts: DataFrame) -> DataFrame:
    listed = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("metric"))))
    return verdicts.groupBy("site").agg(listed("behind").alias("behind_on"), listed("ahead").alias("ahead_on"))


def terms(pages: DataFrame, text: Column) -> DataFrame:
    """Pages of each site that declare a term: site, term, pages."""
    shared_folder(pages.sparkSession)
    found = F.filter("_t", lambda w: F.length(w) >= MIN_TERM)
    rows = with_words(pages.filter("indexable"), text, "_t", distinct=True, kept=["site"])
    return rows.select("site", F.explode(found).alias("term")).groupBy("site", "term").agg(F.count(F.lit(1)).alias("pages"))


def market(terms_by_site: DataFrame, sampled: DataFrame, mine: str) -> DataFrame:
    """Terms of at least two comparable sites other than ``mine``: term, competitors, their_pages."""
    usable = sampled.filter((F.col("sampled") >= MIN_SAMPLE) & (F.col("site") != mine)).select("site")
    return terms_by_site.join(usable, "site", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("competitors"), F.sum("pages").alias("their_pages")).filter(F.col("competitors") >= MIN_COMPETITORS)


def themes(terms_by_site: DataFrame, sampled: DataFrame, mine: str, limit: int = 25) -> DataFrame:
    """What the others write about and ``mine`` doesn't."""
    ours = terms_by_site.filter(F.col("site") == mine).select("term")
    rows = market(terms_by_site, sampled, mine).join(ours, "term", "left_anti")
    return rows.orderBy(F.desc("competitors"), F.desc("their_pages"), "term").limit(limit)


def shared_themes(terms_by_site: DataFrame, sampled: DataFrame, mine: str, limit: int = 15) -> DataFrame:
    ours = terms_by_site.filter(F.col("site") == mine).select("term", F.col("pages").alias("your_pages"))
    rows = market(terms_by_site, sampled, mine).join(ours, "term").select("term", "competitors", "your_pages")
    return rows.orderBy(F.desc("competitors"), F.desc("your_pages"), "term").limit(limit)


def assemble(wanted: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports that comparisons ask for (comparison_id, role, crawl_id), each once, with the columns of ``reports`` (one row for each crawl_id).

    A competitor without a report stays as a row that is not ``available``, and the comparison is completed without it; without the
    report of its own site (role mine) a comparison has failed.
    """
    asked = wanted.select("comparison_id", "role", "crawl_id").distinct()
    found = asked.join(reports.withColumn("available", F.lit(True)), "crawl_id", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    own = F.max((F.col("role") == "mine") & F.col("available")).over(Window.partitionBy("comparison_id"))
    return found.withColumn("status", F.when(own, "completed").otherwise("failed"))
