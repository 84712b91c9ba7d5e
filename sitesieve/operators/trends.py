"""Runs of a site one after the other: previous run, history, and what got better or worse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The metrics that are followed, which way is better, and how much is a move.
METRICS = {
    "overall_score": ("higher", 2.0), "total_issues": ("lower", 2.0), "keywords_found": ("higher", 5.0), "keywords_ranked": ("higher", 1.0),
    "average_position": ("lower", 0.5), "orphan_pages": ("lower", 1.0), "keyword_coverage": ("higher", 5.0), "behind_on": ("lower", 1.0),
}
COUNTING = ("total_issues", "orphan_pages")
CATEGORY_THRESHOLD, TOLERANCE, HISTORY = 3.0, 0.2, 12


def with_previous(runs: DataFrame, *columns: str) -> DataFrame:
    """Completed runs with the given columns of the run before, of the same site, goal and tenant, as previous_<name>."""
    done = runs.filter("status = 'completed'")
    earlier = Window.partitionBy("site", "goal", "tenant").orderBy("created_at", "run_id")  # null is one group
    return done.withColumns({f"previous_{c}": F.lag(c).over(earlier) for c in ("run_id", *columns)})


def previous_run(runs: DataFrame) -> DataFrame:
    return with_previous(runs).select("run_id", "previous_run_id")


def history(runs: DataFrame, limit: int = HISTORY) -> DataFrame:
    order = Window.partitionBy("site", "goal", "tenant").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.filter("status = 'completed'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def recent(runs: DataFrame, limit: int = 20) -> DataFrame:
    order = Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def comparable(before: Column, after: Column) -> Column:
    """Whether two crawls are within a fifth of the larger; nothing is comparable with an empty one."""
    both = (F.coalesce(before, F.lit(0)) > 0) & (F.coalesce(after, F.lit(0)) > 0)
    return both & (F.abs(after - before) <= TOLERANCE * F.greatest(before, after))


def _direction(change: Column, higher: Column, threshold: Column) -> Column:
    return F.when(F.abs(change) < threshold, "level").when(F.when(higher, change > 0).otherwise(change < 0), "better").otherwise("worse")


def metric_trend(runs: DataFrame) -> DataFrame:
    """Each metric of each run beside the run before; null on either side gives no row. ``metrics`` is a map."""
    rows = with_previous(runs, "metrics", "pages_crawled").filter(F.col("previous_run_id").isNotNull())
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(d == "higher").alias("higher"), F.lit(t).alias("threshold")) for m, (d, t) in METRICS.items()))
    long = rows.select("run_id", "site", "pages_crawled", "previous_pages_crawled", "metrics", "previous_metrics", F.inline(each))
    long = long.withColumns({"before": F.element_at("previous_metrics", F.col("metric")), "after": F.element_at("metrics", F.col("metric"))}).filter("before is not null and after is not null")
    fair = ~F.col("metric").isin(*COUNTING) | comparable(F.col("previous_pages_crawled"), F.col("pages_crawled"))
    change = F.bround(F.col("after") - F.col("before"), 2)
    return long.filter(fair).withColumn("change", change).select("run_id", "site", "metric", "before", "after", "change", _direction(F.col("change"), F.col("higher"), F.col("threshold")).alias("direction"))


def category_trend(runs: DataFrame) -> DataFrame:
    """The same for category scores (a map), with the biggest movers first."""
    rows = with_previous(runs, "category_scores").filter(F.col("previous_run_id").isNotNull())
    long = rows.select("run_id", "site", "previous_category_scores", F.explode("category_scores").alias("category", "after"))
    long = long.withColumn("before", F.element_at("previous_category_scores", F.col("category"))).filter("before is not null and after is not null")
    change = F.bround((F.col("after") - F.col("before")).cast("double"), 2)
    long = long.withColumn("change", change).withColumn("direction", _direction(F.col("change"), F.lit(True), F.lit(CATEGORY_THRESHOLD)))
    order = Window.partitionBy("run_id").orderBy(F.desc(F.abs("change")), "category")
    return long.withColumn("place", F.row_number().over(order)).select("run_id", "site", "category", "before", "after", "change", "direction", "place")


def trend_headline(trend: DataFrame) -> DataFrame:
    """One row a run: how many metrics got better and worse, and the change of the score if it moved."""
    score = F.max(F.when((F.col("metric") == "overall_score") & (F.col("direction") != "level"), F.col("change")))
    return trend.groupBy("run_id", "site").agg(F.count_if(F.col("direction") == "better").alias("better"), F.count_if(F.col("direction") == "worse").alias("worse"), score.alias("score_change"))
