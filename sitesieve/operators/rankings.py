"""Search rankings: result rows (keyword, position, url, domain, title) held against a target domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of clicks by position; 0.01 beyond the tenth.
CTR = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.03, 9: 0.03, 10: 0.02}
OPPORTUNITIES, COMPETITORS = 25, 10


def same_site(domain: Column, target: Column) -> Column:
    """The target or a host below it; a name that only ends alike is another site."""
    return (domain == target) | domain.endswith(F.concat(F.lit("."), target))


def _target(domain: str) -> Column:
    return F.regexp_replace(F.lower(F.lit(domain)), r"^www\.", "")


def opportunity(position: Column) -> Column:
    """0 to 100: what there is to gain from a position; all for none, nothing for the first."""
    ctr = F.coalesce(*(F.when(position == p, c) for p, c in CTR.items()), F.lit(0.01))
    gain = F.bround((F.lit(0.28) - ctr) * 100 / 0.28 * 0.9).cast("int")
    return F.when(position.isNull(), 100).when(position == 1, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), gain)))


def rank(results: DataFrame, domain: str) -> DataFrame:
    """One row a keyword: best position and url of the target, distinct domains above it in order, opportunity."""
    mine = same_site(F.col("domain"), _target(domain)) if domain else F.lit(False)
    best = F.min(F.when(mine, F.struct("position", "url"))).over(Window.partitionBy("keyword"))
    placed = results.withColumn("_best", best)
    firsts = placed.groupBy("keyword", "_best", "domain").agg(F.min("position").alias("first"))
    above = F.when(F.col("first") < F.col("_best.position"), F.struct("first", "domain"))
    rows = firsts.groupBy("keyword", "_best").agg(F.transform(F.array_sort(F.collect_list(above)), lambda x: x["domain"]).alias("competitors_above"))
    return rows.select("keyword", F.col("_best.position").alias("position"), F.col("_best.url").alias("url"), "competitors_above", opportunity(F.col("_best.position")).alias("opportunity"))


def competitors_above(results: DataFrame, domain: str) -> DataFrame:
    return rank(results, domain).select("keyword", "competitors_above")


def top_competitors(rankings: DataFrame, domain: str, limit: int = COMPETITORS) -> DataFrame:
    """Domains above the target by the number of keywords; its own hosts don't count."""
    rows = rankings.select(F.explode("competitors_above").alias("domain")).filter(~same_site(F.col("domain"), F.lit(domain.lower())))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("outranks_on")).orderBy(F.desc("outranks_on"), "domain").limit(limit)


def opportunities(rankings: DataFrame, limit: int = OPPORTUNITIES) -> DataFrame:
    return rankings.select("keyword", "position", "opportunity").orderBy(F.desc("opportunity"), "keyword").limit(limit)


def summary(rankings: DataFrame) -> DataFrame:
    """One row: keywords checked, ranked and missing, average position and the best keyword."""
    best = F.min(F.when(F.col("position").isNotNull(), F.struct("position", "keyword")))
    return rankings.agg(
        F.count(F.lit(1)).alias("keywords_checked"),
        F.count("position").alias("keywords_ranked"),
        F.count_if(F.col("position").isNull()).alias("keywords_missing"),
        F.bround(F.avg("position"), 1).alias("average_position"),
        best.alias("_best"),
    ).select("keywords_checked", "keywords_ranked", "keywords_missing", "average_position", F.col("_best.keyword").alias("best_keyword"), F.col("_best.position").alias("best_position"))


def split_failures(lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookups that answered, and those that failed; a failure is not a missing rank."""
    return lookups.filter(F.col("error").isNull()), lookups.filter(F.col("error").isNotNull()).select("keyword", "error")
