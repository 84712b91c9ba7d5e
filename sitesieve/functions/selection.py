"""Order statistics of each site without ordering a whole site in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.functions.shared import shared_folder

#: Ranges that a site's values are cut into, and different values of a range that a task puts in order.
SLICES, ORDERED = 64, 1_000_000


def kth(df: DataFrame, value: str, place: Column, key: str = "site", slices: int = SLICES, ordered: int = ORDERED) -> DataFrame:
    """key and the value that stands at ``place`` (from 0; an expression of ``n``, the rows of the key) in ascending order; nulls don't count.

    Equal values are one row with a weight. The values of a key are cut at approximate quantiles, the ranges are counted, sums
    of the counts tell the range that holds the place, and only that range goes on, until it is short enough to be put in order.
    """
    shared_folder(df.sparkSession)
    weights = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w")).checkpoint()
    wanted = weights.groupBy(key).agg(F.sum("w").alias("n")).select(key, place.cast("long").alias("place"))
    most = weights.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while most > ordered:
        cuts = weights.groupBy(key).agg(F.percentile_approx("v", [k / slices for k in range(1, slices)], 10_000).alias("cuts"))
        sliced = weights.join(cuts, key).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
        counts = sliced.groupBy(key, "slice").agg(F.sum("w").alias("m"), F.count(F.lit(1)).alias("values"))
        upto = F.sum("m").over(Window.partitionBy(key).orderBy("slice"))  # a row for each range
        held = counts.withColumn("ahead", upto - F.col("m")).join(wanted, key).filter((F.col("ahead") <= F.col("place")) & (F.col("place") < F.col("ahead") + F.col("m"))).checkpoint()
        weights = sliced.join(held.select(key, "slice"), [key, "slice"], "left_semi").select(key, "v", "w").checkpoint()
        wanted = held.select(key, (F.col("place") - F.col("ahead")).alias("place"))
        before, most = most, held.agg(F.max("values")).first()[0] or 0
        if most == before:
            break  # the quantiles tell no two values apart
    upto = F.sum("w").over(Window.partitionBy(key).orderBy("v"))
    placed = weights.withColumn("upto", upto).join(wanted, key).filter((F.col("upto") - F.col("w") <= F.col("place")) & (F.col("place") < F.col("upto")))
    return placed.select(key, F.col("v").alias(value))
