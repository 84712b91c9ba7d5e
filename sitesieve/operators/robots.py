"""Urls held against the path rules of robots files by an index of prefixes.

A rule matches every path that its value begins. So a path is cut to the lengths that values of its site have, and each of
these prefixes is looked up among the values by an equi-join: the work for a url grows with the number of different
lengths, never with the number of rules, and a site's rules are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_matches(urls: DataFrame, values: DataFrame) -> DataFrame:
    """Each (site, path) of ``urls`` with the least ``place`` of the ``values`` (site, value, place) that its path starts with: site,
    path, place. Paths without such a value, and empty values, are left out."""
    index = values.filter("value <> ''").groupBy("site", "value").agg(F.min("place").alias("place"))
    lengths = index.groupBy("site").agg(F.array_sort(F.collect_set(F.length("value"))).alias("lengths"))  # as many as a path has characters at most
    paths = urls.select("site", "path").distinct().join(lengths, "site")
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = paths.select("site", "path", F.explode(F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("value"))
    return prefixes.join(index, ["site", "value"]).groupBy("site", "path").agg(F.min("place").alias("place"))


def robots_blocked(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Whether each known url (site, url, path) may not be fetched: the first rule of its site whose value the path starts with decides.

    ``rules`` as ``parse_robots`` has them. Urls of sites without rules may be fetched.
    """
    mine = rules.filter(F.col("directive").isin("allow", "disallow") & F.array_contains("agents", agent.lower()))
    first = prefix_matches(urls, mine.select("site", "value", F.struct("line_no", (F.col("directive") == "disallow").alias("no")).alias("place")))
    return urls.join(first, ["site", "path"], "left").withColumn("blocked", F.coalesce("place.no", F.lit(False))).select(*urls.columns, "blocked")


def noindex_blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages marked noindex whose path starts with any disallow value (in lower case) but the root: a crawler never sees the mark.

    ``pages``: site, url, path, is_noindex; ``rules``: site, directive, value.
    """
    values = rules.filter((F.col("directive") == "disallow") & (F.col("value") != "/")).select("site", F.lower("value").alias("value"), F.lit(0).alias("place"))
    marked = pages.filter("is_noindex").select("site", "url", "path")
    return marked.join(prefix_matches(marked, values), ["site", "path"], "left_semi").select("site", "url")
