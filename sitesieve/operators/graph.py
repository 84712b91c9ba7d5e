"""The link graph of many sites: nodes (site, url, title, status, indexable, depth, words), edges (site, source, target, anchor, nofollow).

Every operator works on all sites at once, keyed by ``site``. Joins on link targets are plain equi-joins, so that
adaptive execution can split a hub's partition; caps are taken with a window only over what survived the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.functions.selection import kth
from sitesieve.functions.shared import once, shared_folder
from sitesieve.functions.urls import normalise_node

DAMPING, ROUNDS, CONVERGED = 0.85, 40, 1e-9
#: Rounds between two tests of convergence.
TEST_EVERY = 10
#: Anchors that describe the click and not the target.
GENERIC_ANCHORS = (
    "اینجا", "کلیک کنید", "کلیک", "بیشتر", "ادامه مطلب", "ادامه", "لینک", "این لینک", "بیشتر بخوانید", "مشاهده", "جزئیات", "اطلاعات بیشتر", "دانلود",
    "click here", "here", "read more", "more", "link", "this", "learn more", "details", "download", "continue", "see more",
)
_PAGE = ["site", "url"]


def top(df: DataFrame, by: list[Column], limit: int, key: str = "site") -> DataFrame:
    """The first ``limit`` rows of each site."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("_rank") <= limit).drop("_rank")


def build_graph(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised nodes and edges; self links and blank ends go, edges to unknown pages and parallel edges stay."""
    nodes = pages.withColumn("url", normalise_node(F.col("url"))).filter("url <> ''")
    edges = links.withColumns({"source": normalise_node(F.col("source")), "target": normalise_node(F.col("target")), "anchor": F.trim(F.coalesce("anchor", F.lit("")))})
    # the filter reads both ends several times: it would be put beneath, with all that makes a node's spelling in each place
    edges = once(edges, {"source": F.col("source"), "target": F.col("target")})
    return nodes, edges.filter("source <> '' and target <> '' and source <> target").select(*links.columns)


def with_target(edges: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Edges with status and indexability of their target; null where it is not known."""
    known = nodes.select("site", F.col("url").alias("target"), F.col("status").alias("target_status"), F.col("indexable").alias("target_indexable"))
    return edges.join(known, ["site", "target"], how)


def inlinks_by_tag(edges: DataFrame) -> DataFrame:
    return edges.groupBy("site", F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("inlinks"))


def inlink_counts(edges: DataFrame) -> DataFrame:
    """Distinct linking pages of each target."""
    return edges.select("site", "source", "target").distinct().groupBy("site", F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("inlinks"))


def orphans(nodes: DataFrame, edges: DataFrame, start: Column | None = None) -> DataFrame:
    linked = edges.select("site", F.col("target").alias("url")).distinct()
    mine = nodes.filter("indexable") if start is None else nodes.filter(F.col("indexable") & (F.col("url") != start))
    return mine.join(linked, _PAGE, "left_anti").select("site", "url")


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sources = edges.select("site", F.col("source").alias("url")).distinct()
    return nodes.filter("indexable").join(sources, _PAGE, "left_anti").select("site", "url")


def _reachable(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def broken_targets(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Targets that answered with an error, by the number of link tags."""
    bad = nodes.filter(~_reachable(F.col("status"))).select("site", F.col("url").alias("target"), "status")
    found = edges.join(bad, ["site", "target"]).groupBy("site", F.col("target").alias("url"), "status").agg(F.count(F.lit(1)).alias("linked_from"))
    return top(found, [F.desc("linked_from"), F.col("url")], limit)


def links_to_noindex(nodes: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    hidden = nodes.filter(_reachable(F.col("status")) & ~F.col("indexable")).select("site", F.col("url").alias("target"))
    found = edges.join(hidden, ["site", "target"]).groupBy("site", F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("linked_from"))
    return top(found, [F.desc("linked_from"), F.col("url")], limit)


def anchor_profile(edges: DataFrame, limit: int = 10) -> DataFrame:
    """For each target: its commonest anchors, and how many are generic, empty and in all. One pass over the edges."""
    counted = edges.groupBy("site", "target", "anchor").agg(F.count(F.lit(1)).alias("n"))
    generic = F.lower(F.trim("anchor")).isin(*GENERIC_ANCHORS)
    ranked = counted.withColumn("_rank", F.row_number().over(Window.partitionBy("site", "target", (F.col("anchor") == "")).orderBy(F.desc("n"), "anchor")))
    shown = F.when((F.col("anchor") != "") & (F.col("_rank") <= limit), F.struct((-F.col("n")).alias("o"), "anchor", F.col("n").alias("count")))
    return ranked.groupBy("site", F.col("target").alias("url")).agg(
        F.transform(F.array_sort(F.collect_list(shown)), lambda v: F.struct(v["anchor"].alias("anchor"), v["count"].alias("count"))).alias("variants"),
        F.sum(F.when((F.col("anchor") != "") & generic, F.col("n")).otherwise(0)).alias("generic"),
        F.sum(F.when(F.col("anchor") == "", F.col("n")).otherwise(0)).alias("empty"),
        F.sum("n").alias("total"),
    )


def undescribed(nodes: DataFrame, edges: DataFrame, minimum: int = 2, limit: int = 25) -> DataFrame:
    """Known targets with at least ``minimum`` links of which none says what they are about."""
    profile = anchor_profile(edges).join(nodes.select(*_PAGE), _PAGE, "left_semi")
    return top(profile.filter((F.col("total") >= minimum) & (F.col("generic") + F.col("empty") == F.col("total"))), [F.desc("total"), F.col("url")], limit)


def authority(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, converged: float = CONVERGED) -> DataFrame:
    """Internal PageRank of each site, its best page at 100, one decimal: site, url, authority.

    Parallel edges weigh, nofollow edges count, edges to unknown pages pass nothing, pages without outgoing edges
    spread theirs evenly. Each round is one shuffle of ranks; the edges stay partitioned by their source. Rounds stop
    when no site moves by ``converged`` in all. Lineage is cut in the shared checkpoint folder.
    """
    shared_folder(nodes.sparkSession)
    urls = nodes.select("site", "url").distinct()
    size = urls.groupBy("site").agg(F.count(F.lit(1)).cast("double").alias("n"))
    inside = edges.join(urls.select("site", F.col("url").alias("target")), ["site", "target"], "left_semi")
    parallel = inside.groupBy("site", F.col("source").alias("url"), "target").agg(F.count(F.lit(1)).alias("k"))
    degree = parallel.groupBy("site", "url").agg(F.sum("k").alias("d"))
    shares = parallel.join(degree, _PAGE).select("site", "url", "target", (F.col("k") / F.col("d")).alias("share")).repartition("site", "url").checkpoint()
    ranks = urls.join(size, "site").join(degree.select("site", "url", F.lit(True).alias("links")), _PAGE, "left").select("site", "url", "n", F.coalesce("links", F.lit(False)).alias("links"), (1 / F.col("n")).alias("rank")).checkpoint()
    for k in range(rounds):
        passed = shares.join(ranks.select("site", "url", "rank"), _PAGE).groupBy("site", F.col("target").alias("url")).agg(F.sum(F.col("rank") * F.col("share")).alias("passed"))
        leaked = ranks.groupBy("site").agg(F.sum(F.when(~F.col("links"), F.col("rank")).otherwise(0.0)).alias("leaked"))
        rank = (1 - damping) / F.col("n") + damping * F.col("leaked") / F.col("n") + damping * F.coalesce("passed", F.lit(0.0))
        ranks = ranks.join(passed, _PAGE, "left").join(leaked, "site").select("site", "url", "n", "links", rank.alias("rank"), F.col("rank").alias("before"))
        ranks = ranks.checkpoint()  # a round reads the ranks three times, so the plan must not grow
        if (k + 1) % TEST_EVERY == 0:
            moved = ranks.groupBy("site").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("m")).agg(F.max("m")).first()[0]
            if moved is None or moved < converged:
                break
        ranks = ranks.drop("before")
    best = ranks.groupBy("site").agg(F.max("rank").alias("best"))
    return ranks.join(best, "site").select("site", "url", F.round(F.col("rank") / F.col("best") * 100, 1).alias("authority"))


def click_depth(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Least number of clicks from a start: site, url, depth. ``starts``: site, url, depth (0 for start pages, 1 for sitemap urls)."""
    shared_folder(edges.sparkSession)
    steps = edges.select("site", F.col("source").alias("url"), "target").distinct()
    found = starts.groupBy("site", "url").agg(F.min("depth").alias("depth")).checkpoint()
    for depth in range(max_depth):
        reached = found.filter(F.col("depth") == depth).join(steps, _PAGE).select("site", F.col("target").alias("url")).distinct()
        new = reached.join(found.filter(F.col("depth") <= depth + 1), _PAGE, "left_anti").withColumn("depth", F.lit(depth + 1))
        found = found.unionByName(new).groupBy("site", "url").agg(F.min("depth").alias("depth")).checkpoint()
    return found


def upper_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """The value in the upper middle of each site (``sorted[n // 2]``)."""
    return kth(df, value, F.floor(F.col("n") / 2)).withColumnRenamed(value, name)


def overlooked(nodes: DataFrame, edges: DataFrame, ranking: DataFrame, start: Column | None = None, limit: int = 15) -> DataFrame:
    """Substantial pages that the site's own links treat as unimportant."""
    words = upper_median(nodes.filter("indexable and words > 0"), "words", "middle_words")
    scores = upper_median(ranking, "authority", "middle_authority")
    mine = nodes.filter(F.col("indexable") & _reachable(F.col("status")))
    mine = mine if start is None else mine.filter(F.col("url") != start)
    rows = (
        mine.join(inlink_counts(edges), _PAGE, "left").join(ranking, _PAGE, "left").join(words, "site", "left").join(scores, "site", "left")
        .withColumns({"inlinks": F.coalesce("inlinks", F.lit(0)), "authority": F.coalesce("authority", F.lit(0.0))})
        .filter((F.col("words") >= F.coalesce("middle_words", F.lit(0))) & (F.col("inlinks") <= 2) & (F.col("authority") <= F.coalesce("middle_authority", F.lit(0.0))))
    )
    return top(rows.select("site", "url", "title", "words", "inlinks", "depth", "authority"), [F.col("authority"), F.desc("words"), F.col("url")], limit)


def hubs(nodes: DataFrame, edges: DataFrame, ranking: DataFrame, limit: int = 10) -> DataFrame:
    outgoing = edges.groupBy("site", F.col("source").alias("url")).agg(F.count(F.lit(1)).alias("outgoing"))
    rows = nodes.filter("indexable").join(ranking, _PAGE, "left").join(outgoing, _PAGE, "left")
    return top(rows.select("site", "url", "title", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("outgoing", F.lit(0)).alias("outgoing")), [F.desc("authority"), F.col("url")], limit)


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.filter("indexable").groupBy("site", "depth").agg(F.count(F.lit(1)).alias("pages"))


def link_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a site: pages, indexable pages, links, average inlinks of indexable pages, deepest page, nofollow links."""
    pages = nodes.join(inlink_counts(edges), _PAGE, "left").groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("indexable").alias("indexable_pages"),
        F.coalesce(F.bround(F.avg(F.when(F.col("indexable"), F.coalesce("inlinks", F.lit(0)))), 1), F.lit(0.0)).alias("average_inlinks"),
        F.coalesce(F.max(F.when(F.col("indexable"), F.col("depth"))), F.lit(0)).alias("max_depth"),
    )
    links = edges.groupBy("site").agg(F.count(F.lit(1)).alias("internal_links"), F.count_if("nofollow").alias("nofollow_internal"))
    return pages.join(links, "site", "left").na.fill(0, ["internal_links", "nofollow_internal"])


def internal_edges(links: DataFrame, limit: int = 50_000, seq: str = "seq") -> DataFrame:
    """The first ``limit`` internal links of each site with anchors of 120 characters, and whether more were left out.

    The links are counted apart from their numbers, so that the number can be cut off where the rows are read.
    """
    inner = links.filter("internal")
    counts = inner.groupBy("site").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    first = top(inner, [F.col(seq)], limit)
    return first.join(counts, "site").select("site", F.col("url").alias("source"), F.col("href").alias("target"), F.substring("anchor", 1, 120).alias("anchor"), "nofollow", "truncated")
