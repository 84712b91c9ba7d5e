"""Exact de-duplication by content sort.

Sampled splitters cut the order of the normalised texts into ranges, each range is sorted on its own and
neighbours are compared in full. The order is (first bytes, hash, text, doc_id, salt), so the splitters stay short
however long the texts are, and a text with very many copies spreads over as many ranges as its rows need, even if
they share a doc_id or have none. Runs that a splitter cut in two are joined again from one summary row each; their
number is bound by the number of splitters and not by the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.llm.common import ascii_lower, materialise, text_bytes

#: Characters of a text that its sort key starts with.
HEAD = 48
#: Stands for a null doc_id in the order.
LOWEST = -(2**63)
#: Columns of the order that splitters are made of.
KEY = ("_head", "_hash", "_doc", "_salt")
#: Sampled rows for each splitter.
PER_SPLITTER = 32


def _splitters(keys: DataFrame, ranges: int, seed: int) -> list:
    """At most ``ranges - 1`` keys that cut the rows into ranges of about the same size."""
    rows = keys.count()
    if rows < ranges or ranges < 2:
        return []
    share = min(1.0, PER_SPLITTER * ranges / rows)
    sample = keys.sample(fraction=share, seed=seed) if share < 1 else keys
    found = sorted(tuple(r) for r in sample.collect())  # about PER_SPLITTER * ranges short keys
    if not found:
        return []
    return list(dict.fromkeys(found[k * len(found) // ranges] for k in range(1, ranges)))


def _range_of(splitters: list) -> Column:
    """Index of the range of a row's key: a branchless binary search in the sorted splitters."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    columns = [F.lit([s[k] for s in splitters]) for k in range(len(KEY))]
    key = F.struct(*KEY)

    def step(at: Column, width: Column) -> Column:
        k = F.least(at + width, F.lit(n)) - 1
        bound = F.struct(*(F.get(c, k).alias(name) for c, name in zip(columns, KEY, strict=True)))
        return F.when((at + width <= n) & (bound <= key), at + width).otherwise(at)

    widths = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(widths), F.lit(0), step)


def _sorted_runs(docs: DataFrame, ranges: int | None, seed: int, text: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """Rows (as _row) in their ranges with _first and _last of a run of equal neighbours, what is known of cut texts, and
    whether rows with the largest doc_id of one of these may lie in several ranges."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = ascii_lower(text_bytes(text))
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.substring(norm, 1, HEAD).alias("_head"), F.xxhash64(norm).alias("_hash"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("_doc"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    norm = ascii_lower(F.coalesce(F.col("_row")[text], F.lit("")))
    splitters = _splitters(keyed.select(*KEY), ranges, seed)
    # the one shuffle of the texts; the window sorts each range and spills to disk as it needs
    placed = keyed.withColumn("_range", _range_of(splitters)).repartition("_range").withColumn("_norm", norm)
    order = Window.partitionBy("_range").orderBy("_head", "_hash", "_norm", "_doc")
    differs = lambda other: ~F.coalesce(other.over(order) == F.col("_norm"), F.lit(False))
    runs = placed.withColumns({"_first": differs(F.lag("_norm")), "_last": differs(F.lead("_norm"))})
    if not splitters:
        return runs, None, False
    # texts that a splitter cuts: about one row for each splitter
    cut = spark.createDataFrame([s[:3] for s in splitters], "_head string, _hash bigint, _bound bigint").groupBy("_head", "_hash").agg(F.max("_bound").alias("_bound"))
    parts = (
        keyed.join(F.broadcast(cut), ["_head", "_hash"])
        .groupBy("_head", "_hash", F.sha2(norm, 256).alias("_sha"))
        .agg(F.max("_doc").alias("_cut_most"), F.count(F.lit(1)).alias("_cut_size"), F.max("_bound").alias("_bound"), F.count_if(F.col("_doc") == F.col("_bound")).alias("_ties"))
    )
    known = parts.collect()
    return runs, spark.createDataFrame(known, parts.schema).drop("_bound", "_ties"), any(r._bound == r._cut_most and r._ties > 1 for r in known)


def content_groups(docs: DataFrame, ranges: int | None = None, seed: int = 5, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. The largest
    doc_id of each group stays. Repeated rows (same doc_id and text) count in group_size and all carry the same
    values. A null doc_id sorts below every other, so it stays only where a group has nothing else. An empty table
    gives no rows. Other columns are not read.
    """
    runs, parts, _ = _sorted_runs(docs.select("doc_id", text), ranges, seed, text)
    order = Window.partitionBy("_range").orderBy("_head", "_hash", "_norm", "_doc")
    number = F.sum(F.col("_first").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    thin = runs.withColumn("_run", number).select("_row.doc_id", "_range", "_run", "_doc", "_head", "_hash", F.sha2("_norm", 256).alias("_sha"))
    run = Window.partitionBy("_range", "_run")
    found = thin.withColumns({"_most": F.max("_doc").over(run), "_size": F.count(F.lit(1)).over(run)})
    if parts is not None:
        found = found.join(F.broadcast(parts), ["_head", "_hash", "_sha"], "left").withColumns({"_most": F.coalesce("_cut_most", "_most"), "_size": F.coalesce("_cut_size", "_size")})
    return found.select(
        "doc_id",
        F.when(F.col("_most") != LOWEST, F.col("_most")).alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_doc") == F.col("_most")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, ranges: int | None = None, seed: int = 5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id.

    As ``content_groups``, and of repeated rows with that doc_id one stays. The texts are shuffled once. Columns may have
    any name.
    """
    runs, parts, several = _sorted_runs(docs, ranges, seed, text)
    last = runs.filter("_last")
    if parts is not None:
        last = last.withColumn("_sha", F.sha2("_norm", 256)).join(F.broadcast(parts), ["_head", "_hash", "_sha"], "left").filter(F.coalesce(F.col("_doc") == F.col("_cut_most"), F.lit(True)))
    if several:  # about one row for each splitter, of which one for each text stays
        last = materialise(last, "distinct")
        cut = F.col("_cut_most").isNotNull()
        last = last.filter(~cut).unionByName(last.filter(cut).dropDuplicates(["_head", "_hash", "_sha"]))
    return last.select("_row.*")
