"""Token counts by an exact length histogram.

Documents are counted by their encoded length; suffix sums over the lengths answer totals, quantiles and totals
after truncation for every context limit, without touching the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches
from sitesieve.llm.tokens import CACHE_WORDS_ALONE, encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Lengths that are summed up together first, so that no task holds all lengths.
SPAN = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path, CACHE_WORDS_ALONE).encode_all(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64())], ["n_tokens"])

    return run


def lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Encoded length of every row; null texts have none."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_lengths(path or vocabulary(VOCABULARY)), "n_tokens bigint")


def length_histogram(counted: DataFrame) -> DataFrame:
    """One row for each length that occurs: n_tokens, docs, docs_upto, docs_from, tokens_from, truncated_total, share_upto.

    docs_from and tokens_from are the documents at least so long and their tokens; truncated_total is what all
    documents hold together when each is cut to n_tokens; share_upto is the share of documents at most so long, so
    the q-quantile is the first length whose share is at least q. No rows for an empty table.
    """
    bars = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).withColumns({"span": F.floor(F.col("n_tokens") / SPAN), "tokens": F.col("n_tokens") * F.col("docs")})
    bars = materialise(bars, "lengths")  # read twice; the texts are encoded once
    spans = bars.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    down = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = spans.select("span", (F.sum("d").over(down) - F.col("d")).alias("d_later"), (F.sum("t").over(down) - F.col("t")).alias("t_later"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = bars.join(later, "span").withColumns({"docs_from": F.col("d_later") + F.sum("docs").over(inside), "tokens_from": F.col("t_later") + F.sum("tokens").over(inside)})
    upto = F.col("d_all") - F.col("docs_from") + F.col("docs")
    return sums.select(
        "n_tokens",
        "docs",
        upto.alias("docs_upto"),
        "docs_from",
        "tokens_from",
        (F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        (upto / F.col("d_all")).alias("share_upto"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row, total: the tokens of all documents when each is cut to ``limit``, which need not occur as a length."""
    longer = F.col("n_tokens") > limit
    return histogram.agg(F.coalesce(F.sum(F.when(longer, F.lit(limit)).otherwise(F.col("n_tokens")) * F.col("docs")), F.lit(0)).alias("total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length that at least the share ``q`` of documents don't exceed."""
    return histogram.filter(F.col("share_upto") >= q).agg(F.min("n_tokens").alias("n_tokens"))
