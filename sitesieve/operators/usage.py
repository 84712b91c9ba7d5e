"""Which texts hold which keywords, by an Aho-Corasick automaton: one pass over a text, however many keywords there are.

Keywords are dealt into parts of a bounded size. A part is sent to the executors as a broadcast, every task builds its
automaton once and counts texts by site and keyword, and the counts are written before the next part is sent; so neither
the driver nor a worker ever holds more than one part, and no row stands for a text and a keyword.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.functions.shared import shared_folder

#: Characters of the keywords of a part, and counts that a task holds before it sends them on.
PART_CHARACTERS, HELD = 8_000_000, 200_000


def _counter(part, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = part.value
        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        automaton.make_automaton()
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            sites, ks, at = zip(*counts, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array([words[k] for k in ks], pa.string()), pa.array(at, pa.int32()), pa.array(counts.values(), pa.int64())], ["site", "keyword", "place", "n"])
            counts.clear()
            return out

        for batch in batches:
            sites = batch.column(0).to_pylist()
            for place in range(places):
                for site, text in zip(sites, batch.column(place + 1).to_pylist(), strict=True):
                    if text:
                        counts.update((site, k, place) for k in {k for _, k in automaton.iter(text)})
                if len(counts) >= HELD:
                    yield sent()
        if counts:
            yield sent()

    return run


def texts_with(rows: DataFrame, keywords: DataFrame, places: tuple[str, ...], part_characters: int = PART_CHARACTERS) -> DataFrame:
    """site, keyword and for each column of ``places`` in how many rows of the site (column ``site``) it holds the keyword.

    ``keywords`` has distinct strings that aren't empty in its first column. Pairs of site and keyword without any text are left out.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    known = keywords.toDF("keyword")
    size = known.agg(F.sum(F.length("keyword"))).first()[0] or 0
    parts = -(-size // part_characters)
    slim = rows.select("site", *places)
    if parts > 1:
        slim = slim.checkpoint()  # read once for each part
        known = known.checkpoint()
    found = None
    for k in range(parts):
        held = spark.sparkContext.broadcast([r.keyword for r in known.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == k).collect()])  # a part
        counted = slim.mapInArrow(_counter(held, len(places)), "site string, keyword string, place int, n bigint")
        counted = counted.groupBy("site", "keyword").agg(*(F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(places))).checkpoint()
        held.unpersist()
        found = counted if found is None else found.unionByName(counted)
    if found is None:
        return slim.limit(0).select("site", F.lit("").alias("keyword"), *(F.lit(0).cast("bigint").alias(c) for c in places))
    return found
