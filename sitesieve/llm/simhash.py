"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. For each segment its Hamming ball of radius one is enumerated while
the other segment stays as it is, and the fingerprint is entered in a table under each of these 65 keys. Two
fingerprints within two bits of each other always meet: with both differing bits in one segment at the key that
has one of them flipped, with one bit in either segment at the key that has the first segment of one and the
second of the other. Every fingerprint under a key is within one bit of it, so a key holds 65 distinct ones at
most and no bucket can grow with the corpus. Matches are verified on the complete distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches

#: Words in a shingle and differing bits of a link.
SHINGLE, RADIUS, SEED = 3, 2, 42
_BLOCK = 1 << 16


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of one text: bit i is set if it is set in over half the XXH64 of its word shingles.

    Null and white space only: zero. Fewer words than ``size``: the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    total = max(1, len(words) - size + 1)

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, total, _BLOCK):
            part = words[at : at + _BLOCK + size - 1] if total > 1 else words
            shingles = zip(*(part[k:] for k in range(size)), strict=False) if len(part) >= size else [part]
            yield np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)

    return fingerprint(hashes())


def fingerprint(parts: Iterable[np.ndarray]) -> int:
    """The 64 bits that are set in over half of all hashes of ``parts``."""
    ones, total = np.zeros(64, np.int64), 0
    for part in parts:
        ones += np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints ``fp`` within two bits, enough of them to connect all that are linked.

    Under each key of the table the smallest fingerprint is linked to the others, never each with each.
    """
    flips = [1 << k for k in range(63)] + [-(1 << 63)]
    # the bitmap of a key says which of its neighbours are there: bit k for the one with bit k flipped
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # each row becomes 65
    probes = spread.select("fp", F.explode(F.transform(F.lit([0, *flips]), lambda flip: F.struct(F.col("fp").bitwiseXOR(flip).alias("key"), flip.alias("flip")))).alias("p"))
    table = probes.groupBy("p.key").agg(F.bit_or("p.flip").alias("there"), F.bool_or(F.col("p.flip") == 0).alias("itself"))
    met = table.filter(F.bit_count("there") + F.col("itself").cast("int") > 1)
    members = F.concat(
        F.when(F.col("itself"), F.array("key")).otherwise(F.expr("array()").cast("array<bigint>")),
        F.transform(F.filter(F.lit(flips), lambda flip: F.col("there").bitwiseAND(flip) != 0), lambda flip: F.col("key").bitwiseXOR(flip)),
    )
    star = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return star.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): node, root (its smallest node).

    Each round takes the smallest root among a node and its neighbours and then the root of that root, so the
    rounds grow with the logarithm of a component's diameter. Every round is checkpointed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")).checkpoint()
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("low"))
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "low").alias("next")).checkpoint()
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("up"))
        moved = hooked.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("new"), "root").checkpoint()
        if moved.filter("new <> root").isEmpty():
            return moved.select("node", F.col("new").alias("root"))
        roots = moved.select("node", F.col("new").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, component_size, n_links.

    Documents whose fingerprints differ in at most two bits are linked; component_id is the smallest doc_id that
    can be reached. Null, empty and white-space-only texts have fingerprint zero and are linked like any other.
    Repeated rows each keep a row. A null doc_id takes part and never names a component unless it has no other.
    ``n_links`` counts the other distinct fingerprints of the component. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, text), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    roots = components(links(distinct.select("fp")))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("component_size"), (F.count(F.lit(1)) - 1).alias("n_links"))
    classes = grouped.select("fp", "root").join(named, "root")
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
        "n_links",
    )
