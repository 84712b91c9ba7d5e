"""Near copies by the similarity of whole shingle sets.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates come from
SimHash fingerprints of the sets first, by the multi-index table of ``simhash``: those within two bits. At a similarity
of 0.8 fingerprints differ in about ten of 64 bits, and no ball of that radius can be enumerated, so what they leave
apart comes from min-hashes: 50 bands of 6, a key for each. Two sets of similarity s share a key with probability
1 - (1 - s^6)^50: all but 3 in ten million at 0.8, fewer still above. Every candidate is verified on the complete sets.

A key that many sets have is not paired each with each. Its sets are compared with one of them first (another one for
each key); only sets that are still in different components after that are compared with each other, and of those only
the ones that have enough shingles in common with any other and whose parity bitmaps don't differ in more bits than
sets that are similar enough can. The bitmaps are exact in one direction: each differing bit stands for a differing shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import BROADCAST_IDS, materialise, small_batches, unused
from sitesieve.llm.simhash import components, fingerprint
from sitesieve.llm.simhash import links as fingerprint_links

#: Words in a shingle and the least similarity of a link, as a ratio of whole numbers.
SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, BAND_ROWS, SEED = 50, 6, 42
#: Bands whose keys are tried first; they connect most of what there is to connect.
FIRST_BANDS = 2
#: Sets, and shingles of all of them, that are sent to every executor at most (8 bytes each).
BROADCAST_SETS, BROADCAST_SHINGLES = 50_000, 2_000_000
#: Bits of a parity bitmap. Sets whose difference is much larger are never told apart by it and are compared in full.
PARITY = 1024
_BLOCK = 512
_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. Fewer words than ``size``: the whole sequence is the one shingle.

    Null and white space only: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as op9 has them
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = len(words) - size + 1
    found = np.zeros(total, np.uint64)
    for k in range(size):
        found += _mixed(hashes[k : k + total] * _PLACE[k])
    return np.unique(_mixed(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the same for two sets if all of the band's min-hashes are."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (_TIMES * hashes[at : at + _BLOCK] + _PLUS).min(1), out=least)
    return _mixed((_mixed(least).reshape(BANDS, BAND_ROWS) * _PLACE[:BAND_ROWS]).sum(1, dtype=np.uint64) ^ _BAND)


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit is 1 if an odd number of shingles falls on it: bits that differ are at most as many as shingles that only one set has."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity, size, fingerprint and band keys of each text's set; the set itself isn't kept."""
    for batch in batches:
        rows = [(name_of(s), len(s), fingerprint([s]), band_keys(s)) for s in map(shingle_set, batch.column(2).to_pylist())]
        ids, sizes, prints, keys = zip(*rows, strict=True) if rows else ([],) * 4
        flat = np.concatenate(keys).view(np.int64) if rows else []
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS), pa.int32()), pa.array(flat, pa.int64()))
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()), bands]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "id", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(map(shingle_set, batch.column(0).to_pylist()))
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
        words = PARITY // 64
        bits = pa.array(np.concatenate(list(map(parities, sets))) if sets else [], pa.int64())
        parity = pa.ListArray.from_arrays(pa.array(np.arange(0, words * len(sets) + 1, words), pa.int32()), bits)
        yield pa.RecordBatch.from_arrays([pa.array(map(name_of, sets), pa.int64()), shingles, parity], ["id", "shingles", "parity"])


def name_of(hashes: np.ndarray) -> int:
    """The same for texts with the same set of shingles."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _alike(common, n, m):
    return common * (SIMILARITY[0] + SIMILARITY[1]) >= (n + m) * SIMILARITY[0]


def _near_enough(n, m):
    """Of columns ``parity`` and ``parity_b`` of two sets of n and m shingles: no more bits differ than shingles may."""
    differing = sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64))
    return differing * (SIMILARITY[0] + SIMILARITY[1]) <= (n + m) * (SIMILARITY[1] - SIMILARITY[0])


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of the candidates (a, b) those that are similar enough; sizes are looked at before the sets (id, n, shingles) are."""
    wanted = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = held.select("id", "n")
    sized = wanted.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
    possible = materialise(sized.filter(F.least("n", "m") * SIMILARITY[1] >= F.greatest("n", "m") * SIMILARITY[0]), "pairs")
    used = held.join(possible.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    size = used.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).first()
    sent = F.broadcast if size.sets <= BROADCAST_SETS and (size.shingles or 0) <= BROADCAST_SHINGLES else lambda df: df
    with_a = possible.join(sent(used.select(F.col("id").alias("a"), F.col("shingles").alias("s"))), "a")
    both = with_a.join(sent(used.select(F.col("id").alias("b"), F.col("shingles").alias("t"))), "b")
    return materialise(both.filter(_alike(F.size(F.array_intersect("s", "t")), F.col("n"), F.col("m"))).select("a", "b"), "links")


def _cores(held: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, parity and core of sets: how many of a set's shingles any other of these sets has. Those that only one set has can't be
    in what two have in common, so a link needs 9 * core >= 4 * (n + m) on either side, and 5 * core >= 4 * n with any other."""
    some = held.join(ids.toDF("id"), "id", "left_semi").select("id", "n", "shingles", "parity")
    lone = some.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("id")).filter("sets = 1")
    return some.select("id", "n", "parity").join(lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone")), "id", "left").select("id", "n", "parity", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("core"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be sent to all executors if it has few rows; it is read from disk either way."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _of_prints(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) by fingerprints: each set with the first of its own, and first sets within two bits."""
    first = distinct.groupBy("fp").agg(F.min("id").alias("b"))
    same = distinct.select(F.col("id").alias("a"), "fp").join(first, "fp").filter("a <> b").select("a", "b")
    near = fingerprint_links(first.select("fp"))
    return same.unionByName(near.join(first.toDF("a", "ida"), "a").join(first.toDF("b", "idb"), "b").select(F.col("ida").alias("a"), F.col("idb").alias("b")))


def _classes(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text_hash and root (the same for all that links reach) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    sets = materialise(rows.mapInArrow(_keys, "doc_id bigint, text_hash bigint, id bigint, n int, fp bigint, bands array<bigint>"), "shingles")

    # the keys that more than one set has, each with the set that the others are compared with first: another for each key
    distinct = materialise(sets.filter("n > 0").groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("n", "fp", "text_hash", "bands"))), "bands")
    keys = distinct.select("id", F.posexplode("bands").alias("band", "key"))
    mixed = F.col("id").bitwiseXOR(F.col("key"))
    shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min(mixed).alias("least")).filter("sets > 1").select("key", F.col("least").bitwiseXOR(F.col("key")).alias("b")), "keys")
    entries = materialise(keys.join(_small(shared), "key").select("key", "band", F.col("id").alias("a"), "b"), "entries")
    prints = materialise(_of_prints(distinct), "prints")

    # the sets of candidates, made of their texts again: all sets together are larger than the texts
    ids = entries.select("a").union(prints.select(F.explode(F.array("a", "b")))).distinct()
    texts = materialise(distinct.join(ids, F.col("id") == F.col("a"), "left_semi").select("text_hash").distinct(), "texts")
    again = rows.join(_small(texts), "text_hash", "left_semi").select("text").mapInArrow(_sets, "id bigint, shingles array<bigint>, parity array<bigint>")
    held = materialise(again.groupBy("id").agg(F.any_value("shingles").alias("shingles"), F.any_value("parity").alias("parity")).withColumn("n", F.size("shingles")), "sets")

    def roots(links: DataFrame) -> DataFrame:
        return components(links).select(F.col("node").alias("a"), "root")

    def apart_in(pairs: DataFrame, links: DataFrame) -> DataFrame:
        of = roots(links)
        return pairs.join(of, "a", "left").join(of.toDF("b", "other"), "b", "left").filter("coalesce(root, a) <> coalesce(other, b)").select("a", "b")

    links = _verified(prints, held)
    stars = entries.filter("a <> b")
    links = links.union(_verified(apart_in(stars.filter(F.col("band") < FIRST_BANDS), links), held))
    links = links.union(_verified(apart_in(stars, links), held))
    # what is left of the keys: sets of different components, each with each
    placed = entries.join(roots(links), "a", "left").select("key", "a", F.coalesce("root", "a").alias("root"))
    several = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("several")).filter("several").select("key")
    left = materialise(placed.join(several, "key"), "left")
    cores = _cores(held, left.select("a").distinct()).filter("5 * core >= 4 * n")
    left = materialise(left.join(cores.withColumnRenamed("id", "a"), "a").select("key", "a", "root", "n", "core", "parity"), "cores")
    fits = (F.col("root") < F.col("other")) & (9 * F.least("core", "core_b") >= 4 * (F.col("n") + F.col("m"))) & _near_enough(F.col("n"), F.col("m"))
    crossed = left.join(left.toDF("key", "b", "other", "m", "core_b", "parity_b"), "key").filter(fits).select("a", "b")
    links = links.union(_verified(crossed, held))

    return sets.select("doc_id", "text_hash", "id").join(roots(links).withColumnRenamed("a", "id"), "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest doc_id that links reach).

    Null, empty and white-space-only texts are copies of each other. Repeated rows each keep a row. A null doc_id takes
    part and never names a component unless it has no other. An empty table gives no rows.
    """
    classes = _classes(docs, text)
    named = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return classes.join(named, "root").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so a doc_id that stands for several texts, or is null, loses only what is a
    copy. A null doc_id stays only where a component has no other; of different texts with one doc_id that of the
    smallest hash stays, of repeated rows any one. Columns may have any name. An empty table gives no rows.
    """
    rows = _classes(docs, text).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    doc, key, one = (unused(name, docs) for name in ("_doc", "_key", "_one"))
    placed = rows.join(first, "root").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(key), (F.col("first") == place).alias(one), "n")
    marked = materialise(placed.filter(~F.col(one) | (F.col("n") > 1)).drop("n"), "copies")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text).cast("string")) == F.col(key))
    kept = docs.join(_small(marked.drop(one)), same, "left_anti")
    again = marked.filter(one).drop(one)
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(_small(again), same, "left_semi").dropDuplicates(["doc_id", text]))
