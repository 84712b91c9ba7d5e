"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are put in the order of a Hilbert curve and cut into blocks; a block keeps the least and greatest value of every
component, so two numbers bound the distance from any centroid to all of its vectors. In a round, a centroid whose lower
bound is above the smallest upper bound of another can't be the nearest of any vector of the block; the others are
compared with all vectors at once, in whole numbers. A block with one such centroid is added by its sum alone.
Rounds send sums per centroid and component, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a block, and bits of each component in the order of the curve.
BLOCK, BITS = 256, 4
#: Components of this size and more would overflow a distance; they are refused.
LIMIT = 1 << 27
#: Below this size every term of a distance is exact in double precision, so the faster matrix product may be taken.
_EXACT = 1 << 21


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of ``points`` (whole numbers of ``bits`` bits), as bytes that sort alike.

    Per bit plane, from the highest on, the lower bits are reflected or swapped with those of the first component, as the
    subcube that the plane selects is oriented; then the planes are Gray-decoded and interleaved.
    """
    x = points.astype(np.uint32).T.copy()  # a row for each component
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for k in range(n):
            reflected = (x[k] & bit) != 0
            swapped = np.where(reflected, np.uint32(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(reflected, x[0] ^ low, x[0] ^ swapped)
            x[k] ^= swapped
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance that a vector in the box can have from each centroid."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return (outside**2).sum(1), (across**2).sum(1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be the nearest one of some vector in the box, in ascending order."""
    least, most = box_bounds(low, high, centroids)
    return np.flatnonzero(least <= most.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each vector (ties: the first) and its squared distance; exact."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        far = (v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)
        far = far.astype(np.int64)
    else:
        far = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)
    at = far.argmin(1)
    return at, far[np.arange(len(at)), at]


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def _keyed(least: int, most: int, components: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (_matrix(batch.column(2), components).astype(np.int64) - least << bits) // (most - least + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits) if len(cells) else [], pa.binary())], ["vec_id", "tie", "q", "key"])

    return run


_BLOCKS = "vec_ids array<bigint>, low array<bigint>, high array<bigint>, total array<bigint>, vectors binary"


def _blocked(components: int, size: int):
    def block(ids: list, rows: np.ndarray) -> tuple:
        return ids, rows.min(0).tolist(), rows.max(0).tolist(), rows.sum(0).tolist(), rows.astype("<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], np.zeros((0, components), np.int64)
        kinds = [*[pa.list_(pa.int64())] * 4, pa.binary()]
        names = ["vec_ids", "low", "high", "total", "vectors"]
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows = np.concatenate([rows, _matrix(batch.column(1), components)])
            full = [block(ids[at : at + size], rows[at : at + size]) for at in range(0, len(ids) - size + 1, size)]
            ids, rows = ids[len(full) * size :], rows[len(full) * size :]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True), kinds, strict=True)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(block(ids, rows), kinds, strict=True)], names)

    return run


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, summed: bool) -> Iterator[tuple]:
    """For each block: its row number, its vectors and the numbers of their centroids and distances. With ``summed`` a block that has
    one candidate comes without vectors."""
    components = centroids.shape[1]
    low, high = (_matrix(batch.column(k), components) for k in (1, 2))
    for row in range(batch.num_rows):
        few = candidates(low[row], high[row], centroids)
        if summed and len(few) == 1:
            yield row, None, int(few[0]), None
            continue
        vectors = np.frombuffer(batch.column(4)[row].as_buffer(), "<i4").reshape(-1, components).astype(np.int64)
        at, far = nearest(vectors, centroids[few])
        yield row, vectors, few[at], far


def _sums_of(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, components = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for batch in batches:
            for row, vectors, cluster, _ in _assigned(batch, centroids, True):
                if vectors is None:
                    count[cluster] += len(batch.column(0)[row])
                    total[cluster] += batch.column(3)[row].values.to_numpy()
                else:
                    count += np.bincount(cluster, minlength=k)
                    np.add.at(total, cluster, vectors)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _members_of(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, cluster, far in _assigned(batch, centroids, False):
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and q of the rows with exactly ``components`` components, none null, NaN or infinite; q has floor(scale * x) of each."""
    x = F.col(column).cast("array<double>")
    big = float(LIMIT // scale)
    whole = F.transform(F.col("x"), lambda v: F.when(F.abs(v) < big, F.floor(v * float(scale))).otherwise(F.raise_error(F.lit(f"a component is {big:.0f} or more"))).cast("bigint"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter((F.size("x") == components) & finite).select("vec_id", whole.alias("q"))


def blocks(kept: DataFrame, components: int = COMPONENTS, size: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The vectors in blocks along the curve, written once. Equal vectors spread over as many tasks as their rows need."""
    ends = kept.agg(F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).first()
    least, most = (0, 0) if ends.least is None else (ends.least, ends.most)
    rows = kept.select("vec_id", F.xxhash64(F.monotonically_increasing_id()).alias("tie"), "q")
    keyed = rows.mapInArrow(_keyed(least, most, components, bits), "vec_id bigint, tie bigint, q array<bigint>, key binary")
    ordered = materialise(keyed, "keyed").repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("vec_id", "q")
    return materialise(ordered.mapInArrow(_blocked(components, size), _BLOCKS), "blocks")


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: str = "1") -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256; ties by vector, null ids last. Fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.q for r in kept.orderBy(key.asc_nulls_last(), "q").limit(k).collect()], np.int64)  # k vectors


def moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; one without vectors stays."""
    parts = zones.mapInArrow(_sums_of(centroids), "cluster int, n bigint, total array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("pos", "v")).groupBy("cluster", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r.cluster, r.pos] = int(r.v) // r.n
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, size: int = BLOCK, seed: str = "1") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, and those with a null, NaN or infinite component, are left out; a component of 2^21 or more
    is an error, as distances would not fit. With fewer vectors than centroids each is a centroid. Repeated rows and null
    vec_ids are rows like any other. An empty table gives no rows. Columns other than vec_id and the vector are not read.
    """
    small_batches(vectors.sparkSession)
    kept = quantised(vectors, column, components, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    zones = blocks(kept, components, size)
    for _ in range(rounds):
        centroids = moved(zones, centroids)
    members = materialise(zones.select("vec_ids", "low", "high", "total", "vectors").mapInArrow(_members_of(centroids), "vec_id bigint, cluster int, distance bigint"), "members")
    spread = {r.cluster: r.d for r in members.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(spread.values())
    named = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in spread.items()]
    facts = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
