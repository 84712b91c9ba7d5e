"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts it into chunks where the content says so; equal chunks of any two
documents get the same digest and are stored once. A document is a recipe: the digests of its chunks in order and
their Merkle root. The recipes are written in ascending doc_id order, in ranges of about RANGE_DOCS documents; the
manifest holds the Merkle root over the roots of each range, which reading computes again from the chunks' contents.

Files below the store's folder, all Parquet: ``objects/kind=chunk`` (digest, ids as little-endian unsigned 16- or
32-bit integers), ``objects/kind=recipe`` (recipes as they were made), ``recipes`` (the same in order, with their
range) and ``manifest``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches
from sitesieve.llm.tokens import CACHE_WORDS_ALONE, encoder, vocabulary

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Ids in a chunk: at least, about, at most; ids that the rolling hash looks back on.
LEAST, ABOUT, MOST, LOOK_BACK = 64, 256, 1024, 16
DIGEST = 16
#: Documents in a row of the manifest, about.
RANGE_DOCS = 20_000
_OBJECTS = "kind string, key binary, doc_id bigint, row_id bigint, n_tokens bigint, body binary, root binary"


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of the last LOOK_BACK ids at each place: sum of mixed ids, each shifted by its age."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = 1
    while width < LOOK_BACK:
        older = h[:-width] << np.uint64(width)
        h = np.concatenate([h[:width], h[width:] + older])
        width *= 2
    return h


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end."""
    return np.flatnonzero(rolling_hash(ids) % np.uint64(ABOUT) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids, from the marks in it."""
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(last := m)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a document; the last is its length."""
    return _ends(_marks(ids).tolist(), len(ids))


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; an odd one goes up as it is."""
    while len(leaves) > 1:
        pairs = [digest(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0] if leaves else digest(b"")


def _objects(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of one input partition
        end = np.array([end_id], "<u4").tobytes()
        wide = np.dtype(kind).itemsize
        for batch in batches:
            docs, numbers, texts = (batch.column(k).to_pylist() for k in range(3))
            encoded = [e + end for e in encoder(path, CACHE_WORDS_ALONE).encode_all(texts)]
            # One pass over the batch: a chunk has more ids than the hash looks back on, so a mark that counts never
            # depends on the document before.
            ids = np.frombuffer(b"".join(encoded), "<u4")
            if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                raise ValueError(f"id {int(ids.max())} doesn't fit {kind}")
            stops = np.cumsum([len(e) // 4 for e in encoded])
            marks = _marks(ids) if len(ids) else np.zeros(0, int)
            first = np.searchsorted(marks, np.concatenate([[0], stops[:-1]]), "right").tolist()
            last = np.searchsorted(marks, stops, "right").tolist()
            marks, stored, begin = marks.tolist(), memoryview(ids.astype(kind).tobytes()), 0
            keys, sizes, bodies, totals, lists, roots = [], [], [], [], [], []
            for lo, hi, stop in zip(first, last, stops.tolist(), strict=True):
                names, at = [], 0
                for to in _ends([m - begin for m in marks[lo:hi]], stop - begin):
                    body = stored[(begin + at) * wide : (begin + to) * wide]
                    names.append(key := digest(body))
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sizes.append(to - at)
                        bodies.append(bytes(body))
                    at = to
                totals.append(stop - begin)
                lists.append(b"".join(names))
                roots.append(merkle(names))
                begin = stop
            none, no = [None] * len(keys), len(docs)
            columns = (
                ["chunk"] * len(keys) + ["recipe"] * no, keys + [digest(b"%d" % r) for r in numbers], none + docs, none + numbers, sizes + totals, bodies + lists, none + roots,
            )
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "key", "doc_id", "row_id", "n_tokens", "body", "root"])

    return run


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, text: str = "text", id_type: str = "<u2") -> None:
    """Encode every whole text, append ``end_id`` and write the store. Null texts count as empty.

    ``id_type`` is "<u2" for vocabularies below 65,536 ids, else "<u4". Repeated rows and null doc_ids each get a
    recipe. An empty table makes an empty store; other columns are not read. Executors that are lost don't change the
    store: row numbers and digests are the same when a task runs again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_objects(path or vocabulary(VOCABULARY), end_id, id_type), _OBJECTS)
    # equal objects meet in one task, and the first of each stays; a neighbour's key is enough to tell
    same = Window.partitionBy("kind", "key").orderBy("row_id")
    unique = found.withColumn("_before", F.lag("key").over(same)).filter("_before is null").drop("_before")
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/objects")
    made = _objects_of(spark, folder, "recipe").select("doc_id", "row_id", "n_tokens", F.col("body").alias("chunks"), "root")
    in_order = made.repartitionByRange(max(1, made.count() // RANGE_DOCS), "doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    in_order.withColumn("range", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    range_roots(recipes(spark, folder)).write.parquet(f"{folder}/manifest")


def _objects_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "key binary, doc_id bigint, row_id bigint, n_tokens bigint, body binary, root binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/objects").filter(F.col("kind") == kind)


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, row_id bigint, n_tokens bigint, chunks binary, root binary, range int").parquet(f"{folder}/recipes")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _objects_of(spark, folder, "chunk").select(F.col("key").alias("digest"), F.col("body").alias("ids"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


_MANIFEST = "range int, first_doc bigint, last_doc bigint, n_docs bigint, n_tokens bigint, root binary"
_MANIFEST_ARROW = pa.schema([("range", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])


def _range_root(rows: pa.Table) -> pa.Table:
    order = pa.table({"d": rows["doc_id"].fill_null(-(2**63)), "r": rows["row_id"]}).sort_by([("d", "ascending"), ("r", "ascending")])
    at = {r: k for k, r in enumerate(order["r"].to_pylist())}
    roots: list[bytes] = [b""] * rows.num_rows
    for r, root in zip(rows["row_id"].to_pylist(), rows["root"].to_pylist(), strict=True):
        roots[at[r]] = root
    ids = [d for d in rows["doc_id"].to_pylist() if d is not None]
    return pa.table([[rows["range"][0].as_py()], [min(ids, default=None)], [max(ids, default=None)], [rows.num_rows], [sum(rows["n_tokens"].to_pylist())], [merkle(roots)]], schema=_MANIFEST_ARROW)


def range_roots(rows: DataFrame) -> DataFrame:
    """A row of the manifest for each range of ``rows`` (range, doc_id, row_id, n_tokens, root); a range is bounded by RANGE_DOCS."""
    return rows.select("range", "doc_id", "row_id", "n_tokens", "root").groupBy("range").applyInArrow(_range_root, _MANIFEST)


def _read_chunks(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, b in zip(keys, bodies, strict=True):
                if digest(b) != k:
                    raise ValueError(f"chunk {k.hex()} does not have the content that its name says")
            wide = memoryview(np.frombuffer(b"".join(bodies), kind).astype("<u4").tobytes())
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // np.dtype(kind).itemsize
            ends = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(wide[begin:end]) for begin, end in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return run


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> list[list[int]]:
    """What bytes 0 behind a part do to its CRC-32, as a table for each of the CRC's four bytes."""
    power, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            power = _times(square, power)
        square, n = _times(square, square), n >> 1
    bits = [_times(1 << k, power) for k in range(32)]
    tables = []
    for low in (0, 8, 16, 24):
        table = [0]
        for k in range(8):
            table += [x ^ bits[low + k] for x in table]
        tables.append(table)
    return tables


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation of parts, from the bytes and the CRC-32 of each."""
    out = 0
    for n_bytes, crc in parts:
        a, b, c, d = _shift(n_bytes)
        out = a[out & 255] ^ b[out >> 8 & 255] ^ c[out >> 16 & 255] ^ d[out >> 24] ^ crc
    return out


def _chunk_names() -> Column:
    count = F.octet_length("chunks") / DIGEST
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: F.substring(F.col("chunks"), k * DIGEST + 1, F.lit(DIGEST)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents put together from what their chunks hold."""
    for batch in batches:
        parts = batch.column(5)
        ends, flat = parts.offsets.to_pylist(), parts.values
        names, n, crc = (flat.field(k).to_pylist() for k in ("digest", "n", "crc"))
        crcs = []
        for row, total, root, begin, end in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), ends, ends[1:], strict=False):
            if None in n[begin:end] or sum(n[begin:end]) != total or merkle(names[begin:end]) != root:
                raise ValueError(f"a document cannot be put together: row {row}")
            crcs.append(joined_crc([(4 * x, c) for x, c in zip(n[begin:end], crc[begin:end], strict=True)]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(crcs, pa.int64())], ["range", "doc_id", "row_id", "n_tokens", "root", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str, id_type: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, root of every document, from the stored files.

    Each chunk is read once and checked against its digest. Its length and CRC-32 go to the recipes that name it,
    where the CRC-32 of the whole document is put together; the Merkle root of the digests has to be the stored one,
    and the root over each range of documents the manifest's. ``start`` sums ranges first, then within each range,
    so no task orders more than one range.
    """
    facts = chunks(spark, folder).mapInArrow(_read_chunks(id_type), "digest binary, n bigint, crc bigint")
    parts = recipes(spark, folder).select("range", "doc_id", "row_id", "n_tokens", "root", F.posexplode(_chunk_names()).alias("pos", "digest")).join(facts, "digest", "left")
    listed = parts.groupBy("range", "doc_id", "row_id", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("parts"))
    docs = materialise(listed.mapInArrow(_whole, "range int, doc_id bigint, row_id bigint, n_tokens bigint, root binary, ids_crc32 bigint"), "digests")
    said = manifest(spark, folder).select("range", F.col("root").alias("said"), F.col("n_tokens").alias("in_range"), F.col("n_docs").alias("docs_said"))
    found = range_roots(docs).select("range", F.col("root").alias("found"), F.col("n_docs").alias("docs_found"))
    ahead = F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")  # one row for each range
    sound = F.coalesce((F.col("said") == F.col("found")) & (F.col("docs_said") == F.col("docs_found")), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("the manifest does not hold for range "), F.col("range").cast("string"))).cast("bigint")
    ranges = said.join(found, "range", "full").select("range", F.when(sound, ahead).otherwise(failed).alias("ahead"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("ahead") + F.sum("n_tokens").over(order) - F.col("n_tokens")
    return docs.join(ranges, "range").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", F.lower(F.hex("root")).alias("root"))


def read_ids(spark: SparkSession, folder: str, id_type: str = "<u2") -> DataFrame:
    """doc_id, row_id, ids (array) of every document, put together from its chunks."""
    parts = recipes(spark, folder).select("doc_id", "row_id", F.posexplode(_chunk_names()).alias("pos", "digest"))
    bodies = parts.join(chunks(spark, folder), "digest").groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), id_type).astype("int32") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row_id", "ids"])

    return bodies.mapInArrow(whole, "doc_id bigint, row_id bigint, ids array<int>")
