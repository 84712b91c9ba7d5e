"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, new_folder, small_batches

#: Bytes in a row of a payload image (every second number of rows is stored as a bitmap); tiles are square; the difference hash compares 8 x 9 areas.
WIDTH, TILE, HASH_SHAPE = 64, 16, (8, 9)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
_COMMENT = re.compile(rb"#\s*bytes\s+(\d+)")


def encode_payload(text: str | None) -> bytes:
    """A whole text as 8-bit samples: its UTF-8 bytes, then bytes 0 up to a positive multiple of 64.

    An odd number of rows is stored as a graymap, an even one as a bitmap. A comment of the graymap, the reserved field of
    the bitmap, holds how many bytes the text has or how many bytes 0 follow it.
    """
    body = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(body) // WIDTH))
    if rows % 2 == 0:
        image = np.frombuffer(body.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
        return encode_bmp(image, rows * WIDTH - len(body))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(body), WIDTH, rows) + body.ljust(rows * WIDTH, b"\0")


def decode_payload(media: bytes) -> tuple[np.ndarray, int]:
    """The samples of a payload image and the bytes that its text has."""
    image = decode(media)
    if media[:2] == b"BM":
        return image, image.size - struct.unpack_from("<I", media, 6)[0]
    return image, int(_COMMENT.search(media, 0, 64)[1])


def decode(media: bytes) -> np.ndarray:
    """Array of a Netpbm (P1 to P6) or BMP (8, 24 or 32 bits, not compressed) image: rows x columns, or x channels."""
    if media[:2] == b"BM":
        return _decode_bmp(media)
    if media[:1] != b"P" or media[1:2] not in b"123456" or len(media) < 3:
        raise ValueError("neither Netpbm nor BMP")
    kind, at, numbers = int(media[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(media, at)
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    if kind == 1:
        digits = re.sub(rb"#[^\n]*\n|\s", b"", media[at:])[: width * height]
        return (1 - (np.frombuffer(digits, np.uint8) - 48)).reshape(shape).astype(np.uint8) * 255
    if kind in (2, 3):
        return _scaled(np.array(re.sub(rb"#[^\n]*\n", b" ", media[at:]).split()[: int(np.prod(shape))], np.int64).reshape(shape), most)
    at += 1  # one white space ends the header
    if kind == 4:
        rows = np.frombuffer(media, np.uint8, height * -(-width // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    return _scaled(np.frombuffer(media, np.uint8 if most < 256 else ">u2", int(np.prod(shape)), at).reshape(shape), most)


def _scaled(samples: np.ndarray, most: int) -> np.ndarray:
    """Samples up to ``most`` as 8-bit ones, or as 16-bit ones beyond 255."""
    kind, top = (np.uint8, 255) if most < 256 else (np.uint16, 65535)
    return samples.astype(kind) if most in (0, top) else ((samples.astype(np.int64) * top + most // 2) // most).clip(0, top).astype(kind)


def _decode_bmp(media: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", media)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits > 8:
        return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    colours = struct.unpack_from("<I", media, 46)[0] or 256
    palette = np.frombuffer(media, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
    gray = (palette == palette[:, :1]).all()
    return palette[rows][:, :, 0] if gray else palette[rows]


_PALETTE = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy()
_PALETTE[:, 3] = 0
_PALETTE = _PALETTE.tobytes()


def encode_bmp(gray: np.ndarray, reserved: int = 0) -> bytes:
    """An 8-bit grayscale BMP of a two-dimensional array; ``reserved`` goes to the header's reserved field."""
    height, width = gray.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = gray[::-1]
    start = 54 + 1024
    return struct.pack("<2sIII", b"BM", start + rows.size, reserved, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0) + _PALETTE + rows.tobytes()


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area that each cell of the smaller (or larger) grid covers, from an integral image."""
    gray = image.mean(axis=2) if image.ndim == 3 else image
    height, width = gray.shape
    total = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.arange(edges + 1) * (size / edges)
        low = np.minimum(place.astype(np.int64), size - 1)
        return low, low + 1, place - low

    y0, y1, dy = at(rows, height)
    x0, x1, dx = at(columns, width)
    lines = total[y0] * (1 - dy)[:, None] + total[y1] * dy[:, None]
    corners = lines[:, x0] * (1 - dx) + lines[:, x1] * dx
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (rows * columns / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hexadecimal digits: whether an area is darker than the one on its right."""
    cells = np.round(area_resize(image, *HASH_SHAPE), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to a square of 8-bit samples, as an NPY file."""
    out = io.BytesIO()
    top = 255 if image.dtype == np.uint8 else 65535
    np.save(out, np.clip(np.rint(np.round(area_resize(image, side, side), 6) * (255 / top)), 0, 255).astype(np.uint8, order="C"), allow_pickle=False)
    return out.getvalue()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_payload(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])


def store_texts(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Write every whole text as an image to ``folder`` and return what is stored: doc_id, media.

    Null texts are stored as empty ones, repeated rows once each; null doc_ids stay null.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(_encode, "doc_id bigint, media binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("doc_id bigint, media binary").parquet(folder)


def _features(media: bytes) -> tuple[int | None, int | None, int | None, str, bytes]:
    image = decode(media)
    if not image.size:
        return image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, None, None
    return image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), npy_tile(image)


def tiles(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with rows, columns, channels, dhash and tile (an NPY file) of each image; all null for null and for what is no image;
    dhash and tile null for an image without pixels. Samples of less depth are scaled to 8 bits, deeper ones to 16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    out.append(_features(m))
                except (ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error):
                    out.append((None,) * 5)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            more = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rows", "columns", "channels", "dhash", "tile"])

    fields = ", ".join(f"`{n}` {t}" for n, t in media.dtypes)
    return media.mapInArrow(run, f"{fields}, rows int, columns int, channels int, dhash string, tile binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    for batch in batches:
        out = []
        for media in batch.column(1).to_pylist():
            image, n = decode_payload(media)
            payload = image.tobytes()
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image)))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Digests of the stored images of every whole text, computed from what is read back.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature (difference hash), tile_sha256 (of the tile as it is stored beside the media). One row per row of ``docs``; null texts count as empty.
    An empty table gives no rows; other columns are not read.
    """
    stored = store_texts(docs, new_folder(docs.sparkSession, "media"), text)
    found = stored.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary")
    written = materialise(found, "tiles")
    return written.select(*(c for c in written.columns if c != "tile"), F.sha2("tile", 256).alias("tile_sha256"))
