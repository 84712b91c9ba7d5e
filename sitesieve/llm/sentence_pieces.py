"""Encoding and decoding with SentencePiece vocabularies of the merge type.

A text is normalised as its model says and its characters are joined pair by pair: of all adjacent symbols whose
concatenation is a piece, an agenda gives the pair of the best score, leftmost first, and each join enters the pairs
with its two neighbours. What no piece covers becomes bytes.

A join never reaches over two characters that no piece of the vocabulary holds side by side, so a text is cut at such
places and each part is joined once and then looked up. Parts come from Arrow batches of texts; all parts of a batch
that were not seen before are checked against the sentencepiece library before their ids are used.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import small_batches
from sitesieve.llm.tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts that a worker remembers at most, in each of two generations, and the characters of a part that is remembered.
CACHE_PARTS, LONGEST = 600_000, 48
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_PLACE = (1 << 32) - 1
_CODECS: dict = {}


class Mismatch(ValueError):
    """The agenda and the sentencepiece library differ."""


class PieceCodec:
    """Ids of texts by an agenda of pairs; texts of ids by the library."""

    def __init__(self, path: str, limit: int = CACHE_PARTS):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = {k: model.id_to_piece(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, self.bytes)) or any(map(model.is_unused, names)):
            raise ValueError(f"{path}: a vocabulary with byte pieces and without unused ones is needed")
        self.id_of = {name: k for k, name in names.items()}
        best_first = {s: place for place, s in enumerate(sorted({model.get_score(k) for k in names}, reverse=True), 1)}
        self.rank = {name: best_first[model.get_score(k)] << 32 for k, name in names.items() if len(name) > 1}
        self.side_by_side = {name[k : k + 2] for name in self.rank for k in range(len(name) - 1)}
        #: Words can be told apart by their leading space if no piece goes on behind one.
        self.by_word = not any(pair[0] != SPACE and pair[1] == SPACE for pair in self.side_by_side)
        held = set("".join(names.values()))
        #: A character that is in no piece, so that nothing is joined with it, and that stays as it is.
        self.wall = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in held and model.Normalize(c) == SPACE + c)
        self.limit, self.seen, self.old, self.unchecked = limit, {}, {}, {}

    def joined(self, part: str) -> list[str]:
        """The symbols that are left when no adjacent two make a piece."""
        symbols, n, rank = list(part), len(part), self.rank.get
        after, before, valid = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        agenda = []
        for k in range(n - 1):
            if r := rank(part[k : k + 2]):
                valid[k] = r | k
                agenda.append(r | k)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & _PLACE
            if valid[left] != entry:
                continue  # one of the two has become part of another symbol
            right = after[left]
            symbols[left] += symbols[right]
            symbols[right], valid[right], valid[left] = "", 0, 0
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if r := rank(symbols[left] + symbols[far]):
                    valid[left] = r | left
                    heappush(agenda, r | left)
            if (near := before[left]) >= 0:
                valid[near] = 0
                if r := rank(symbols[near] + symbols[left]):
                    valid[near] = r | near
                    heappush(agenda, r | near)
        return [s for s in symbols if s]

    def _ids(self, part: str) -> bytes:
        out = array("I")
        for symbol in self.joined(part):
            k = self.id_of.get(symbol)
            if k is None:
                out.extend(self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass"))
            else:
                out.append(k)
        return out.tobytes()

    def _remember(self, part: str, ids: bytes) -> bytes:
        if len(part) <= LONGEST:
            if len(self.seen) >= self.limit:
                self.old, self.seen = self.seen, {}
            self.seen[part] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part that is joined on its own."""
        found = self.seen.get(part) or self.old.get(part)
        if found is None:
            found = self.unchecked[part] = self._ids(part)
        return self._remember(part, found)

    def _word(self, word: str) -> bytes:
        """Ids of a word: of its parts between characters that no piece holds side by side."""
        if found := self.old.get(word):
            return self._remember(word, found)
        inside, at, out = self.side_by_side, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                out.append(self._part(word[at:k]))
                at = k
        if not at:
            return self._part(word)
        out.append(self._part(word[at:]))
        return self._remember(word, b"".join(out))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, without begin and end ids; none for null and empty texts.

        New parts of all texts are checked against the library together; ``Mismatch`` names the first that differs.
        """
        out, word_of, seen = [], self._word, self.seen.get
        for text in texts:
            plain = self.library.Normalize(text) if text else ""
            words = _WORDS.findall(plain) if self.by_word else [plain] * bool(plain)
            out.append(b"".join([seen(w) or word_of(w) for w in words]))
            seen = self.seen.get  # a new generation may have begun
        self._check()
        return out

    def _check(self) -> None:
        """The library has to give the same ids for every part behind a wall."""
        new, self.unchecked = self.unchecked, {}
        if not new:
            return
        ahead = len(self._ids(SPACE + self.wall)) // 4
        for (part, ids), theirs in zip(new.items(), self.library.encode([self.wall + p.replace(SPACE, " ") for p in new], num_threads=1), strict=True):
            if np.array(theirs[ahead:], "<u4").tobytes() != ids:
                raise Mismatch(f"{part!r}: {np.frombuffer(ids, '<u4').tolist()}, the library {theirs[ahead:]}")

    def decode_all(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) if ids else []


def codec(path: str, limit: int = CACHE_PARTS) -> PieceCodec:
    """One codec for each file in a worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path, limit)
    return _CODECS[path]


def _bounds(path: str) -> tuple[bytes, bytes]:
    model = codec(path).library
    return np.array([model.bos_id()], "<u4").tobytes(), np.array([model.eos_id()], "<u4").tobytes()


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (begin id, ids of the whole text, end id), decoded (the text of these ids).

    Null and empty texts are the two ids alone. Repeated rows and null doc_ids are rows like any other; an empty table
    gives none. Columns other than doc_id and the text are not read. The job fails with ``Mismatch`` if the library would
    give other ids.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, end = _bounds(path)
        for batch in batches:
            found = [begin + x + end for x in codec(path).encode_all(batch.column(1).to_pylist())]
            ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in found)]), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(codec(path).decode_all(found), pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs, text).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """As ``encoded``, with digests in place of ids and texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, end = _bounds(path)
        for batch in batches:
            found = [begin + x + end for x in codec(path).encode_all(batch.column(1).to_pylist())]
            of_ids = [hashlib.sha256(x).hexdigest() for x in found]
            of_texts = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in codec(path).decode_all(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
