"""Best-fit packing of documents into training sequences by linear grouping.

The pieces are dealt by a hash into shards of a bounded number of tokens, so a shard fits in one task whatever the
corpus holds. In a shard, large pieces are sorted by length and cut into groups of equal cardinality; each is
rounded up to the longest of its group. The few sizes that are left are combined into configurations by column
generation: a linear programme over all configurations, priced by knapsacks. Its whole sequences get actual pieces,
and what rounding up left free goes to small pieces and those of fractions of a sequence, longest first, each to the
sequence whose remaining room fits it most tightly. Where that takes more sequences than the lengths call for, a
bounded share of them, the least filled, is filled anew by subset sums.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches
from sitesieve.llm.tokens import CACHE_WORDS_ALONE, encoder, vocabulary

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.json"
#: Tokens of a shard, so that it fits in a task.
SHARD_TOKENS = 4096 * CAPACITY
#: Equal-cardinality groups of large pieces; a piece is large from this part of a sequence on.
GROUPS, LARGE = 64, 8
#: What made a sequence: one whole piece, a configuration (with small pieces in what it left free), or best fit alone.
MADE_BY = ("whole piece", "configuration", "best fit", "filled anew")
#: Share of a shard's sequences that are filled anew at most where there are more than their lengths call for.
REFILLED = 0.1
_SMALL = 1e-12
_PIECES = "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces_of(path: str, capacity: int, end_id: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            encoded = encoder(path, words).encode_all(batch.column(2).to_pylist())
            for doc, row, ids in zip(*(batch.column(k).to_pylist() for k in range(2)), encoded, strict=True):
                ids += end
                rows += [(doc, row, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"])

    return run


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often each size is in the configuration of the largest worth, and that worth: a knapsack over all capacities at once."""
    best, taken = np.zeros(capacity + 1), []
    for k in np.flatnonzero(worth > _SMALL):
        size = int(sizes[k])
        for _ in range(capacity // size):
            more = best[:-size] + worth[k]
            better = more > best[size:] + _SMALL
            if not better.any():
                break
            np.copyto(best[size:], more, where=better)
            taken.append((k, size, better))
    at, counts = capacity, np.zeros(len(sizes))
    for k, size, better in reversed(taken):
        if at >= size and better[at - size]:
            counts[k] += 1
            at -= size
    return counts, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a row for each, how often it has each size) and how many sequences of each: the optimum in fractions.

    Column generation: the simplex method over configurations, of which only those of the basis are ever written down. Its
    prices of the sizes go to a knapsack that either finds a configuration worth more than one sequence, which enters the
    basis, or proves that there is none.
    """
    n = len(sizes)
    basis, cost = np.diag((capacity // sizes).astype(float)), np.ones(n)
    inverse = np.diag(1 / np.diag(basis))
    for step in range(1, rounds + 1):
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        prices = cost @ inverse
        if prices.min() < -1e-9:  # a size that is better covered too often
            column, price = np.zeros(n), 0.0
            column[prices.argmin()] = -1
        else:
            column, worth = _best_configuration(sizes, prices, capacity)
            if worth <= 1 + 1e-6:
                break
            price = 1.0
        often, move = inverse @ demand, inverse @ column
        ratio = np.where(move > 1e-9, often / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price
        inverse[out] /= move[out]
        move[out] = 0
        inverse -= np.outer(move, inverse[out])
    often = np.linalg.solve(basis, demand)
    return basis.T[cost > 0].astype(np.int64), often[cost > 0]


class _Pieces:
    """Pieces by length, of which the longest that fits a room can be taken."""

    def __init__(self, lengths: np.ndarray, pieces: np.ndarray):
        self.of: dict[int, list[int]] = {}
        for p in pieces[::-1].tolist():
            self.of.setdefault(int(lengths[p]), []).append(p)
        self.there = sum(1 << n for n in self.of)

    def take(self, room: int) -> tuple[int, int] | None:
        """(piece, length) of the longest of at most ``room``."""
        n = (self.there & ((1 << room + 1) - 1)).bit_length() - 1
        if n <= 0:
            return None
        pieces = self.of[n]
        piece = pieces.pop()
        if not pieces:
            self.there ^= 1 << n
        return piece, n


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, and for each sequence what made it (a code of MADE_BY); every length is
    between 1 and ``capacity``."""
    large = large or max(2, capacity // LARGE)
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    big, small = order[(lengths[order] >= large) & (lengths[order] < capacity)], order[lengths[order] < large]
    members, made = [[p] for p in full.tolist()], [0] * len(full)
    used = [capacity] * len(full)
    # linear grouping: groups of equal cardinality, each rounded up to its longest piece
    demand: dict[int, int] = {}
    for part in np.array_split(big, min(groups, len(big)) or 1):
        if len(part):
            demand[int(lengths[part[0]])] = demand.get(int(lengths[part[0]]), 0) + len(part)
    sizes, wanted = np.array(sorted(demand, reverse=True), np.int64), np.array([demand[s] for s in sorted(demand, reverse=True)], np.int64)
    slots: list[list[int]] = []
    if len(sizes):
        forms, often = configurations(sizes, wanted.astype(float), capacity)
        for form, n in sorted(zip(forms.tolist(), np.floor(often + 1e-6).astype(int).tolist(), strict=True), reverse=True):
            each = [k for k, m in enumerate(form) for _ in range(m)]
            for _ in range(n):
                mine = []
                for k in each:  # the last one may be covered too often
                    if wanted[k]:
                        wanted[k] -= 1
                        mine.append(int(sizes[k]))
                if mine:
                    slots.append(mine)
    # actual pieces: each slot takes the longest piece that it is rounded up for, and the last one whatever still fits, so that
    # what rounding up has left free adds up in the last sequences
    pieces = _Pieces(lengths, big)
    for mine in slots:
        held, room = [], capacity
        for size in mine[:-1]:
            piece, n = pieces.take(size)
            held.append(piece)
            room -= n
        piece, n = pieces.take(room)
        members.append([*held, piece])
        used.append(capacity - room + n)
        made.append(1)
    # pieces of fractions of a configuration and small pieces: best fit, longest first
    rest = [found[0] for found in iter(lambda: pieces.take(capacity), None)]
    free = sorted((capacity - u, s) for s, u in enumerate(used) if u < capacity)
    _best_fit([*rest, *small.tolist()], lengths, capacity, members, used, free)
    made += [2] * (len(members) - len(made))
    members, made = _refilled(lengths, members, made, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for s, held in enumerate(members):
        sequence[held] = s
        offset[held] = np.cumsum([0, *lengths[held[:-1]]])
    return sequence, offset, np.array(made, np.int64)


def _best_fit(pieces: list[int], lengths: np.ndarray, capacity: int, members: list[list[int]], used: list[int], free: list[tuple[int, int]]) -> None:
    """Put each piece into the sequence whose room it fills best, or into a new one; ``free`` has (room, sequence) in order."""
    for p in pieces:
        want = int(lengths[p])
        at = bisect_left(free, (want, -1))
        if at < len(free):
            room, s = free.pop(at)
        else:
            room, s = capacity, len(used)
            used.append(0)
            members.append([])
        members[s].append(p)
        used[s] += want
        if room > want:
            insort(free, (room - want, s))


def least_sequences(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A bound below which no packing can go: by the sum, and by pieces of which no two fit together."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def _fullest(loose: list[int], lengths: np.ndarray, capacity: int) -> list[int]:
    """The first of ``loose`` (places in it, longest piece first) and those after it that with it fill ``capacity`` best: a subset sum."""
    room, reach, items = capacity - int(lengths[loose[0]]), [1], []
    for k in range(1, len(loose)):
        before, n = reach[-1], int(lengths[loose[k]])
        after = (before | before << n) & ((1 << room + 1) - 1)
        if after != before:
            items.append(k)
            reach.append(after)
            if after >> room & 1:
                break
    at, chosen = reach[-1].bit_length() - 1, [0]
    for k, before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            chosen.append(k)
            at -= int(lengths[loose[k]])
    return chosen


def _refilled(lengths: np.ndarray, members: list[list[int]], made: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """The packing after at most ``REFILLED`` of its sequences, the least filled ones, were filled anew one after the other by
    subset sums, if that saves any."""
    least, most, wanted = least_sequences(lengths, capacity), int(REFILLED * len(members)), 8
    by_fill = sorted(range(len(members)), key=lambda s: -int(lengths[members[s]].sum()))
    while len(members) > least and wanted // 2 < most:
        from_ = max(0, len(members) - min(wanted, most))
        loose = sorted((p for s in by_fill[from_:] for p in members[s]), key=lambda p: (-int(lengths[p]), p))
        filled = []
        while loose:
            chosen = _fullest(loose, lengths, capacity)
            filled.append([loose[k] for k in chosen])
            for k in sorted(chosen, reverse=True):
                del loose[k]
        if from_ + len(filled) < len(members):
            codes = [made[s] for s in by_fill[:from_]]
            members, made = [members[s] for s in by_fill[:from_]] + filled, codes + [3] * len(filled)
            by_fill = sorted(range(len(members)), key=lambda s: -int(lengths[members[s]].sum()))
        else:
            wanted *= 2
    return members, made


_PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, made_by string"


def _pack_shard(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "row_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sequence, rows["offset"], made = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = sequence + (int(key[0]) << 32)
        rows["made_by"] = np.array(MADE_BY)[made[sequence]]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "made_by"]]

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", cache_words: int = CACHE_WORDS_ALONE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, made_by (of its sequence).

    A document is its ids and ``end_id``; null and empty texts are the end id alone. Documents of more than
    ``capacity`` ids are cut into pieces of ``capacity``, of which the first may be shorter. Repeated rows and null
    doc_ids are packed like any other row. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text).cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces_of(path or vocabulary(VOCABULARY), capacity, end_id, cache_words), _PIECES), "pieces")
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (SHARD_TOKENS * capacity / CAPACITY)))
    # piece lengths of equal texts spread too: the hash takes the row in
    shard = F.pmod(F.xxhash64("doc_id", "row_id", "piece"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack_shard(capacity), _PACKED)
