"""Grouping of spelling variants by pivotal grams.

Two words are near if one insertion, deletion or replacement makes one of the other. Of the bigrams of a word the rarest
three are its prefix, and a dynamic programme picks two of them that don't overlap and are rarest together: its pivots.
One edit hurts one pivot at most. So of two near words the one whose prefix ends first, in the order of rarity, has a
pivot that is whole in the other word, and there it is in the prefix. Pivots are therefore looked up in an index of
prefixes, and not the other way round.

Where the pivot stands is limited too: it is as far from the beginning of both words if the edit is behind it, and as far
from the end if the edit is before it. The text on that side is the same in both, so the index is keyed by it (as a
64-bit hash), once from the beginning and once from the end. An edit that hurts the other pivot, or is between the two,
leaves the far end of the word alone as well, and two characters of it join the key. What a key brings together is
told apart by bits that say which letters a word has an odd number of times, of which an edit changes two at most, and
verified by the complete edit distance.

All joins are sorted merges, which spill: a word has up to 28 keys and the tables are compressed, so what Spark takes for small enough
to be broadcast may be many times as large.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches

#: Least code points and occurrences of a word; every n-th occurrence of a document and word loses a code point.
SHORTEST, SEEN, EVERY = 7, 2, 31
#: How many times commoner a word's form is.
COMMONER = 10
#: Bigrams of a prefix, and pivots: one more than the edits, and as many bigrams as those edits can hurt and one more.
PREFIX, PIVOTS, GRAM = 3, 2, 2
#: Occurrences of a prefix's last bigram that are in the index: one of the first three may be two further on in a near word.
OCCURRENCES = 5
#: Characters of the far end that join a key.
FAR = 2
#: Words that a task counts before it sends them on.
HELD = 200_000
_PRIME, _BASE, _ODD = (1 << 61) - 1, 1_000_003, 0x9E3779B97F4A7C15


def _runs(shortest: int, every: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                for word, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield sent()
        if counts:
            yield sent()

    return run


def words(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, seen: int = SEEN, every: int = EVERY) -> DataFrame:
    """word and n (occurrences in all texts) of the words that occur ``seen`` times at least."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_runs(shortest, every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= seen)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            counts.update(map(str.__add__, word, word[1:]))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])


def order_of_grams(found: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order of rarity and occurrences of each bigram; words have 90 characters, so there are 8,100 at most."""
    rows = found.select("word").mapInArrow(_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: (place, r.n) for place, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in the order, position) of a word's bigrams, rarest first."""
    return sorted((order[word[k : k + GRAM]][0], k) for k in range(len(word) - GRAM + 1))


def pivots_of(prefix: list[tuple[int, int]], cost: list[int], pivots: int = PIVOTS) -> list[int]:
    """Positions of ``pivots`` bigrams of ``prefix`` that don't overlap and have the least sum of ``cost`` (by place in the order).

    best[m]: the cheapest m of the bigrams so far, from left to right, and their positions.
    """
    best: list[list[tuple[int, list[int]]]] = [[(0, [])], *([] for _ in range(pivots))]
    for place, at in sorted(prefix, key=lambda x: x[1]):
        for m in range(pivots, 0, -1):
            fits = [(c + cost[place], [*chosen, at]) for c, chosen in best[m - 1] if not chosen or chosen[-1] + GRAM <= at]
            if fits:
                best[m].append(min(fits))
    return min(best[pivots])[1]


def _hashes(word: str) -> list[int]:
    """A hash of the first k characters for every k."""
    out, h = [0], 0
    for c in word:
        h = (h * _BASE + ord(c) + 1) % _PRIME
        out.append(h)
    return out


def _key(side: int, near: int, far: str) -> int:
    for c in far:
        near = (near * _BASE + ord(c) + 7) % _PRIME
    mixed = (near * 4 + side * 2 + bool(far)) * _ODD & 0xFFFFFFFFFFFFFFFF
    mixed = (mixed ^ mixed >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (mixed ^ mixed >> 29) - (1 << 63)


def probe_keys(word: str, pivots: list[int]) -> set[int]:
    """Keys that a word looks up: for each place of one edit relative to its two pivots the text that stays."""
    first, second = pivots
    begins, ends, n = _hashes(word), _hashes(word[::-1]), len(word)
    head = word[:FAR] if first >= FAR else ""
    tail = word[n - FAR :] if n - second - GRAM >= FAR else ""
    return {
        _key(1, ends[n - first], ""),  # the edit is before both
        _key(1, ends[n - second], head),  # it hurts the first or is between them
        _key(0, begins[first + GRAM], tail),  # it hurts the second
        _key(0, begins[second + GRAM], ""),  # it is behind both
    }


def index_keys(word: str, positions: list[int]) -> set[int]:
    """Keys under which a word is found: for each bigram of its prefix the text up to it and from it on."""
    begins, ends, n = _hashes(word), _hashes(word[::-1]), len(word)
    return {
        key for at in positions
        for near, side, far in ((begins[at + GRAM], 0, word[n - FAR :]), (ends[n - at], 1, word[:FAR]))
        for key in (_key(side, near, ""), _key(side, near, far))
    }


def odd_letters(word: str) -> int:
    """A bit for each of 64 groups of letters: 1 if the word has an odd number of them. As a signed 64-bit number."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - ((bits >> 63) << 64)


_ENTRIES = "key bigint, word string, n bigint, last int, odd bigint"


def _entries(order: dict[str, tuple[int, int]], probes: bool):
    cost = [n for _, n in order.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, last, odd = [], [], [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                ranked = prefix_of(word, order)
                end = ranked[PREFIX - 1][0]
                if probes:
                    found = probe_keys(word, pivots_of(ranked[:PREFIX], cost))
                else:
                    before = [p for place, p in ranked[: PREFIX - 1] if place < end]
                    found = index_keys(word, before + [p for place, p in ranked[: PREFIX + OCCURRENCES] if place == end][:OCCURRENCES])
                keys += found
                at += [k] * len(found)
                last += [end] * len(found)
                odd += [odd_letters(word)] * len(found)
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), rows.column(0), rows.column(1), pa.array(last, pa.int32()), pa.array(odd, pa.int64())], ["key", "word", "n", "last", "odd"])

    return run


def near_pairs(found: DataFrame) -> DataFrame:
    """Each pair of near words once: a, b, n_a, n_b. ``found``: word (distinct, four characters or more) and n."""
    order = order_of_grams(found)
    rows = found.select("word", "n")
    probes = rows.mapInArrow(_entries(order, True), _ENTRIES)
    index = rows.mapInArrow(_entries(order, False), _ENTRIES).toDF("key", "other", "m", "ends", "odds")
    near = (F.col("last") <= F.col("ends")) & (F.bit_count(F.col("odd").bitwiseXOR(F.col("odds"))) <= 2) & (F.levenshtein("word", "other", 1) == 1)
    met = probes.join(index.hint("merge"), "key").filter(near)
    first = F.col("word") < F.col("other")
    side = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return met.select(side("word", "other").alias("a"), side("other", "word").alias("b"), side("n", "m").alias("n_a"), side("m", "n").alias("n_b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms of ``forms`` (word, form) lead. A form is ten times commoner, so no way is long."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, seen: int = SEEN, every: int = EVERY, commoner: int = COMMONER) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters of ``shortest`` code points or more (A-Z lower-cased) that occur ``seen`` times or
    more; a run whose CRC-32 with its doc_id is divisible by ``every`` lost a code point before. ``form`` is the commonest
    near word (ties: the smallest) if it is ``commoner`` times as common, and ``root`` is where forms lead. Null and empty
    texts have no words, a null doc_id counts as an empty one, repeated rows count as often as they are there, an empty
    table gives no rows, other columns are not read.
    """
    if shortest < PREFIX + GRAM - 1:
        raise ValueError(f"words of fewer than {PREFIX + GRAM - 1} characters have no prefix")
    found = materialise(words(docs, text, shortest, seen, every), "words")
    pairs = materialise(near_pairs(found), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    most = -F.col("best.m")
    enough = most >= F.col("n") * commoner
    placed = found.join(best.hint("merge"), "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, most).alias("form_n"))
    placed = materialise(placed, "forms")
    roots = _roots(placed.filter("form is not null").select("word", "form"))
    return placed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
