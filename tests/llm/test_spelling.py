"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from sitesieve.llm import spelling

DOCS = "doc_id bigint, text string, word string, key string"


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows):
    n = brute_words(rows)
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, len(close))
    rooted = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rooted.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(rooted)


def edited(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:k] + rng.choice(letters) + word[k:]
    return word[:k] + (rng.choice(letters) if kind == 1 else "") + word[k + 1 :]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aeinrstÀÿß×"])
def test_variants(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choices(letters, k=rng.choice([7, 8, 9, 12, 20]))) for _ in range(60)]
    many = []
    for w in base:
        many += [w.upper() if rng.random() < 0.2 else w] * rng.choice([1, 2, 30, 400])
        v = w
        for _ in range(4):  # variants of variants, ever rarer
            v = edited(rng, v, letters)
            many += [v] * rng.choice([1, 2, 3, 20])
    many += ["a" * k for k in (7, 8, 9, 500, 501, 3000)] * 2 + ["ab" * 6, "ba" * 6, "ab" * 6 + "a"] * 3
    rng.shuffle(many)
    rows = [(rng.choice([None, -3, 0, *range(40)]), " ".join(many[k : k + 7]) + rng.choice(["", ".", "1x", "\n"])) for k in range(0, len(many), 7)]
    rows += [(1, None), (2, ""), (3, " 漢字 1234567 "), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(4)
    assert sorted(map(tuple, spelling.variants(docs).collect())) == brute(rows)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_pivots_are_apart_and_cheapest():
    cost = [1, 5, 6]
    assert spelling.pivots_of([(0, 4), (1, 5), (2, 8)], cost) == [4, 8]  # the two rarest overlap
    assert spelling.pivots_of([(0, 4), (1, 9), (2, 0)], cost) == [4, 9]
    with pytest.raises(ValueError, match="no prefix"):
        spelling.variants(None, shortest=3)


def test_all_documents(spark):
    from sitesieve.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = sorted(map(tuple, queries.op12_spelling(spark, "/root/testdata/sf0.001").collect()))
    n = brute_words(rows)
    assert {r[0]: r[3] for r in found} == n
    # near words by the words with one code point less, which two near words share
    less = {}
    for w in n:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            less.setdefault(v, set()).add(w)
    close = {w: set() for w in n}
    for group in less.values():
        for a in group:
            close[a] |= {b for b in group if near(a, b)}
    for word, form, _, count, k, form_n in found:
        assert k == len(close[word])
        best = min(close[word], key=lambda x: (-n[x], x), default=None)
        assert (form, form_n) == ((best, n[best]) if best and n[best] >= 10 * count else (None, None))


def test_no_table_is_broadcast(spark, monkeypatch):
    """Each word becomes many keys, of which Spark's estimate knows nothing."""
    plans, kept = [], spelling.materialise

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(spelling, "materialise", recorded)
    docs = spark.createDataFrame([(k, "sentence " * 40 + "sentense sentense") for k in range(3)], "doc_id bigint, text string")
    recorded(spelling.variants(docs), "out")
    joins = [plan for plan in plans if "Join" in plan]
    assert len(joins) >= 4 and not [plan for plan in joins if "Broadcast" in plan]
