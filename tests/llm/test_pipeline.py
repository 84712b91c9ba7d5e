"""The stages of the pipeline against brute force."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from sitesieve.llm import near_copies

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Of each component of texts with a similarity of 0.8 or more the smallest id."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in texts if find(i) == i}


def near_texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = {}
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 60, 200, 700]))
        for _ in range(8):  # copies of copies: chains, and pairs on both sides of the limit
            texts[len(texts)] = " ".join(base)
            for _ in range(rng.randint(1, max(1, len(base) // 50))):
                base[rng.randrange(len(base))] = rng.choice(words)
    for text in (None, "", " \n", "one two", "One  two", "one three", "a b c d e", "A b c d e"):
        texts[len(texts)] = text
    hub = rng.choices(words, k=300)
    for k in range(60):  # each near to the hub, few near to each other
        copy = list(hub)
        for at in rng.sample(range(0, 300, 5), 6 if k else 0):
            copy[at] = f"x{k}"
        texts[len(texts)] = " ".join(copy)
    return texts


def test_near_copies(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == brute_kept(texts)
    odd = spark.createDataFrame([(3, "a b", None, None, 0), (3, "a b", None, None, 0), (None, "A b", None, None, 0), (None, "c", None, None, 0)], DOCS)
    assert sorted(near_copies.near_copies(odd).collect(), key=str) == sorted([(3, 3), (3, 3), (None, 3), (None, None)], key=str)
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_near_copies_of_doubled_and_null_ids(spark):
    """Rows go, not ids: a doc_id with several texts loses those that are copies, null ids take part."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for group in range(30):
        base = rng.choices(words, k=rng.choice([6, 40, 150]))
        for _ in range(rng.randint(1, 4)):
            doc = rng.choice([None, group, group + 1, rng.randrange(20)])  # most ids stand for several texts
            rows += [(doc, " ".join(base), "en", "src0", 1)] * rng.choice([1, 1, 2])
            base = list(base)
            if len(base) > 6:
                base[rng.randrange(len(base))] = rng.choice(words)
    rows += [(5, "a wholly different text of some eight words", "en", "src0", 1), (None, None, None, None, None), (None, " ", None, None, None), (7, None, None, None, None)]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(5), "").collect())
    # by brute force: components of distinct texts; each keeps one row of its smallest id
    texts = sorted({t for _, t, *_ in rows}, key=str)
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for doc, text, *_ in rows:
        at, place = find(texts.index(text)), (doc is None, doc or 0)
        least[at] = min(least.get(at, place), place)
    assert len(kept) == len(least) and set(kept.values()) == {1}
    assert sorted((find(texts.index(t)), (d is None, d or 0)) for d, t in kept) == sorted(least.items())


def test_run_applies_the_stages_in_order(spark, tmp_path):
    """``run`` over a small folder: toxic documents and copies are gone, and what is packed are the documents that the stages left."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=60) + (["vilestuff"] * 3 if i % 9 == 0 else [])), "en", f"src{i % 4}", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1].upper(), "en", "src1", 1) for i in range(1, 40, 5)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " tail", "en", "src1", 1) for i in range(2, 40, 5)]  # near copies
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {i: t for i, t, *_ in rows if "vilestuff" not in t.lower()}
    exact = {}
    for i, t in left.items():
        exact[t.lower()] = max(i, exact.get(t.lower(), 0))
    kept = brute_kept({i: left[i] for i in exact.values()})
    packed = {r.doc_id for r in out}
    assert packed <= kept and len(packed) >= 0.6 * len(kept)  # mixing leaves out a tenth of the tokens
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_mix_meets_its_targets(spark):
    rows = [(i, "a b c d e", "en", f"src{i % 4}", 9) for i in range(2000)]  # four domains of the same size
    taken = Counter(r.source for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), "").collect())
    shares = {s: n / sum(taken.values()) for s, n in taken.items()}
    assert all(abs(shares[f"src{k}"] - want) < 0.005 for k, want in enumerate((0.4, 0.3, 0.2, 0.1)))
    assert 1790 <= sum(taken.values()) <= 1800


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    """Every stage as it is chained, on nulls, empty texts, ties, repeated rows and further columns, and on nothing."""
    text = "one two three four five six seven"
    rows = [(1, text, "en", "src0", 1), (2, text.upper(), None, None, None), (2, text.upper(), None, None, None), (None, text, "de", "src1", 1), (3, None, "en", "src0", 0), (4, "", "en", "src0", 0), (5, "word " * 20_000, "fr", "src2", 1), (6, "a b", "en", "srcX", 1), (None, None, None, None, None)]
    extra = ", `_row` string, `_domain` string, toxicity string, id string"
    spark.createDataFrame([(6, 1, 0), (5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], DOCS + extra)
        seen = []
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{len(data)}"
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            seen.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
        if not data:
            assert seen == [[]] * 5
            continue
        assert seen[0] == sorted((r[0] for r in rows), key=str)  # nothing toxic was confirmed
        assert seen[1] == [2, 4, 5, 6]  # of equal texts the largest doc_id, of repeated rows one
        assert seen[2] == [2, 4, 5, 6]
        assert set(seen[3]) <= {2, 4, 5, 6} and set(seen[4]) == set(seen[3])


def test_toxic_documents_go_and_copies_go(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    made = lambda bad: " ".join(rng.choices(words, k=40) + (["vilestuff"] * 2 if bad else []))
    rows = [(i, made(i % 10 == 0), "en", f"src{i % 4}", 1) for i in range(400)]
    rows += [(i + 1000, rows[i][1], "en", "src0", 1) for i in range(1, 40, 4)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 400, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t, *_ in rows if "vilestuff" not in t)
    texts = {}
    for i, t, *_ in rows:
        if "vilestuff" not in t:
            texts[t] = max(i, texts.get(t, 0))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_exact_copies(spark, clean, "").collect()) == sorted(texts.values())


def test_parity_bitmaps_never_tell_apart_what_is_similar():
    rng = random.Random(11)
    for size in (3, 80, 5000):
        base = [rng.getrandbits(64) for _ in range(size)]
        for share in (0, 0.05, 0.2, 0.9):
            other = [rng.getrandbits(64) if rng.random() < share else h for h in base]
            a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
            bits = int(np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum())
            assert bits <= len(set(base) ^ set(other)) and len(near_copies.parities(a)) == near_copies.PARITY // 64
    assert not near_copies.parities(np.array([], np.uint64)).any()
