"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitesieve.llm import exact_dedup, html_crf, media, mixing, packing, pseudonyms, simhash, token_counts, token_store, toxicity
from sitesieve.llm.common import new_folder
from sitesieve.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "The quick brown fox", "en", "src1", 19),
    (2, "the QUICK brown fox", "en", "src0", 19),
    (2, "the QUICK brown fox", "en", "src0", 19),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "src0", 0),
    (None, "The quick brown fox", "de", "src0", 19),
    (None, None, None, None, None),
    (5, " \t\n ", "fr", "srcX", 4),
    (6, "word " * 30_000, "en", "src0", 150_000),
    (7, "Ünïcödé  漢字 \x00 𝄞 <|endoftext|> İ", "es", "src2", 30),
    (8, "a  b\n\n c\t d", "en", "src3", 11),
    (9, "one two", "en", "src3", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "kept fp score _head _hash _doc _salt _norm _range _row _domain _lang _source _tokens _epoch _found found other toxicity id n root".split()
    clashing = [(*r, *("x" for _ in names)) for r in ODD]  # further columns with names that the operators use themselves
    return spark.createDataFrame(clashing, DOCS + "".join(f", `{n}` string" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return (text or "").encode().lower().decode()


def test_exact_groups(odd, none):
    rows = exact_dedup.content_groups(odd, ranges=5).collect()
    groups = defaultdict(list)
    for d, t, *_ in ODD:
        groups[lower(t)].append(d)
    assert len(rows) == len(ODD)
    for r in rows:
        (ids,) = [g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        most = max((d for d in ids if d is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (most, len(ids), r.doc_id == most)
    assert exact_dedup.content_groups(none).count() == 0
    kept = exact_dedup.distinct_texts(odd, ranges=5)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(d for d in g if d is not None) for g in groups.values())


def test_a_text_with_many_copies_spreads_over_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    rows = exact_dedup.content_groups(df, ranges=16).collect()
    texts = {i: "hot text" if i % 3 == 0 else f"t{i % 500}" for i in range(3000)}
    size, most = Counter(texts.values()), {}
    for i, t in texts.items():
        most[t] = max(i, most.get(t, 0))
    assert all((r.keep_id, r.group_size) == (most[texts[r.doc_id]], size[texts[r.doc_id]]) for r in rows) and len(rows) == 3000
    assert sorted(r.doc_id for r in exact_dedup.distinct_texts(df, ranges=16).collect()) == sorted(most.values())
    same = df.select(F.when(F.col("doc_id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("text") == "hot text", F.col("text")).otherwise("x").alias("text"))  # two ids, two texts
    assert sorted(map(tuple, exact_dedup.distinct_texts(same, ranges=16).collect())) == [(7, "hot text"), (7, "x")]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute_components(prints):
    root = {f: f for f in prints.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = list(root)
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {i: min(j for j, g in prints.items() if find(g) == find(f)) for i, f in prints.items()}


def test_simhash(spark, docs, odd, none):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id in (3, 4, 5)} == {3} and all(r.fingerprint == "0" * 16 for r in found if r.doc_id in (3, 4, 5))
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    prints = {}
    for k in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints[len(prints)] = f
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    signed = {i: f - (f >> 63 << 64) for i, f in prints.items()}
    distinct = spark.createDataFrame([(f,) for f in set(signed.values())], "fp bigint")
    edges = simhash.links(distinct)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want, got = brute_components(prints), {}
    for i, f in signed.items():
        got.setdefault(roots.get(f, f), []).append(i)
    assert {i: min(g) for g in got.values() for i in g} == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(docs, name):
    path = public_tokenizers.path(name)
    model, ours = Tokenizer.from_file(path), Encoder(path, limit=300)
    rng = random.Random(7)
    bits = [" ", " ", "\n", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "\u200b", "a", "'s", "É", "é", "12", "!", ".", ",", "x.", "漢", "<|endoftext|>", "ſ", "İ", "e\u0301", "\u0301", "Σ", "ΑΣ", "A\u030a", "Ⅷ", "\u0327", "\u0323", "\u0345", "I\u0307"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(4000)] + [r.text for r in docs.limit(60).collect()] + [t for _, t, *_ in ODD if t]
    texts += ["İ\u0327", "İ\u0323x İ\u0327\u0301", "aİ\u0327, b"]  # lower-casing leaves marks in another order
    for t, e in zip(texts, model.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(t) == np.array(e.ids, "<u4").tobytes(), t


def test_packing(docs, odd, none):
    for df, texts in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(d, t) for d, t, *_ in ODD])):
        model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = Counter()
        for d, t in texts:
            ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want.update((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids), 2048)))
        rows = packing.pack(df).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        used = defaultdict(list)
        for r in rows:
            used[r.sequence_id].append((r.offset, r.length))
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(used) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.pack(none).count() == 0


def test_packing_meets_the_bound(spark):
    """With most sequences of more than one piece as the configurations made them."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("length", "sequence_id", "made_by").collect()
    made = Counter({r.sequence_id: r.made_by for r in rows}.values())
    assert sum(made.values()) == packing.least_sequences(np.array([r.length for r in rows]))
    assert made["configuration"] >= 0.9 * (sum(made.values()) - made["whole piece"])
    assert made["filled anew"] <= packing.REFILLED * sum(made.values())


def test_configurations_are_optimal():
    """Against the best packing of small cases by brute force: the fractional optimum is no more, and rounded up no less than it by one."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes = np.array(sorted(rng.choice(np.arange(12, 90), 4, replace=False), reverse=True))
        demand = rng.integers(1, 6, 4)
        forms, often = packing.configurations(sizes, demand.astype(float), 100)
        assert ((forms @ sizes) <= 100).all() and (often >= -1e-6).all() and (forms.T @ often >= demand - 1e-6).all()
        best = {(0, 0, 0, 0): 0}  # fewest sequences for each part of the demand
        fits = [f for f in np.ndindex(*(demand + 1)) if any(f) and np.dot(f, sizes) <= 100]
        for part in sorted(np.ndindex(*(demand + 1)), key=sum)[1:]:
            best[part] = min(1 + best[tuple(np.subtract(part, f))] for f in fits if all(np.less_equal(f, part)))
        assert often.sum() <= best[tuple(demand)] + 1e-6 and best[tuple(demand)] <= np.ceil(often.sum() - 1e-6) + 1


def test_pack_lengths_is_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 5000), np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), np.full(300, 1000), np.full(7, 2048), np.array([1025, 1025, 3]), np.array([], int)):
        sequence, offset, made = packing.pack_lengths(lengths)
        assert len(made) == (sequence.max() + 1 if len(lengths) else 0)
        order = np.lexsort((offset, sequence))
        ends = {}
        for k in order:
            assert offset[k] == ends.get(sequence[k], 0)
            ends[sequence[k]] = offset[k] + lengths[k]
        assert all(v <= 2048 for v in ends.values())
        halves = int((lengths > 1024).sum())
        least = max(-(-int(lengths.sum()) // 2048), halves, -(-int(((lengths > 682) & (lengths <= 1024)).sum()) // 2) if not halves else 0)
        assert len(ends) <= least * 1.01 + 1


def test_toxicity(spark, none):
    """Against the labels of held-out rows; some labels of either kind stand on texts without any insult."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    hit = {y: [r.predicted for r in rows if r.toxic == y] for y in (0, 1)}
    assert sum(hit[1]) / len(hit[1]) >= 0.9
    assert sum(hit[0]) / len(hit[0]) <= 0.02
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.without_toxic(docs.limit(50).withColumn("toxicity", F.lit("kept")), labels).select("toxicity").distinct().collect() == [("kept",)]


def test_toxicity_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_non_negative_risk_finds_positive_words():
    rng = random.Random(0)
    common = [f"w{k}" for k in range(200)]
    draw = lambda bad: (frozenset(rng.sample(common, 20)) | ({rng.choice(("bad", "worse"))} if bad else set()), 1)
    model = toxicity.fit([draw(True) for _ in range(300)], [draw(rng.random() < 0.1) for _ in range(2000)], 0.1)
    assert model.score("w1 bad w2") > 0.9 and model.score("w1 w2 w3") < 0.3


def water(budget, nodes):
    """nodes: name -> (weight, capacity); shares with shortages given to siblings, in fractions."""
    left, out, todo = budget, {}, dict(nodes)
    while todo:
        rate = left / sum(w for w, _ in todo.values())
        short = [k for k, (w, c) in todo.items() if c <= rate * w]
        if not short:
            return out | {k: rate * w for k, (w, _) in todo.items()}
        for k in short:
            out[k] = todo.pop(k)[1]
            left -= out[k]
    return out


def test_mixing(odd, none, docs):
    from sitesieve.llm.queries import domain_of_source, mixing_weights

    rows = mixing.mix(docs, domain_of_source(), mixing_weights(), budget_share=(1, 2)).collect()
    used, budget = Counter(), {}
    for r in rows:
        used[r._domain, r._lang, r._source] += r._tokens
        budget[r._domain, r._lang, r._source] = r._budget
    longest = max(len(r.text.split()) for r in rows)
    assert all(budget[k] - longest <= n <= budget[k] for k, n in used.items())
    out = mixing.mix(odd, domain_of_source(), mixing_weights())
    assert len(set(out.columns)) == len(out.columns) and set(odd.columns) <= set(out.columns) and out.count() > 0
    assert mixing.mix(odd, domain_of_source(), mixing_weights(), details=False).columns == odd.columns
    assert mixing.mix(none, domain_of_source(), mixing_weights()).count() == 0


def test_budgets_go_to_siblings_first(spark):
    rows = [("a", "en", "1", 10, 3, 1, 1), ("a", "en", "2", 1000, 3, 1, 1), ("a", "de", "3", 5, 3, 1, 1), ("b", "en", "4", 20, 1, 1, 1), ("b", "en", "5", 4000, 1, 1, 3)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint, w_domain bigint, w_lang bigint, w_source bigint")
    for total in (100, 400, 1000, 3000, 9000):
        got = {r.source: r.budget for r in mixing.budgets(leaves, total, 2).collect()}
        top = water(total, {"a": (3, 2030), "b": (1, 8040)})
        a = water(top["a"], {"en": (1, 2020), "de": (1, 10)})
        want = water(a["en"], {"1": (1, 20), "2": (1, 2000)}) | {"3": a["de"]} | water(top["b"], {"4": (1, 40), "5": (3, 8000)})
        assert all(abs(got[k] - v) <= 3 for k, v in want.items()), (total, got, want)


def test_token_store(spark, docs, odd, none):
    for df, texts in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(d, t) for d, t, *_ in ODD])):
        folder = new_folder(spark, "test-store")
        token_store.write_store(df, folder)
        model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        ids = [(d, np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in texts]
        got = token_store.read_digests(spark, folder).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in ids)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert in_order == sorted(in_order, key=lambda d: (d is not None, d))
        read = token_store.read_ids(spark, folder).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in read) == Counter((d, tuple(i.tolist())) for d, i in ids)
        names = [r.digest for r in token_store.chunks(spark, folder).collect()]
        assert len(names) == len(set(names))
        total = spark.read.parquet(f"{folder}/manifest").agg(F.sum("n_tokens"), F.sum("n_docs")).first()
        assert tuple(total) == (at, len(texts))
    with pytest.raises(Exception, match="doesn't fit"):
        token_store.write_store(docs.limit(5), new_folder(spark, "test-store"), end_id=70_000, id_type="<u2")
    empty = new_folder(spark, "test-store")
    token_store.write_store(none, empty)
    assert token_store.read_digests(spark, empty).count() == 0

    def broken(name, change):  # a copy of the store with one part changed
        copy = new_folder(spark, "test-store")
        for part in ("objects", "recipes", "manifest"):
            df = spark.read.parquet(f"{folder}/{part}")
            df = change(df) if part == name else df
            (df.write.partitionBy("kind") if part == "objects" else df.write).parquet(f"{copy}/{part}")
        with pytest.raises(Exception, match="content that its name says|cannot be put together|manifest does not hold"):
            token_store.read_digests(spark, copy).collect()

    flipped = F.when(F.col("kind") == "chunk", F.concat(F.unhex(F.lit("ffff")), F.expr("substring(body, 3)"))).otherwise(F.col("body"))
    broken("objects", lambda df: df.withColumn("body", flipped))
    broken("objects", lambda df: df.filter("kind = 'recipe'"))
    broken("manifest", lambda df: df.withColumn("root", F.unhex(F.lit("00"))))
    broken("recipes", lambda df: df.filter("doc_id <> 1"))


def test_chunks_and_crc():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 49_000, 9000), rng.integers(0, 49_000, 700)
    for ids in (a, b, a[:1], np.zeros(5000, int)):
        ends = token_store.cuts(ids)
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
    shared = {a[s:e].tobytes() for s, e in zip([0, *token_store.cuts(a)], token_store.cuts(a), strict=False)}
    moved = np.concatenate([b, a])
    again = {moved[s:e].tobytes() for s, e in zip([0, *token_store.cuts(moved)], token_store.cuts(moved), strict=False)}
    assert len(shared & again) > 0.8 * len(shared)
    parts = [rng.bytes(n) for n in (0, 1, 70, 4096)]
    assert token_store.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_length_histogram(spark, docs, odd, none):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(model.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()]
    histogram = token_counts.length_histogram(token_counts.lengths(docs)).cache()
    for r in histogram.collect():
        assert (r.docs, r.docs_upto, r.docs_from) == (n.count(r.n_tokens), sum(x <= r.n_tokens for x in n), sum(x >= r.n_tokens for x in n))
        assert (r.tokens_from, r.truncated_total) == (sum(x for x in n if x >= r.n_tokens), sum(min(x, r.n_tokens) for x in n))
    for limit in (0, 100, 777, 10**6):
        assert token_counts.truncated_total(histogram, limit).first().total == sum(min(x, limit) for x in n)
    assert token_counts.quantile(histogram, 0.5).first().n_tokens == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.length_histogram(token_counts.lengths(none)).count() == 0
    assert sorted(r.n_tokens for r in token_counts.lengths(odd).collect()) == sorted(len(model.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD)


def brute_areas(image, rows, columns):
    """Mean of the area of each cell, pixel by pixel and exact, rounded to 6 places."""
    from fractions import Fraction

    def shares(size, cells):
        out = []
        for c in range(cells):
            low, high = Fraction(c * size, cells), Fraction((c + 1) * size, cells)
            out.append([(k, float((min(high, k + 1) - max(low, k)) / (high - low))) for k in range(int(low), -int(-high // 1)) if min(high, k + 1) > max(low, k)])
        return out

    lines = [sum(image[y].astype(float) * w for y, w in part) for part in shares(image.shape[0], rows)]
    return [[round(sum(line[x] * w for x, w in part), 6) for part in shares(image.shape[1], columns)] for line in lines]


def test_text_media(docs, odd, none):
    for df, texts in ((docs.limit(50), None), (odd, [(d, t) for d, t, *_ in ODD])):
        texts = texts or [(r.doc_id, r.text) for r in df.collect()]
        rows = media.text_media(df).collect()
        want = Counter()
        for d, t in texts:
            raw = (t or "").encode()
            pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            want[d, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
        by_payload = {}
        for _, t in texts:
            raw = (t or "").encode()
            pad = np.frombuffer(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), np.uint8).reshape(-1, 64)
            if len(pad) % 2:
                stored = b"P5\n# bytes %d\n64 %d\n255\n" % (len(raw), len(pad)) + pad.tobytes()
            else:
                stored = media.encode_bmp(pad, pad.size - len(raw))
            assert (media.decode(stored) == pad).all()
            cells = brute_areas(pad, 8, 9)
            bits = "".join("1" if a < b else "0" for row in cells for a, b in zip(row, row[1:], strict=False))
            tile = np.array(brute_areas(pad, 16, 16)).round().clip(0, 255)
            by_payload[hashlib.sha256(pad.tobytes()).hexdigest()] = (len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}", tile)
        for r in rows:
            size, sha, feature, tile = by_payload[r.payload_sha256]
            assert (r.media_bytes, r.media_sha256, r.feature) == (size, sha, feature)
            head = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '|u1', 'fortran_order': False, 'shape': (16, 16), }".ljust(117) + b"\n"
            assert r.tile_sha256 == hashlib.sha256(head + tile.astype(np.uint8).tobytes()).hexdigest()
    assert media.text_media(none).count() == 0


def test_images(spark):
    rng = np.random.default_rng(2)
    gray, colour = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (3, 4, 3), np.uint8)
    assert (media.decode(media.encode_bmp(gray)) == gray).all()
    assert (media.decode(b"P6 # c\n4 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n5 7 255\n" + b" ".join(b"%d" % x for x in gray.ravel())) == gray).all()
    assert (media.decode(b"P1\n3 2\n101\n010") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    exact = gray.astype(float)
    assert np.allclose(media.area_resize(gray, 7, 5), exact) and np.allclose(media.area_resize(gray, 1, 1), exact.mean())
    big = np.kron(gray, np.ones((6, 4), np.uint8))
    assert np.allclose(media.area_resize(big, 7, 5), exact)
    assert np.allclose(media.area_resize(gray, 14, 15), np.kron(exact, np.ones((2, 3))))
    assert media.decode(b"P5 2 1 15\n\x0f\x05").tolist() == [[255, 85]] and media.decode(b"P5 1 1 511\n\x01\xff").tolist() == [[65535]]
    frame = spark.createDataFrame([(1, bytearray(media.encode_bmp(gray))), (2, bytearray(b"no image")), (3, None), (4, bytearray(b"P5\n0 0\n255\n"))], "id int, media binary")
    found = {r.id: r for r in media.tiles(frame).collect()}
    assert (found[1].rows, found[1].columns, found[2].tile, found[3].dhash) == (7, 5, None, None)
    assert (found[4].rows, found[4].columns, found[4].tile, found[4].dhash) == (0, 0, None, None)
    huge = b"9" * 22
    broken = [b"P5\n" + huge + b" 1\n255\n", b"P4\n1 " + huge + b"\n", b"P2\n1 1\n255\n" + huge, b"P2\n1 1\n" + huge + b"\n5", b"P5\n100000 100000\n255\n", b"P6\n1 1\n0\n", b"P5", b"BM", b"BM" + b"\xff" * 60, b"P5\n-1 -1\n255\n"]
    rows = media.tiles(spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(broken)], "id int, media binary")).collect()
    assert len(rows) == len(broken) and all(r.tile is None for r in rows)

    import io

    assert np.load(io.BytesIO(bytes(found[1].tile))).shape == (16, 16)


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark, odd, none):
    values = ["4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "212-555-0199", "42.144.35.254", "255.0.0.1", "1999-02-28", "2000-02-29", "31/12", "29.02.2023", "01.03.1954", "078-05-1120", "bosbt.42@mail8.example.com", "A1@b.io", "4041894974608796", "2001-13-01", "666-12-3456", "300.1.1.1"]
    plain = {"31/12", "29.02.2023", "4041894974608796", "2001-13-01", "666-12-3456", "300.1.1.1"}
    rows = [(k, f"é{v}," if 0 else f"see {v}, and {v} or x") for k, v in enumerate(values)] + [(100, None), (101, ""), (102, "no numbers"), (103, " ".join(values))]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n_found", F.lit("clash"))
    hidden = pseudonyms.pseudonymise(df, "k")
    out = {r.doc_id: r for r in hidden.collect()}
    for k, v in enumerate(values):
        text = out[k].text
        m = re.fullmatch(r"see (.+), and (.+) or x", text)
        assert m[1] == m[2] and re.sub(r"[0-9]", "9", re.sub("[A-Za-z]", "a", m[1])) == re.sub(r"[0-9]", "9", re.sub("[A-Za-z]", "a", v)) or v.count(".") == 3
        assert (m[1] == v) == (v in plain), (v, m[1])
        if len(re.sub(r"\D", "", v)) == 16 and v not in plain:
            assert luhn(re.sub(r"\D", "", m[1])) and m[1][0] == v[0]
    assert out[103].text == " ".join(re.fullmatch(r"see (.+), and (.+) or x", out[k].text)[1] for k in range(len(values)))
    assert (out[100].text, out[101].text, out[102].text, out[102].n_found) == (None, "", "no numbers", 0)
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(hidden, "k", back=True).collect()}
    assert back == dict(rows)
    assert pseudonyms.pseudonymise(odd, "k").count() == len(ODD) and pseudonyms.pseudonymise(none, "k").count() == 0


def brute_feistel(n, sizes, key, tag):
    a, b = sizes
    left, right = divmod(n, b)
    noise = lambda k, half, size: int(hashlib.sha256(f"{key}|{tag}|{k}|{half}".encode()).hexdigest()[:15], 16) % size
    for k in range(8):
        if k % 2 == 0:
            left = (left + noise(k, right, a)) % a
        else:
            right = (right + noise(k, left, b)) % b
    return left * b + right


def relaid(value, digits):
    at = iter(digits)
    return "".join(next(at) if c.isdigit() else c for c in value)


def brute_pseudonym(v, key):
    import datetime

    d = re.sub(r"\D", "", v)
    if "@" in v:
        local, host = v.split("@")
        left, right = local[: -(-len(local) // 2)], local[-(-len(local) // 2) :]

        def shifted(half, other, k):
            out = ""
            for at, c in enumerate(half):
                noise = int(hashlib.sha256(f"{key}|email|{k}|{len(half)}|{other}|{at}".encode()).hexdigest()[:15], 16)
                low, n = next(((x, m) for x, m in (("a", 26), ("A", 26), ("0", 10)) if ord(x) <= ord(c) < ord(x) + m), (None, 0))
                out += c if low is None else chr((ord(c) - ord(low) + noise % n) % n + ord(low))
            return out

        for k in range(8):
            if k % 2 == 0:
                left = shifted(left, right, k)
            else:
                right = shifted(right, left, k)
        return f"{left}{right}@{host}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", v):
        form = "%Y-%m-%d" if "-" in v else "%d.%m.%Y"
        n = (datetime.datetime.strptime(v, form).date() - datetime.date(1900, 1, 1)).days
        return (datetime.date(1900, 1, 1) + datetime.timedelta(brute_feistel(n, pseudonyms.DAYS, key, "date"))).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        n = brute_feistel(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
        area = n // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if v.count(".") == 3:
        n = brute_feistel(int.from_bytes(bytes(map(int, v.split(".")))), (65536, 65536), key, "ipv4")
        return ".".join(map(str, n.to_bytes(4)))
    if len(d) == 16:
        body = d[0] + f"{brute_feistel(int(d[1:15]), (10**7, 10**7), key, 'card'):014d}"
        return relaid(v, next(body + c for c in "0123456789" if luhn(body + c)))
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    n = brute_feistel((area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line, (800, 8_000_000), key, "phone")
    return relaid(v, d[:-10] + f"{n // 8_000_000 + 200:03d}{n // 10_000 % 800 + 200:03d}{n % 10_000:04d}")


def test_pseudonyms_by_brute_force(spark):
    values = ["4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "212-555-0199", "42.144.35.254", "1999-02-28", "01.03.1954", "078-05-1120", "777-05-1120", "bosbt.42@mail8.example.com", "A1@b.io"]
    rows = spark.createDataFrame([(v,) for v in values], "text string")
    found = {r.old: r.text for r in pseudonyms.pseudonymise(rows.withColumn("old", F.col("text")).withColumn("found", F.lit(1)), "secret").collect()}
    assert found == {v: brute_pseudonym(v, "secret") for v in values}


def test_feistel_is_a_permutation(spark):
    a, b = pseudonyms.DAYS
    out = spark.range(a * b).select(pseudonyms.feistel(F.col("id"), (a, b), "k", "t").alias("n")).agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(out) == (0, a * b - 1, a * b)


def test_html(spark, none):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    rows = html_crf.extract(pages).collect()
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        parts = (re.sub(r"[ \t\n\r\f]+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>", inside))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<div>" * 100_000 + "text"), (4, "u", "<a '" * 100_000), (5, "u", "<b>" * 50_000 + "<p>x</i>" * 50_000), (3, "u", "just text"), (3, "u", "<script>a</script><nav><a>b")], "page_id bigint, url string, html string")
    assert html_crf.extract(odd).count() == 7
    assert html_crf.extract(odd.limit(0)).count() == 0


def test_html_of_other_layouts():
    page = """<html><body><nav><a href=/>Home</a></nav><div class="cookie-banner"><p>We use cookies on this site, and more.</p></div>
      <main><h1>A title of some words</h1><p>First &eacute;t&eacute;  paragraph,<br>with a   break and <b>bold</b> words in it.</p><div class="ad">Buy this thing now!</div>
      <p>Second paragraph has other words, and ends here.</p></main>
      <section id="comments"><h2>Comments</h2><p>I liked this article very much, thanks.</p></section>
      <aside>Related things to read.</aside><form><label>Mail</label><p>Sign up here.</p></form><script>x("<p>no</p>")</script><footer>&copy; 2020 Us</footer></body></html>"""
    want = "A title of some words\n\nFirst été paragraph, with a break and bold words in it.\n\nSecond paragraph has other words, and ends here."
    assert html_crf.main_text(page, html_crf.field()) == want
