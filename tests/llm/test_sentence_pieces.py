"""The agenda of symbol pairs against the sentencepiece library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from sitesieve.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, ids string, decoded string"
LIBRARY = SentencePieceProcessor(model_file=PATH)


def ids_of(found):
    return np.frombuffer(found, "<u4").tolist()


def test_ids_are_those_of_the_library():
    codec = sentence_pieces.PieceCodec(PATH, limit=50)  # generations of the cache change all the time
    rng = random.Random(3)
    parts = [" ", " ", " ", "▁", "a", "b", "the", "ing", "\n", "\t", "\x00", "é", "漢", "𝄞", "<s>", "</s>", "<0x0A>", "\u0301", "\u200d", "İ", ".", ",", "'", '"', "\u3000", "12", "ﬁ", "ب", "a" * 60, " " * 20, "\r\n", "—", "Ω", "xq"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(4000)] + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x3000, 0x9FFF)])) for _ in range(40)) for _ in range(500)]
    for at in range(0, len(texts), 100):
        for text, found in zip(texts[at : at + 100], codec.encode_all(texts[at : at + 100]), strict=True):
            assert ids_of(found) == LIBRARY.encode(text), text
    assert codec.encode_all([None, ""]) == [b"", b""] and codec.encode_all([]) == [] and codec.decode_all([]) == []


def test_long_parts_take_time_in_proportion():
    codec = sentence_pieces.PieceCodec(PATH)
    for text in ("ab" * 100_000, " " * 100_001, "a" * 50_000 + " " + "é漢" * 20_000):
        assert ids_of(codec.encode_all([text])[0]) == LIBRARY.encode(text)


def test_a_part_that_differs_from_the_library_is_an_error():
    codec = sentence_pieces.PieceCodec(PATH)
    codec.rank.pop("ing")
    with pytest.raises(sentence_pieces.Mismatch):
        codec.encode_all(["singing"])


def test_digests_of_odd_rows(spark):
    rows = [(1, "Hello  world", "x", "y"), (1, "Hello  world", "x", "y"), (2, None, None, None), (3, "", "x", "y"), (None, " \n\t ", "x", "y"), (4, "word " * 30_000, None, None), (5, "▁é漢\x00𝄞</s>", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = []
    for doc, text, *_ in rows:
        ids = [1, *LIBRARY.encode(text or ""), 2]
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, sentence_pieces.digests(docs).collect()), key=str) == sorted(want, key=str)
    whole = {(r.doc_id, tuple(r.ids), r.decoded) for r in sentence_pieces.encoded(docs).collect()}
    assert (2, (1, 2), "") in whole and len(whole) == 6
    assert sentence_pieces.digests(docs.limit(0)).count() == 0


def test_all_documents(spark):
    from sitesieve.llm import queries

    found = {r.doc_id: r for r in queries.op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        assert (found[r.doc_id].n_tokens, found[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
