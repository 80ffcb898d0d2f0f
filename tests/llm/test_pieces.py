"""The piece codec against the library that the model comes from."""

import hashlib
import random
import time

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from moraine.llm import sentencepieces  # noqa: E402
from moraine.llm.sentencepieces import Model, default_path, read_model  # noqa: E402

ALPHABET = [*"abcdefghij  \n\t▁éñ😀字อ\0　<>s/0123", "the ", "  ", "ing", "    ", "▁▁", "<s>", "\x1f", "ﬁ", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


@pytest.fixture(scope="module")
def model():
    return read_model(default_path())


def test_texts_equal_the_library(library, model):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90))) for _ in range(4000)]
    texts += ["x" * 5000, "ab" * 20_000, " " * 300, "\n" * 100, " a", "a ", " ", "", "▁", "a  b"]
    codec = Model(model, kept=500)
    for at in range(0, len(texts), 400):
        for text, (ids, decoded) in zip(texts[at : at + 400], codec.looked_up(texts[at : at + 400]), strict=True):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded == codec.decode(want) == library.decode(want)


def test_any_ids_decode_as_the_library_does(library, model):
    rng = random.Random(12)
    codec = Model(model)
    drawn = lambda: rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 259, 28705, 229, 153, 132, 243])
    for _ in range(3000):
        ids = [drawn() for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_both_ways_of_merging_agree_and_long_words_are_quick(library, model):
    rng = random.Random(13)
    codec = Model(model)
    for size in (41, 80, 200):
        word = "".join(rng.choice("aeinrst") for _ in range(size))
        long = codec._merged_long(list(word))
        assert long == library.encode("x " + word, out_type=str)[-len(long) :] or codec.segment("▁" + word) == library.encode(word)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(40_000))
    began = time.perf_counter()
    ids = codec.segment("▁" + word)
    assert time.perf_counter() - began < 2
    assert ids == library.encode(word)


def test_a_model_with_a_piece_across_markers_takes_whole_texts(model):
    codec = Model(model)
    codec.crosses = True
    assert codec.chunks("a b  c") == ["▁a▁b▁▁c"]
    codec.crosses = False
    assert codec.chunks("a b  c") == ["▁a", "▁b", "▁▁c"]


def test_other_models_are_refused(model):
    with pytest.raises(ValueError, match="identity"):
        Model(model.replace(b"identity", b"nmt_nfkc"))


def test_query_rows(spark, docs, rows, library, model):
    got = sorted(map(tuple, sentencepieces.encode_digests(docs, model).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        spelled = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), spelled, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_rows_there_and_back(spark, docs, rows, library, model, nothing):
    encoded = sentencepieces.encode_documents(docs, model)
    texts = sorted((str(i), t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.decoded) for r in encoded.collect()) == texts
    assert sorted((str(r.doc_id), r.decoded) for r in sentencepieces.decode_documents(encoded, model).collect()) == texts
    assert sentencepieces.encode_digests(nothing, model).count() == 0
    assert sentencepieces.encode_documents(nothing, model).count() == 0
