"""The streaming encoder and decoder against the tokenizers library."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from pagetrail.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(seed, n=400):
    g = random.Random(seed)
    alphabets = ["abcdefgh ", "aA", " \n\t a", "éèüßñ x", "0123456789.,", "日本語テスト ", "😀👍🏽 a", "'stmredl ", "etaoinshr", "=-_*#"]
    out = ["", " ", "\n\n a  b ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " x y﻿", "a" * 5000, "the" * 3000, " " * 3000 + "x"]
    for _ in range(n):
        a = g.choice(alphabets)
        out.append("".join(g.choice(a) for _ in range(g.choice([3, 20, 200, 1500]))))
    return out


def test_ids_and_text_equal_library(vocabulary, library):
    for t in texts(1):
        ids = [i for group in vocabulary.encode(t) for i in group]
        assert ids == library.encode(t, add_special_tokens=False).ids
        back = bpe.ByteToText(vocabulary)
        assert "".join(back.feed([i]) for i in ids) + back.feed([], True) == library.decode(ids, skip_special_tokens=False)


def test_stream_is_independent_of_blocks(vocabulary):
    g = random.Random(2)
    assert 0 < vocabulary.lookahead < 1000
    common = [b for b in vocabulary.bytes[256:4000] if b.isalpha()]
    for _ in range(60):
        data = b"".join(g.choice(common) for _ in range(400)) if g.random() < 0.7 else bytes(g.choice(b"ab") for _ in range(1500))
        whole = vocabulary.merge(data)
        cuts = sorted({0, len(data), *(g.randrange(len(data)) for _ in range(7))})
        assert [i for x in vocabulary.stream(data[a:b] for a, b in zip(cuts, cuts[1:])) for i in x] == whole


def test_broken_bytes_decode_like_library(vocabulary, library):
    g = random.Random(3)
    for _ in range(300):
        ids = [g.randrange(256) if g.random() < 0.6 else g.randrange(50257) for _ in range(12)]
        back = bpe.ByteToText(vocabulary)
        assert "".join(back.feed([i]) for i in ids) + back.feed([], True) == library.decode(ids, skip_special_tokens=False)


def test_operators(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(4, 60))] + [(None, None), (3, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    clash = df.selectExpr("doc_id", "text", "'x' n_tokens", "text decoded")
    back = bpe.decoded(bpe.encoded(clash, PATH), PATH)
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_decoding_runs_in_the_worker_that_encoded(spark):
    rows = [(i, t) for i, t in enumerate(texts(5, 20))] + [(None, None), (3, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    apart, both = (bpe.decoded(e, PATH) for e in (bpe.encoded(df, PATH).select("*"), bpe.encoded(df, PATH)))
    steps = [d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for d in (apart, both)]
    assert steps == [2, 1]
    assert both.schema == apart.schema and sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
    assert bpe.decoded(bpe.encoded(df.limit(0), PATH), PATH).count() == 0


def test_every_id_comes_from_a_step_of_the_transducer(vocabulary, library, monkeypatch):
    counted, step = [0], bpe.Vocabulary.step

    def counting(self, windows, ended):
        for ids, held in step(self, windows, ended):
            counted[0] += len(ids)
            yield ids, held

    vocabulary.clear()
    monkeypatch.setattr(bpe.Vocabulary, "step", counting)
    for t in ("aabc" * 900, "日本語テスト" * 700, " " * 4000, "x" * 255 + " " + "y" * 257, "tokens " + "z" * 256):
        vocabulary.clear()
        counted[0] = 0
        ids = [i for group in vocabulary.encode(t) for i in group]
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert counted[0] == len(ids) if len(set(vocabulary.pieces(t))) == len(list(vocabulary.pieces(t))) else 0 < counted[0] <= len(ids)


def test_memory_does_not_grow_with_a_piece(vocabulary):
    def blocks(n):
        for i in range(n):
            yield b"ab%dcd" % (i % 7) * 40

    largest = max(len(ids) for ids in vocabulary.stream(blocks(400)))
    assert largest < 2000 and max(len(ids) for ids in vocabulary.stream(blocks(1600))) == largest


def test_remembered_pieces_are_bounded_by_bytes(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    vocabulary.clear()
    for k in range(50):
        list(vocabulary.encode(" ".join(f"w{k}x{i}" for i in range(30))))
        assert vocabulary.held < 20_000 + 90 * 400 and len(vocabulary) < 250
    vocabulary.clear()
    assert vocabulary.held == 0 and not vocabulary


def test_equal_pairs_merged_together_or_one_by_one(vocabulary):
    g = random.Random(6)
    common = [b for b in vocabulary.bytes[256:20_000] if b]
    assert vocabulary.ordered
    for _ in range(150):
        data = g.choice([b"".join(g.choice(common) for _ in range(60)), bytes([g.randrange(256)]) * g.randrange(1, 300), bytes(g.choice(b"ab ") for _ in range(300))])
        together = vocabulary.merge(data)
        vocabulary.ordered = False
        try:
            assert vocabulary.merge(data) == together == list(vocabulary.merge_many([data])[0])
        finally:
            vocabulary.ordered = True
