"""Encoder batches: by length, with bisection; same vectors and errors as page by page, in fewer calls."""

import random

import pytest

from pagetrail.operators import embed

g = random.Random(3)
PAGES = [(i, "word " * g.randint(0, 60) + (" BAD" if i in (5, 41, 42) else ""), f"https://h{i}.test/{'p' * g.randint(0, 40)}?q={i}") for i in range(100)]
BARE = [u.split("?")[0] for _, _, u in PAGES]


class Counting:
    """Fails on any call with a bad title; remembers the sizes of its calls."""

    def __init__(self, short=()):
        self.calls, self.short = [], short

    def __call__(self, model, texts):
        self.calls.append(texts)
        if any("BAD" in t for t in texts):
            raise RuntimeError("bad title")
        return [[float(len(t)), 1.0] if not any(f"//h{i}.test" in t for i in self.short) else [0.0] for t in texts]


def encode(encoder, **k):
    ids, titles, urls = map(list, zip(*PAGES))
    return sorted(embed.encode_rows(ids, titles, urls, BARE, encoder=encoder, model="m", dims=2, **k))


def outcome(rows):
    return [(r[0], r[1], r[5]) for r in rows]


@pytest.mark.parametrize("options", [{"batch_size": 32}, {"token_budget": 400}, {"token_budget": 10**6}])
def test_bisection_equals_page_by_page_in_fewer_calls(options):
    alone, halves = Counting(), Counting()
    one_by_one = encode(alone, batch_size=1)
    split = encode(halves, bisect=True, **options)
    assert outcome(split) == outcome(one_by_one) and all(v is not None for _, v, _ in outcome(split))
    assert {r[0] for r in split if r[2] == "fallback"} == {5, 41, 42}
    assert len(halves.calls) < 0.6 * len(alone.calls)


def test_bisection_of_a_large_batch_saves_calls_over_falling_back_page_by_page():
    halves, whole = Counting(), Counting()
    encode(halves, bisect=True, batch_size=50)
    encode(whole, batch_size=50)
    assert len(halves.calls) < len(whole.calls)


def test_lost_pages_without_fallback():
    assert {r[0] for r in encode(Counting(), batch_size=16, fallback=False) if r[1] is None} == {i for i in range(100) if i // 16 in (0, 2)}
    rows = encode(Counting(short=(7,)), batch_size=16, fallback=False, bisect=True)
    assert {r[0] for r in rows if r[1] is None} == {5, 7, 41, 42} and all(r[5] for r in rows if r[1] is None)


def test_batches_keep_the_budget():
    lengths = [g.randint(0, 90) for _ in range(300)] + [5000]
    batches = embed.batches_by_length(lengths, 500)
    assert sorted(i for b in batches for i in b) == list(range(301))
    assert all(len(b) == 1 or len(b) * max(1, max(lengths[i] for i in b)) <= 500 for b in batches)
    assert sum(map(len, batches)) / len(batches) > 8
    assert embed.batches_by_length([], 10) == []


def test_candidate_texts_equal_the_column(spark):
    rows = [(1, " T ", "https://ex.com/a?q=1"), (2, "T" * 600, "https://ex.com/" + "a" * 3000 + "?" + "b" * 40), (3, "", "about:blank#x"), (4, "é" * 300, "https://ex.com/" + "é" * 1100)]
    df = spark.createDataFrame(rows, "page_id long, title string, url string")
    want = {}
    for r in embed.candidates(df).orderBy("page_id", "attempt").collect():
        want.setdefault(r.page_id, []).append(r.text)
    for i, t, u in rows:
        bare = u.split("?")[0].split("#")[0]
        assert embed.candidate_texts(t.strip(), u, bare) == want[i]


def test_options_inside_spark(spark):
    df = spark.createDataFrame(PAGES, "page_id long, title string, url string").repartition(3)

    def encoder(model, texts):
        if any("BAD" in t for t in texts):
            raise RuntimeError("bad title")
        return [[float(len(t)), 1.0] for t in texts]

    got = embed.encode_pages(df, model_name="m", dims=2, encoder=encoder, token_budget=300, bisect=True).collect()
    assert sorted((r.page_id, list(r.embedding), r.error) for r in got) == outcome(encode(Counting(), batch_size=1))
