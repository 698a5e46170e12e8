"""Quality measures against plain re-counting; the estimate on votes with known accuracies."""

import random
import re

import numpy as np

from pagetrail.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def corpus(seed, n=200):
    g = random.Random(seed)
    out = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x y z\x1c \x85", "é " * 60]
    for _ in range(n):
        words = [g.choice(["a", "b", "the", "été", "#x", "y|", "\n", "A.", "\x0b", "q&a"]) for _ in range(g.randint(0, 120))]
        out.append("".join(w + g.choice([" ", "\n", "  "]) for w in words))
    return out


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(corpus(1))) + [(None, "x y z " * 30), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as n_words")
    got = sorted((tuple(r)[:6] + (r.base_failed,) for r in quality.judged(df).collect()), key=str)
    want = []
    for i, t in rows:
        m = brute(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=str)
    for r in quality.judged(df).collect():
        assert not (r.base_failed and r.kept) and 0 <= r.probability <= 1
    assert quality.judged(df.limit(0)).count() == 0


def test_estimate_finds_accuracies_and_share():
    g = np.random.default_rng(3)
    n, rules = 20000, 6
    good = g.random(n) < 0.8
    right = np.array([np.linspace(0.5, 0.8, rules), np.linspace(0.9, 0.98, rules)])
    hit = g.random((n, rules)) < np.where(good[:, None], right[1], right[0])
    votes = np.where(good[:, None] == hit, 1, -1) * (g.random((n, rules)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    e = quality.Estimate(patterns, counts.astype(float))
    assert abs(e.share - 0.8) < 0.05 and np.abs(e.right - right).max() < 0.1
    assert ((e.posterior(votes) >= 0.5) == good).mean() > 0.9
