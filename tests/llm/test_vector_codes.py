"""Vector codes against plain Lloyd rounds that scan every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagetrail.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * float(np.float32(c))) for c in v]) for i, label, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, _, x in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min((dist(part, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        codes = [[nearest(c[p], books[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes) if k[p] == j]
                if mine:
                    books[p][j] = tuple(sum(col) // len(mine) for col in zip(*mine))
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, label, _), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{j:02x}" for _, j in b), e, by_label[label], digest) for (i, label, _), b, e in zip(kept, best, errors))


def got(df, **k):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df, **k).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label) for i, label, v in rows], SCHEMA).selectExpr("*", "'z' as code", "1 as error", "2 as x", "'y' as codes")


def test_equals_plain_lloyd(spark):
    g = random.Random(4)
    rows = [(i, g.choice([None, 1, 1, 1, 2]), [g.choice([g.gauss(0, 0.02), 0.25, -0.25]) for _ in range(32)]) for i in range(300)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(150)]  # a hot vector
    rows += [(3, None, rows[3][2]), (None, None, rows[9][2]), (3, 7, rows[9][2])]
    bad = [(4000, 1, None), (4001, 1, []), (4002, 1, [None] * 32), (4003, 1, [float("inf")] + [0.0] * 31), (-5, 1, [float("nan")] * 32)]
    want = brute(rows)
    assert got(frame(spark, rows + bad).repartition(7)) == want
    assert got(frame(spark, rows + bad).coalesce(1)) == want


def test_few_rows_ties_and_other_shapes(spark):
    g = random.Random(5)
    tied = [(i, 0, [float(g.randint(-1, 1)) / 256 for _ in range(16)]) for i in range(90)]
    assert got(frame(spark, tied)) == brute(tied)
    few = tied[:5]
    assert got(frame(spark, few)) == brute(few)
    wide = [(i, i % 3, [g.uniform(-3, 3) for _ in range(24)]) for i in range(80)]
    assert got(frame(spark, wide), parts=4, entries=7, rounds=5) == brute(wide, 4, 7, 5)


def test_rescan_computes_less_and_finds_the_same():
    g = np.random.default_rng(6)
    x = g.integers(-3, 4, (500, 3))
    before = g.integers(-3, 4, (20, 3))
    codes, distances = vector_codes.scan(x, before)
    after = before.copy()
    after[[2, 7, 19]] += 1
    moved = (before != after).any(1)
    new, d, computed = vector_codes.rescan(x, after, moved, codes, distances)
    full, full_d = vector_codes.scan(x, after)
    assert (new == full).all() and (d == full_d).all()
    lost = moved[codes].sum()
    assert computed == lost * 20 + (500 - lost) * 3 < 500 * 20
    same, sd, none = vector_codes.rescan(x, before, np.zeros(20, bool), codes, distances)
    assert none == 0 and (same == codes).all() and (sd == distances).all()


def test_exact_beyond_doubles():
    x = np.array([[2**27, 1], [2**27 + 1, 0]])
    c, d = vector_codes.scan(x, np.array([[-(2**27), 0], [2**27 + 1, 1]]))
    assert c.tolist() == [1, 1] and d.tolist() == [1, 1]
    far = vector_codes.squared_distances(np.array([[2**28 + 1, 3]]), np.array([[-(2**28), 0]]))
    assert far.tolist() == [[(2**29 + 1) ** 2 + 9]]


def test_edges(spark):
    assert got(frame(spark, [])) == [] == got(frame(spark, [(1, 1, None), (2, 2, [float("nan")] * 16)]))
    with pytest.raises(Exception, match="one length"):
        got(frame(spark, [(1, 1, [1.0] * 15)]))
    with pytest.raises(Exception, match="length"):
        got(frame(spark, [(1, 1, [1.0] * 16), (2, 1, [1.0] * 32)]))
