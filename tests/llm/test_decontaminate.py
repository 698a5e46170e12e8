"""Benchmark leaks against a search over all alignments."""

import itertools
import random
import re

from pagetrail.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for item, itext in items:
            b = words(itext)
            if not b:
                continue
            length = min(len(b), D.WINDOW)
            for s in range(-len(b) + 1, len(w)):
                same = [0 <= s + j < len(w) and w[s + j] == b[j] for j in range(len(b))]
                enough = any(sum(same[i : i + length]) * 100 >= length * D.PERCENT for i in range(len(b) - length + 1))
                if enough:
                    out[d, item] = max(out.get((d, item), 0), sum(same))
    return out


def test_leaks_equal_brute_force(spark):
    g = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(60)] + ["the", "of"]
    say = lambda n: [g.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([6, 8, 15, 25, 40, 60, 20, 5, 0])] + [(20, None), (21, "the of the of the of the")]
    docs = []
    for i in range(80):
        parts = say(g.randint(0, 120))
        if g.random() < 0.6:
            leak = items[g.randrange(7)][1].split()
            leak = leak[g.choice([0, 0, 3]) :]
            for _ in range(g.randint(0, len(leak) // 5)):
                leak[g.randrange(len(leak))] = "substitute"
            parts[len(parts) // 2 : len(parts) // 2] = leak
        text = g.choice([" ", ", ", "\n"]).join(parts)
        docs.append((i, text.upper() if g.random() < 0.2 else text))
    every_fifth = items[5][1].split()
    every_fifth[4::5] = ["gap"] * len(every_fifth[4::5])
    docs += [(100, " ".join(every_fifth)), (101, None), (102, ""), (103, "?!"), (7, items[4][1]), docs[3], (None, items[3][1])]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as w")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = {(r.doc_id, r.item_id): r.n_matched for r in D.leaks(df, bench).collect()}
    assert got == brute(docs, items)
    assert (100, 5) in got and (None, 3) in got
    clean = D.decontaminated(df, bench)
    assert clean.columns == df.columns
    bad = {(d, t) for d, t in docs if brute([(d, t)], items)}
    assert sorted((tuple(r)[:2] for r in clean.collect()), key=str) == sorted((x for x in docs if x not in bad), key=str)


def test_large_benchmarks_take_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    small = D.leaks(docs, bench).collect()
    monkeypatch.setattr(D, "BROADCAST_WORDS", 0)
    assert D.leaks(docs, bench).collect() == small and len(small) == 1
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    plan = D.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def patterns(length):
    """All ways to substitute at most 20 % of ``length`` words, as lists of equal places."""
    for k in range(length * (100 - D.PERCENT) // 100 + 1):
        for wrong in itertools.combinations(range(length), k):
            yield [i not in wrong for i in range(length)]


def hit(same, masks):
    return any(all(same[i + o] for o, c in enumerate(m) if c == "1") for m in masks for i in range(len(same) - len(m) + 1))


def test_no_pattern_of_substitutions_lacks_a_seed():
    for length in range(6, D.WINDOW + 1):
        assert [same for same in patterns(length) if not hit(same, D.masks_for(length))] == [], length
    for length, percent in ((7, 50), (12, 60), (9, 100)):  # other shares by the longest unbroken run
        k = length * (100 - percent) // 100
        for wrong in itertools.combinations(range(length), k):
            assert hit([i not in wrong for i in range(length)], D.masks_for(length, percent))


def test_every_short_pattern_is_found(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (6, 7, 8, 10, 15)]
    docs = [(0, "nothing here")]
    for n, text in items:
        for same in patterns(n):
            docs.append((len(docs), " ".join(["before"] * 3 + [w if s else "other" for w, s in zip(text.split(), same)] + ["after"])))
    twenty = [f"i20w{j}" for j in range(20)]
    items.append((20, " ".join(twenty)))
    docs.append((len(docs), " ".join("other" if j in (5, 8, 12, 14) else w for j, w in enumerate(twenty))))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_matched for r in got.collect()} == brute(docs, items)
    assert got.count() == len(docs) - 1


def test_short_items_are_judged(spark):
    items = [(0, "Solitary!"), (2, "two words"), (3, "now three words"), (4, "here are four words"), (5, "an item of five words"), (9, "?!")]
    docs = [(i, f"before {t.upper()} after") for i, t in items]
    docs += [(i, t) for i, t in ((10, "two other words"), (14, "here are four"), (15, "an item with five words"), (16, "an thing with five words"), (17, "item of five words"))]
    docs += [(18, "solitary"), (19, None), (20, "")]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(0, 0): 1, (2, 2): 2, (3, 3): 3, (4, 4): 4, (5, 5): 5, (15, 5): 4, (17, 5): 4, (18, 0): 1}
    assert {(r.doc_id, r.item_id): r.n_matched for r in got.collect()} == want
    for length in range(1, 6):
        assert [same for same in patterns(length) if not hit(same, D.masks_for(length))] == []


def test_scripts_without_spaces_are_compared_by_letter(spark):
    han, kana, thai, mixed = "光合作用把光能变成化学能", "カレーはとてもおいしいです", "แมวนอนอยู่บนโต๊ะ", "water水是H2O分子"
    items = list(enumerate([han, kana, thai, mixed]))
    docs = [(i, f"前文说{t}后文") for i, t in items] + [(10, han.replace("把", "将")), (11, "光合作用。" + "能" * 20), (12, "water is H2O")]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (10, 0)}
    one = spark.createDataFrame([(mixed, "naïve Übung, 42 déjà")], "a string, b string").select(D.words(D.F.col("a")), D.words(D.F.col("b"))).first()
    assert one[0] == ["water", "水", "是", "h2o", "分", "子"] and one[1] == ["naïve", "übung", "42", "déjà"]


def test_seeds_come_from_generated_code(spark):
    """No lambda hashes masks at every position, and the words of a text are made once."""
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string").select("doc_id", D.words(D.F.col("text")).alias("w"))
    plan = D._seed_rows(docs, D.MASKS_FROM[-1][1], "doc_id")._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line or "Generate posexplode" in line]
    assert made and all("*(" in line.split("Generate")[0] for line in made)
    assert plan.count("split(") == 1 and plan.count("lower(") == 1


def test_pieces_lose_no_seed(spark, monkeypatch):
    g = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(g.choice(vocabulary) for _ in range(n))) for n in (1, 2, 5, 7, 12, 16, 20, 33)]
    docs = [(0, "w1"), (1, "")]
    for i in range(30):
        parts = [g.choice(vocabulary) for _ in range(g.randint(0, 50))]
        for n in (4, 5, 6, 7):
            leak = items[n][1].split()
            leak[g.randrange(len(leak))] = "substitute"
            parts += leak + [g.choice(vocabulary) for _ in range(g.randint(0, 9))]
        docs.append((2 + i, " ".join(parts)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for piece in (1, 3, 1_000):
        monkeypatch.setattr(D, "PIECE", piece)
        assert {(r.doc_id, r.item_id): r.n_matched for r in D.leaks(df, bench).collect()} == want
    masks = D.MASKS_FROM[-1][1]
    w = [g.choice(vocabulary) for _ in range(2_500)]
    rows = D._seed_rows(spark.createDataFrame([(1, w)], "doc_id long, w array<string>"), masks, "doc_id").collect()
    assert sorted(r.p for r in rows) == sorted(i for m in masks for i in range(len(w) - len(m) + 1))
