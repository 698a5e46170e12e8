"""Near-duplicate classes against all pairs by brute force."""

import random

import pytest

from pagetrail.llm import minhash_join


def shingles(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(sets[i]), low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n=60, length=120):
    g = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)] + ["the", "of"] * 40
    rows = []
    for _ in range(n):
        base = [g.choice(vocabulary) for _ in range(g.randint(1, length))]
        rows.append(" ".join(base))
        for _ in range(g.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(g.randint(0, max(1, len(copy) // 14))):
                copy[g.randrange(len(copy))] = g.choice(vocabulary)
            base = copy if g.random() < 0.5 else base
            rows.append("\n ".join(copy).upper() if g.random() < 0.2 else " ".join(copy))
    rows += ["", None, " \t\n", "one", "ONE", "one two", " "]
    out = [(3 * i, t) for i, t in enumerate(rows)] + [(0, rows[0]), (None, rows[1]), (None, "no id at all here"), (5, rows[9]), (6, "other text, same id")]
    g.shuffle(out)
    return out


@pytest.mark.parametrize("k,seed", [(2, 1), (5, 2), (2, 3)])
def test_components_equal_brute_force(spark, k, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in minhash_join.near_duplicates(df, k=k).collect()), key=str)
    assert got == brute(rows, k, 80)


def test_dense_chain_of_near_copies(spark):
    """Copies of copies: neighbours are similar, ends are not; one component, found without all pairs."""
    g = random.Random(5)
    words, rows = [f"x{g.randrange(10**6)}" for _ in range(150)], []
    for i in range(300):
        words = list(words)
        words[g.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash_join.near_duplicates(df, k=2).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, node string, sig string")
    assert minhash_join.near_duplicates(empty).count() == 0


def test_related_but_unlinked_documents(spark):
    """A group whose members share much and are not similar enough, beside a group of near copies of one of them; nothing is linked by mistake or lost."""
    g = random.Random(8)
    common = [f"c{i}" for i in range(70)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(common + [f"own{i}_{j}" for j in range(30)])))
    for i in range(40):
        words = (common + [f"own0_{j}" for j in range(30)])[:]
        words[g.randrange(100)] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in minhash_join.near_duplicates(df, k=2).collect()), key=str)
    assert got == brute(rows, 2, 80)


def test_members_of_different_components_meet_once(spark, monkeypatch):
    """A dense group beside relatives below the threshold: the last comparison makes each pair once, not once for every value that both post."""
    g = random.Random(12)
    base = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in g.sample(range(2, 48, 2), 2) if i < 40 else g.sample(range(52, 98, 2), 4):
            words[at] = f"n{i}_{at}"
        rows.append((i, " ".join(words)))
    made, shared = [], []
    candidates = minhash_join._candidates

    def recording(left, right, *args, once=False):
        out = candidates(left, right, *args, once=once)
        if once:
            made.extend((min(bytes(r.a), bytes(r.b)), max(bytes(r.a), bytes(r.b))) for r in out.collect())
            posts = {}
            for r in right.collect():
                posts.setdefault(bytes(r.node), set()).add(r.pair)
            shared.extend(len(posts[a] & posts[b]) for a, b in made)
        return out

    plans, stored = [], minhash_join.stored

    def planned(df, name):
        if name == "across":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(minhash_join, "_candidates", recording)
    monkeypatch.setattr(minhash_join, "stored", planned)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in minhash_join.near_duplicates(df, k=2).collect()), key=str)
    assert got == brute(rows, 2, 80)
    assert made and max(shared) > 1 and len(made) == len(set(made))
    assert "Aggregate" not in plans[0]  # the join itself makes them once


def test_superseded_folders_are_deleted(spark):
    import os

    from pagetrail.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    df = spark.createDataFrame(corpus(9, n=20), "doc_id long, text string")
    minhash_join.near_duplicates(df, k=2).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before}
    assert not left & {"features", "nodes", "postings", "mixed", "hooks"} and "rows" in left


def test_working_memory_does_not_grow_with_a_batch():
    import tracemalloc

    import numpy as np

    from pagetrail.llm import shingles

    data = np.frombuffer(" ".join(f"w{i % 9973}" for i in range(1_300_000)).encode(), np.uint8)
    off = np.append(np.arange(0, len(data), 4000), len(data))
    tracemalloc.start()
    try:
        for r0, r1 in shingles.row_groups(off):
            row, h = shingles.shingle_sets(off[r0 : r1 + 1] - off[r0], data[off[r0] : off[r1]], 5)
            size, _ = minhash_join._digests(r1 - r0, row, h)
            minhash_join._signatures(r1 - r0, row, h, size, 40), minhash_join._parity(r1 - r0, row, h)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()


def test_whole_texts_go_to_python_in_batches_of_bounded_bytes(spark, monkeypatch, tmp_path):
    """Some 200 texts of 80 kB are few rows and many bytes; a worker gets a few of them at a time, and the session keeps its own limit."""
    in_arrow, seen = minhash_join.in_arrow, str(tmp_path / "sizes")

    def recording(df, fn, schema, *more):
        def run(batches):
            for b in batches:
                with open(seen, "a") as f:
                    f.write(f"{schema.split()[0]} {b.num_rows} {b.nbytes}\n")
                yield from fn([b])

        return in_arrow(df, run, schema, *more)

    monkeypatch.setattr(minhash_join, "in_arrow", recording)
    rows = []
    for i in range(100):
        words = [f"w{i}x{j}" for j in range(11_000)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = minhash_join.near_duplicates(df, k=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(i, i // 2 * 2) for i in range(200)]
    sizes = [line.split() for line in open(seen)]
    assert {s[0] for s in sizes} == {"doc_id", "a"}
    assert sum(int(s[1]) for s in sizes if s[0] == "doc_id") == 200
    assert max(int(s[2]) for s in sizes) < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
