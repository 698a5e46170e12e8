"""The corpus pipeline stage by stage on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402


def corpus(path, spark):
    g = random.Random(2)
    make = {"en": ["th", "ing", "and", "er", "st"], "fr": ["eau", "é", "que", "oi", "ment"]}

    def text(lang, n):
        return " ".join("".join(g.choice(make[lang]) for _ in range(g.randint(1, 4))) for _ in range(n))

    passage, leak = text("en", 70), text("en", 40)
    rows = [(i, text(lang, g.randint(60, 150)), lang, "s") for i, lang in enumerate(["en", "fr"] * 40)]
    near = rows[4][1].split()
    near[50] = "changed"
    rows += [
        (200, rows[4][1], "en", "s"), (201, " ".join(near), "en", "s"), (202, "1234 !!", "en", "s"), (203, None, "en", "s"),
        (210, text("en", 80) + " " + passage + " " + text("en", 80), "en", "s"), (211, text("en", 90) + " " + passage, "en", "s"),
        (220, text("en", 50) + " " + leak.upper() + " " + text("en", 50), "en", "s"), rows[7],
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, passage


def test_every_stage_takes_effect(spark, tmp_path):
    rows, passage = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [sorted(r.doc_id for r in docs.collect())]
    for name, stage in P.STAGES:
        before = docs
        docs = P.stored(stage(spark, docs, str(tmp_path)), name)
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
        if name == "repeated_passages":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert passage in text[210] and passage not in text[211] and len(text[211]) > 300
    clean = sorted([*range(80), 210, 211])
    assert seen[1] == sorted([*range(80), 7, 200, 201, 210, 211, 220])
    assert seen[2] == sorted([*range(80), 210, 211, 220]) and seen[3] == seen[2]
    assert seen[4] == clean and seen[5] == clean
    assert docs.filter("not exact or n_tokens <> size(token_ids)").count() == 0


def test_run_equals_the_stages(spark, tmp_path):
    corpus(str(tmp_path), spark)
    assert P.run(spark, str(tmp_path)).count() == 82


def test_empty_table(spark, tmp_path):
    corpus(str(tmp_path / "full"), spark)
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path / "full"))
        assert docs.count() == 0


def test_a_corpus_without_labels_passes_through(spark):
    docs = spark.createDataFrame([(1, "some words here", None, "s", 15), (2, None, None, "s", 0), (3, "123", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, P.language_id(spark, docs, "").collect())) == sorted(map(tuple, docs.collect()))


def test_short_and_mixed_texts_stay(spark, tmp_path):
    rows, _ = corpus(str(tmp_path), spark)
    en, fr = [r[1] for r in rows if r[2] == "en"][:9], [r[1] for r in rows if r[2] == "fr"][:9]
    halves = [(900 + i, a[: len(a) // 2] + " " + b[: len(b) // 3], "en", "s", 0) for i, (a, b) in enumerate(zip(en, fr))]
    short = [(950 + i, " ".join(t.split()[:2]), "en", "s", 0) for i, t in enumerate(en)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").union(spark.createDataFrame(halves + short, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in P.language_id(spark, docs, "").collect()}
    assert len(kept & {r[0] for r in halves}) >= 8 and len(kept & {r[0] for r in short}) >= 8 and not kept & {202, 203}
