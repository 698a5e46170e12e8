"""Language identification: held-out accuracy, the training sample and the edge cases."""

import random
import zlib

import numpy as np

from pagetrail.llm import lang_id

SYLLABLES = {"en": ["th", "ing", "and", "er"], "fr": ["eau", "é", "que", "oi"], "de": ["sch", "ung", "ö", "en"]}


def corpus(n=240, seed=1):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        lang = g.choice(list(SYLLABLES))
        words = ["".join(g.choice(SYLLABLES[lang]) for _ in range(g.randint(1, 4))) for _ in range(g.randint(1, 150))]
        rows.append((i, " ".join(words), lang if g.random() < 0.9 else None, lang))
    return rows


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    extra = [(1000, None, "en", None), (1001, "12 34 !?", "en", None), (None, "the thing and", None, None), (0, rows[0][1], "xx", None)]
    df = spark.createDataFrame([r[:3] for r in rows + extra[:3]], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as lang_pred")
    out = {r.doc_id: r for r in lang_id.predictions(df).collect()}
    assert len(out) == len(rows) + 3
    right = [out[i].lang_pred == truth for i, _, _, truth in rows if out[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    for i, *_ in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= out[i].score <= 1
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0 and out[None].held_out


def test_training_never_sees_held_out_rows(spark):
    rows = [(i, f"t{i} abc", "held" if zlib.crc32(str(i).encode()) % 4 == 2 else "seen") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in lang_id.training_windows(df).collect()} == {"seen"}
    assert {r.lang_pred for r in lang_id.predictions(df).collect()} == {"seen"}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.predictions(df).first().lang_pred == "und"
    assert lang_id.predictions(df.limit(0)).count() == 0


def test_all_windows_of_a_long_text_count():
    net = lang_id.ByteNetwork(["a", "b"])
    g = np.random.default_rng(1)
    texts = [g.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 127, 128, 129, 1000, 70000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = net.texts(off, np.concatenate(texts))
    assert (p[0] == 0).all()
    for t, q in zip(texts[1:], p[1:]):
        starts = [max(0, min(s, len(t) - 128)) for s in range(0, len(t), 128)]
        w = np.zeros((len(starts), 128), np.uint8)
        for i, s in enumerate(starts):
            w[i, : len(t[s : s + 128])] = t[s : s + 128]
        assert np.allclose(net.probabilities(w).mean(0), q, atol=1e-5)
