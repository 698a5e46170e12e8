"""Repeated byte strings against a brute-force scan."""

import hashlib
import random

import pytest

from pagetrail.llm import suffix_dedup


def brute(rows, width):
    """rows: (doc_id, text); same-id rows told apart by text."""
    import zlib

    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()) >> 1)
    seen, cover = {}, {}
    for k, r in sorted({key(r): r for r in rows}.items()):
        b = (r[1] or "").encode()
        hit = [False] * len(b)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                hit[i : i + width] = [True] * width
            else:
                seen[w] = True
        cover[k] = hit
    out = []
    for r in rows:
        b, hit = (r[1] or "").encode(), cover[key(r)]
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((r[0], len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abé") for _ in range(g.randint(1, 6)))
    passages = [" ".join(word() for _ in range(g.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(g.randint(0, 40)))]
        for _ in range(g.randint(0, 3)):
            parts += [g.choice(passages)[g.randint(0, 20) :], " ".join(word() for _ in range(g.randint(0, 30)))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000, "a" * 700), (1001, "a" * 90 + "b" * 300), (5, None), (None, passages[0]), (7, ""), rows[2], (rows[3][0], passages[1] * 2)]
    rows.append((2000, "".join(chr(97 + (k * k) % 7) for k in range(3000)) + passages[2]))
    g.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,parts", [(100, 3), (24, 5), (5, 1)])
def test_digests_equal_brute_force(spark, width, parts, monkeypatch):
    rows = corpus(width)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((tuple(r) for r in suffix_dedup.digests(df, width).collect()), key=str)
    assert got == brute(rows, width)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, at string, doc string")
    assert suffix_dedup.digests(empty).count() == 0
    assert suffix_dedup.without_repeats(empty.drop("doc")).columns == ["doc_id", "text", "at"]


def test_text_stays_valid_and_copies_go(spark):
    one = "é" * 30 + "".join(chr(200 + k % 50) for k in range(200))
    rows = [(1, one, 9), (2, "tail " + one + " end", 9), (3, one, 9), (4, "  ", 9), (5, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert set(out) == {1, 2, 4, 5} and out[2].text == "tail  end" and out[2].n_chars == 9 and out[5].text is None
