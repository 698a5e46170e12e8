"""Licence scan against a word-by-word search, and the expression parser."""

import random
import re

import pytest

from pagetrail.llm import license_scan as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    g = random.Random(1)
    vocabulary = ["MIT", "mit", "License", "license", "apache", "general", "GENERAL", "Public", "été", "x1", "--", "LICENSE.", "(mit)", "lesser", "\n", "ſ", "İ"]
    rows = [(i, "".join(g.choice(vocabulary) + g.choice([" ", "-", "", "\t"]) for _ in range(g.randint(0, 60)))) for i in range(300)]
    rows += [(None, None), (1, ""), (1, "mit license"), (7, "mit license mit license"), (8, "a " * 50000 + "MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as labels", "1 as n_words")
    got = sorted((tuple(r)[:6] for r in L.scans(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in L.scans(df).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert L.scans(df.limit(0)).count() == 0


def test_shunting_yard():
    assert L.postfix("a OR b AND c WITH e".split()) == ["a", "b", "c", "e", "with", "and", "or"]
    assert L.postfix("( a or b ) and c".split()) == ["a", "b", "or", "c", "and"]
    assert L.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT".split()) == ({"gpl", "mit"}, 2)
    assert L.evaluate("( MIT OR GPL-3.0-or-later ) AND CC-BY-NC-4.0".split()) == ({"mit", "gpl", "cc-by-nc"}, 0)
    assert L.evaluate(["LicenseRef-Own"]) == ({"licenseref-own"}, None)
    for bad in ("MIT OR", "( MIT", "MIT MIT", "AND MIT", ")", ""):
        with pytest.raises(L.Malformed):
            L.postfix(bad.split())


def test_tags_and_notices():
    s = L.Scanner().scan
    one = s("// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause.\ncode")
    assert one.labels == {"apache", "mit", "bsd"} and one.base == set() and one.freedom == 2 and len(one.expressions) == 1
    assert s("SPDX-License-Identifier: GPL-2.0+").labels == {"gpl"}
    assert s("SPDX-License-Identifier: MIT OR OR x").labels == {"mit"}
    assert s("under the GNU Lesser General Public License").labels == {"gpl", "lgpl"}
    assert s("Licensed under CC BY-NC 4.0.").labels == {"cc-by", "cc-by-nc"}
    assert s("nothing here").labels == set()


def test_words_after_a_tag_that_are_no_identifiers():
    s = L.Scanner().scan
    for text in ("license-expression: see the file", "SPDX-License-Identifier: ??? hello", "@license none", "SPDX-License-Identifier: NOASSERTION", "@license well-known one", "@license"):
        got = s(text)
        assert got.labels == set() and got.expressions == [] and got.doubt == 1.0, text
    assert s("SPDX-License-Identifier: Artistic-2.0 OR MIT").labels == {"artistic-2.0", "mit"}
    assert s("SPDX-License-Identifier: LicenseRef-My.Own-1").labels == {"licenseref-my.own-1"}
    assert s("SPDX-License-Identifier: EUPL-1.2+ AND PostgreSQL").labels == {"eupl-1.2", "postgresql"}
    assert s("SPDX-License-Identifier: MIT AND something").labels == {"mit"}
    assert s("SPDX-License-Identifier:\tMIT, see file").labels == {"mit"}
