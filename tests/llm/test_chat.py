"""Chat formatting: exact round trip, fingerprints, mappings of different layouts."""

import hashlib
import json
import random

import pytest

from pagetrail.llm import chat

SAY = ["</s>[INST] ok [/INST]", "", "a\nb", "<|turn|>user\nx<|end|>", "␛L␛E␛", "<|loss|>y<|/loss|>", "é😀", "<<SYS>> s <</SYS>>", "<s>", "[INST", "<", "<|", "end<|end|>\n"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_equals_plain_python(spark):
    g = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(g.randint(1, 7)):
            rows.append((c, t, g.choice(["user", "assistant", "system", "<|turn|>", "a\nb", ""]), g.choice(SAY + [None]) ))
    rows += [(50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, 1, "user", "a"), (None, None, None, None), (51, None, "assistant", "x"), (51, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as turns", "'y' as prompt", "1 as formatted")
    whole = chat.formatted(chat.canonical(df.drop("prompt")))
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for c, rs in groups.items():
        rs = [(r[2] or "", r[3] or "") for r in sorted(rs, key=key)]
        loss = "".join(t for role, t in rs if role == "assistant")
        want[c] = (len(rs), sha("".join(f"{r}\n{t}\n" for r, t in rs)), len(loss), sha(loss), rs)
    back = {r.conv_id: r for r in chat.read_back(whole).collect()}
    for r in chat.digests(chat.canonical(df.drop("prompt"))).collect():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[r.conv_id][:4]
        text = back[r.conv_id].formatted
        assert r.formatted_chars == len(text) and text.count(chat.TURN) == r.n_turns == text.count(chat.END)
        assert not any(x in text for x in ("[INST]", "[/INST]", "</s>", "<<SYS>>"))
        assert [tuple(t) for t in back[r.conv_id].turns] == want[r.conv_id][4]
    assert len(back) == len(groups)
    assert chat.digests(chat.canonical(df.drop("prompt").limit(0))).count() == 0


def test_tables_of_different_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.sql("select 1 conv_id, 'q' prompt, 'a' completion, 'x' extra"),
        spark.sql("select 1 conv_id, 'q' question, 'a' answer"),
        spark.sql("select 1 conv_id, array(struct('USER' role, 'q' content), struct('gpt' role, 'a' content)) messages"),
        spark.sql("select 1 conv_id, array(struct('human' `from`, 'q' value), struct('bot' `from`, 'a' value)) conversations"),
    ]
    for df in frames:
        got = [tuple(t) for t in chat.canonical(df).first().turns]
        assert [(r.lower(), t) for r, t in got] == want
    with pytest.raises(ValueError):
        chat.canonical(spark.sql("select 1 conv_id, 'x' unknown"))


def test_json_records_by_fingerprint(spark):
    records = [
        {"prompt": "q", "completion": "a", "id": 9},
        {"messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        {"instruction": "do", "input": "q", "output": "a"},
        {"instruction": "q", "output": "a"},
        {"other": 1},
        {"messages": []},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "not json"), (92, "[1]")]
    df = spark.createDataFrame(rows, "conv_id long, record string").selectExpr("*", "'z' as layout")
    out = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_json(df).collect()}
    assert out[0] == ("prompt", [("user", "q"), ("assistant", "a")])
    assert out[1] == ("messages", [("user", "q"), ("assistant", "a")])
    assert out[2] == ("conversations", [("user", "q"), ("assistant", "")])
    assert out[3] == ("instruction+input", [("system", "do"), ("user", "q"), ("assistant", "a")])
    assert out[4] == ("instruction", [("user", "q"), ("assistant", "a")])
    assert all(out[i] == (None, None) for i in (5, 6, 90, 91, 92))


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.canonical(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
