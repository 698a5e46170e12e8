"""Chat formatting: layouts recognised by schema fingerprints, mapped to turns, formatted reversibly.

A layout is recognised by a hash of the nested field paths that matter, taken
from the schema of a table or from the keys of a JSON record. The hash selects
a declarative mapping to canonical turns (an array of role and text). New
layouts are new entries of ``LAYOUTS``.

The template marks every turn, and inside it the text that counts for the loss
(that of assistants). Strings that control this or other templates cannot
survive inside a text: their first character is replaced by an escape pair, and
the escape character by a pair of its own, so the text reads back exactly.

Everything here is a DataFrame expression; a conversation is one row, as its
formatted text is one string.

Rows: null roles and texts are empty; turns are ordered by turn, then role,
then text (nulls first); repeated rows are turns of their own; a null
conversation id is one conversation; a record of unknown layout gives null
turns; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the template.
TURN, END, LOSS, LOSS_END = "<|turn|>", "<|end|>", "<|loss|>", "<|/loss|>"
ESCAPE = "␛"
# Control strings of chat templates start with "<" or "[" before one of these.
AFTER_ANGLE = r"<(?=\||/?s>|</?SYS>>|start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)"
AFTER_BRACKET = r"\[(?=/?INST\])"
# Other names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "instruction": "system"}

#: name -> the field paths that make it, and where the turns come from: (role, path) for single fields,
#: (list, role, text) for lists, "rows" for a table with one row per turn.
LAYOUTS: dict[str, tuple[frozenset[str], object]] = {
    "rows": (frozenset({"turn", "role", "text"}), "rows"),
    "messages": (frozenset({"messages[].role", "messages[].content"}), ("messages", "role", "content")),
    "conversations": (frozenset({"conversations[].from", "conversations[].value"}), ("conversations", "from", "value")),
    "prompt": (frozenset({"prompt", "completion"}), (("user", "prompt"), ("assistant", "completion"))),
    "response": (frozenset({"prompt", "response"}), (("user", "prompt"), ("assistant", "response"))),
    "question": (frozenset({"question", "answer"}), (("user", "question"), ("assistant", "answer"))),
    "instruction": (frozenset({"instruction", "output"}), (("user", "instruction"), ("assistant", "output"))),
    "instruction+input": (frozenset({"instruction", "input", "output"}), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    "system+prompt": (frozenset({"system", "prompt", "response"}), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
}
KNOWN = sorted(frozenset().union(*(paths for paths, _ in LAYOUTS.values())))
TURNS = "array<struct<role:string,text:string>>"


def fingerprint(paths) -> str:
    """Hash of the field paths that some layout uses."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def paths_of(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; lists are marked by []."""
    if isinstance(schema, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in schema.fields for p in paths_of(f.dataType, dot + f.name)]
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(df: DataFrame) -> str | None:
    """The layout of a table, by the fingerprint of its schema."""
    return BY_FINGERPRINT.get(fingerprint(paths_of(df.schema)))


def _role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[low], role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(source: object, at) -> Column:
    """Turns by a declarative mapping; ``at`` gives the column of a path."""
    if isinstance(source[0], str):
        items, role, text = source
        return F.transform(at(items), lambda m: _turn(_role(m[role]), m[text]))
    return F.array(*[_turn(F.lit(role), at(path)) for role, path in source])


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table whose layout is known by its schema."""
    layout = layout_of(df)
    if layout is None:
        raise ValueError(f"no layout has the field paths {paths_of(df.schema)}")
    source = LAYOUTS[layout][1]
    if source == "rows":
        turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
        rows = df.groupBy(F.col(key).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
        return rows.select("conv_id", F.transform("t", lambda x: _turn(F.coalesce(x["role"], F.lit("")), x["text"])).alias("turns"))
    return df.select(F.col(key).cast("long").alias("conv_id"), _mapped(source, F.col).alias("turns"))


def _below(name: str):
    """A function of one column (transform counts parameters): the path of a key inside the list ``name``."""
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def canonical_json(df: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records of different layouts in one column, each by its own fingerprint.

    Two records that differ only in fields no layout uses have the same
    fingerprint; a record without a known one has a null layout and turns.
    """
    body = F.col(record)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    lists = sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})
    inner = [
        F.transform(
            F.coalesce(F.json_object_keys(F.get_json_object(body, f"$.{name}[0]")), F.array().cast("array<string>")),
            _below(name),
        )
        for name in lists
    ]
    found = F.array_sort(F.array_intersect(F.array_distinct(F.concat(keys, *inner)), F.array(*map(F.lit, KNOWN))))
    layout = F.create_map(*[F.lit(x) for pair in BY_FINGERPRINT.items() for x in pair])[F.sha2(F.array_join(found, "\n"), 256)]
    rows = df.select(F.col(key).cast("long").alias("conv_id"), body.alias("record")).withColumn("layout", layout)
    turns = F.lit(None).cast(TURNS)
    for name, (_, source) in LAYOUTS.items():
        if source == "rows":
            continue
        if isinstance(source[0], str):
            items, role, text = source
            kind = f"struct<{items}:array<struct<`{role}`:string,`{text}`:string>>>"
            parsed = F.from_json("record", kind)
            one = _mapped(source, lambda p, parsed=parsed: parsed[p])
        else:
            one = _mapped(source, lambda p: F.get_json_object("record", f"$.{p}"))
        turns = F.when(F.col("layout") == name, one).otherwise(turns)
    return rows.select("conv_id", "layout", turns.alias("turns"))


def escaped(text: Column) -> Column:
    own = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "E"))
    return F.regexp_replace(F.regexp_replace(own, AFTER_ANGLE, ESCAPE + "L"), AFTER_BRACKET, ESCAPE + "B")


def unescaped(text: Column) -> Column:
    for mark, char in (("N", "\n"), ("L", "<"), ("B", "["), ("E", ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + mark), F.lit(char))
    return text


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): each turn as mark, role, line feed, text (inside loss marks for an assistant), end mark."""

    def one(t: Column) -> Column:
        text = escaped(t["text"])
        body = F.when(t["role"] == "assistant", F.concat(F.lit(LOSS), text, F.lit(LOSS_END))).otherwise(text)
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit(ESCAPE + "N"))
        return F.concat(F.lit(TURN), role, F.lit("\n"), body, F.lit(END + "\n"))

    return conversations.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def _pattern(mark: str) -> str:
    return mark.replace("|", "\\|")


def read_back(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): the turns and the text under the loss mask, from the formatted text alone."""

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring_index(F.substring(piece, F.length(role) + 2, F.length(piece)), END, 1)
        text = F.replace(F.replace(body, F.lit(LOSS)), F.lit(LOSS_END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    pieces = F.split("formatted", _pattern(TURN), -1)
    masked = F.split("formatted", _pattern(LOSS), -1)
    tail = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    return rows.select(
        "conv_id",
        "formatted",
        F.transform(tail(pieces), one).alias("turns"),
        F.array_join(F.transform(tail(masked), lambda p: unescaped(F.substring_index(p, LOSS_END, 1))), "").alias("loss"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation (conv_id, turns): the digests of what reads back from its formatted text."""
    rows = read_back(formatted(conversations))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
