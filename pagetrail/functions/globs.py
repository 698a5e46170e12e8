"""Shell-style glob patterns translated to anchored Java regular expressions.

Semantics (case-sensitive; callers lower-case both sides):
  ``*`` any run of characters, including ``.`` and ``/``; ``?`` one character;
  ``[seq]`` / ``[!seq]`` character classes with ``a-z`` ranges; a ``]`` right
  after the opening bracket is literal; an unclosed ``[`` is a literal; a
  reversed range such as ``z-a`` matches nothing.

Every literal is emitted as ``\\x{HEX}`` so no Java metacharacter (``&&``,
nested ``[``, ``^``) can change the meaning of the pattern.
"""

from __future__ import annotations

import re


def _lit(ch: str) -> str:
    return "\\x{%X}" % ord(ch)


def _class(body: str) -> str | None:
    """Translate the inside of ``[...]``; None when it can never match."""
    negate = body.startswith("!")
    if negate:
        body = body[1:]
    items: list[str] = []
    i = 0
    n = len(body)
    while i < n:
        if i + 2 < n and body[i + 1] == "-":
            lo, hi = body[i], body[i + 2]
            if lo <= hi:
                items.append(f"{_lit(lo)}-{_lit(hi)}")
            i += 3
        else:
            items.append(_lit(body[i]))
            i += 1
    if not items:
        return "." if negate else None
    return "[" + ("^" if negate else "") + "".join(items) + "]"


def glob_to_regex(pattern: str) -> str:
    out: list[str] = []
    i = 0
    n = len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(_lit("["))
                continue
            cls = _class(pattern[i:j])
            out.append(cls if cls is not None else "(?!)")
            i = j + 1
        else:
            out.append(_lit(ch))
    return r"\A(?s:" + "".join(out) + r")\z"


def literal_part(pattern: str) -> str | None:
    """The pattern itself when it has no glob metacharacters, else None."""
    return None if any(c in pattern for c in "*?[") else pattern


def dot_suffix_part(pattern: str) -> str | None:
    """For ``*.rest`` with a literal, slash-free rest: ``.rest``; else None."""
    if pattern.startswith("*.") and "/" not in pattern:
        rest = pattern[1:]
        if literal_part(rest) is not None:
            return rest
    return None


_WILD = re.compile(r"\*|\?|\[!?\]?[^\]]*\]|\[")


def literal_runs(pattern: str) -> list[str]:
    """Strings that every match of the pattern contains: what stands between its wildcards."""
    return [run for run in _WILD.split(pattern) if run]
