"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Encoding works on the pieces of the vocabulary's split pattern. Inside a piece
the merge list decides; how far to the right of a token bytes can still change
it is bounded by :func:`sufficient_lookahead`, computed from the merge list.
Every piece is therefore fed to the transducer in blocks: tokens that end at
least that far before the end of the bytes held, or in a piece that has ended,
are stable and emitted at once; the rest is held and encoded again together with
the next block. Memory does not grow with the piece. Many pieces take a step of
the transducer together; the ids of pieces that end within one block are
remembered in a cache bounded by its bytes.

Decoding maps ids to bytes and feeds an incremental UTF-8 state machine that
keeps only the unfinished character; bytes that are not UTF-8 become U+FFFD.

Vocabulary files are read on the driver from a path that is a parameter and
sent to the tasks as a broadcast (their size does not depend on the data).

Rows: a null text is empty (no ids); the file's special strings inside a text
become their ids, as the tokenizers library does; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import in_arrow

# Fixed value: the split pattern of byte-level vocabularies, with L, N and S for letters, numbers and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
ANY = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": r"\t-\r \x85\xa0"}
REMEMBERED = 96 << 20  # bytes, about, of the pieces that a worker remembers
BLOCK = 256  # characters of a piece that are fed to the transducer at a time
FEW = 24  # pieces; so many are merged faster together in numpy than one after the other
GROUP = 16_384  # pieces whose ids are emitted together
TOGETHER = 1 << 20  # characters of texts that are encoded together


def visible_bytes() -> dict[str, int]:
    """The characters that vocabulary files write for the 256 bytes: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes right of a token's end beyond which nothing can change the token.

    ``merges`` are (left, right, result) by rank, ``size`` the bytes of a token.
    Let the bytes before some point be final after all ranks below r. The rule
    (u, v) of rank r can unsettle a final u at that point only if v can begin
    right after u, that is if the token t which an earlier rule (t, .) unsettled
    there is v or a leftmost part of v; then the unsettled stretch grows by u.
    The longest such chain, in bytes, is the bound.
    """
    left_part = {}
    reach: dict[int, int] = {}
    bound = 0
    for u, v, w in merges:
        left_part.setdefault(w, set()).add(u)
        begins, todo = set(), [v]
        while todo:
            t = todo.pop()
            if t not in begins:
                begins.add(t)
                todo.extend(left_part.get(t, ()))
        grown = size[u] + max((reach.get(t, 0) for t in begins), default=0)
        reach[u] = max(reach.get(u, 0), grown)
        bound = max(bound, grown)
    return bound


class Vocabulary(dict):
    """Ids, merges and bytes of one byte-level vocabulary; as a dict, the ids of remembered pieces."""

    def __init__(self, source: bytes):
        super().__init__()
        self.held = 0  # bytes, about, of the remembered pieces
        spec = json.loads(source)
        table, code = spec["model"]["vocab"], visible_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*table.values(), *self.special.values()]))
        for text, i in table.items():
            self.bytes[i] = bytes(code[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.names = [str(i) for i in range(len(self.bytes))]
        self.first = [0] * 256
        for c, b in code.items():
            self.first[b] = table[c]
        rules = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        triples = [(table[a], table[b], table[a + b]) for a, b in rules]
        self.rank = {(a << 32) | b: r for r, (a, b, _) in reversed(list(enumerate(triples)))}
        self.result = [w for _, _, w in triples] + [0]
        self.lookahead = sufficient_lookahead(triples, {i: len(b) for i, b in enumerate(self.bytes)})
        made, used = {}, {}
        for r, (u, v, w) in enumerate(triples):
            made[w] = r
            used.setdefault(u, r)
            used.setdefault(v, r)
        self.ordered = all(r < used.get(w, r + 1) for w, r in made.items())  # a merge never makes room for one of lower rank
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        self.results, self.firsts = np.array(self.result, np.int64), np.array(self.first, np.int64)
        fill = lambda names: "".join(names.get(c, c) for c in PATTERN)
        self.split, self.split_latin = regex.compile(fill(ANY)), re.compile(fill(LATIN))
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of the bytes of one window: the lowest rank first, the leftmost of equals."""
        ids = [self.first[b] for b in data]
        rank, result, none = self.rank.get, self.result, len(self.result) - 1
        pairs = [rank((a << 32) | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            w, i = result[best], 0
            for _ in range(pairs.count(best) if self.ordered else 1):
                try:
                    i = pairs.index(best, i)
                except ValueError:  # it overlapped the one before
                    break
                del ids[i + 1], pairs[i]
                ids[i] = w
                if i:
                    pairs[i - 1] = rank((ids[i - 1] << 32) | w, none)
                if i < len(pairs):
                    pairs[i] = rank((w << 32) | ids[i + 1], none)
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Like :meth:`merge` for many non-empty windows, one merge of every window at a time."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        who = np.arange(len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.firsts[np.frombuffer(b"".join(pieces), np.uint8)]
        none = len(self.results) - 1

        def looked_up(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = (left << 32) | right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.ranks[at], none)

        rank = np.full(len(ids), none)
        rank[:-1] = looked_up(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = none
        while len(who):
            end = np.cumsum(size)
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), end - size)
            done = (best >> 32) == none
            if done.any():
                for w, s, e in zip(who[done].tolist(), (end - size)[done].tolist(), end[done].tolist()):
                    out[w] = tuple(ids[s:e].tolist())
                stay = np.repeat(~done, size)
                moved = np.cumsum(stay) - 1
                ids, rank, who, size, best = ids[stay], rank[stay], who[~done], size[~done], best[~done]
                best = (best & ~np.int64(0xFFFFFFFF)) | moved[best & 0xFFFFFFFF]
                if not len(who):
                    break
            at = best & 0xFFFFFFFF
            ids[at] = self.results[best >> 32]
            rank[at] = rank[at + 1]  # of the last token: none
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, size = ids[keep], rank[keep], size - 1
            at -= np.arange(len(at))
            end = np.cumsum(size)
            inner = at < end - 1
            rank[at[inner]] = looked_up(ids[at[inner]], ids[at[inner] + 1])
            inner = at > end - size
            rank[at[inner] - 1] = looked_up(ids[at[inner] - 1], ids[at[inner]])
        return out

    def step(self, windows: list[bytes], ended: list[bool]) -> Iterator[tuple[tuple[int, ...], bytes]]:
        """One step of the transducer for many pieces: per window the ids that no later byte can change, and the bytes still held.

        A token is stable if it ends the lookahead before the window's end or earlier, or if the piece has ended.
        """
        merged = self.merge_many(windows) if len(windows) >= FEW else map(self.merge, windows)
        for window, last, ids in zip(windows, ended, merged):
            limit, end, n = len(window) - (0 if last else self.lookahead), 0, 0
            if last:
                yield tuple(ids), b""
                continue
            for i in ids:
                if end + len(self.bytes[i]) > limit:
                    break
                end += len(self.bytes[i])
                n += 1
            yield tuple(ids[:n]), window[end:]

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def remember(self, pieces: Iterable[str]) -> None:
        """Feed those of the pieces that end within a block and are not yet known, all at once."""
        if self.held > REMEMBERED:
            self.clear()
        new = [p for p in set(pieces) if p not in self and len(p) <= BLOCK]
        if new:
            ids = self.step([p.encode("utf-8", "surrogatepass") for p in new], [True] * len(new))
            self.update(zip(new, (i for i, _ in ids)))
            self.held += sum(240 + 10 * len(p) for p in new)

    def pieces(self, text: str) -> Iterator[str]:
        """The split of a text without special strings."""
        split = self.split_latin if text.isascii() or max(text) <= "\xff" else self.split
        return (m.group() for m in split.finditer(text)) if len(text) > 1 << 20 else iter(split.findall(text))

    def stream(self, blocks: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of one piece that arrives in blocks; each is emitted once no later byte can change it."""
        held, coming = b"", iter(blocks)
        block = next(coming, None)
        while block is not None:
            following = next(coming, None)
            ((ids, held),) = self.step([held + block], [following is None]) if held or block else [((), b"")]
            if ids:
                yield ids
            block = following

    def long_piece(self, piece: str) -> Iterator[tuple[int, ...]]:
        """Ids of a piece of more than one block."""
        return self.stream(piece[i : i + BLOCK].encode("utf-8", "surrogatepass") for i in range(0, len(piece), BLOCK))

    def emitted(self, pieces: list[str]) -> Iterator[list[int]]:
        """Ids of remembered pieces in one list; a piece of more than one block never has all its ids in memory."""
        if max(map(len, pieces)) <= BLOCK:
            yield list(chain.from_iterable(map(self.__getitem__, pieces)))
            return
        for piece in pieces:
            if len(piece) <= BLOCK:
                yield list(self[piece])
            else:
                yield from map(list, self.long_piece(piece))

    def encode_all(self, texts: list[str]) -> Iterator[Iterable[list[int]]]:
        """Per text its ids in groups; texts of ordinary length share the encoding of new pieces."""
        at = 0
        while at < len(texts):
            stop, total = at, 0
            while stop < len(texts) and (stop == at or total + len(texts[stop]) <= TOGETHER):
                total += len(texts[stop])
                stop += 1
            if total > TOGETHER:  # one very long text
                yield self.encode(texts[at])
            else:
                split = [
                    None if self.marks and any(m in t for m in self.special) else list(self.pieces(t)) for t in texts[at:stop]
                ]
                self.remember(chain.from_iterable(s for s in split if s))
                for t, s in zip(texts[at:stop], split):
                    yield self.encode(t) if s is None else self.emitted(s) if s else ()
            at = stop

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text in groups of bounded size."""
        parts = self.marks.split(text) if self.marks and any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
                continue
            pieces = self.pieces(part)
            while group := list(islice(pieces, GROUP)):
                self.remember(group)
                yield from self.emitted(group)


@functools.lru_cache(maxsize=2)
def vocabulary_of(source: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, kept by a worker process between tasks."""
    return Vocabulary(source)


def forgetting(run):
    """A task that forgets the remembered pieces at its end; the worker process serves other stages as well."""

    def task(batches, vocabulary):
        try:
            yield from run(batches, vocabulary)
        finally:
            vocabulary.clear()

    return task


class ByteToText:
    """Incremental decoder: ids in, text out; keeps the bytes of at most one unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], final: bool = False) -> str:
        return self.state.decode(b"".join([self.bytes[i] for i in ids]), final)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256 (decoded text)."""
    source = _vocabulary(documents, path)

    @forgetting
    def run(batches, vocabulary):
        names = vocabulary.names
        for b in batches:
            rows = []
            for groups in vocabulary.encode_all([t or "" for t in b.column("text").to_pylist()]):
                n, ids_sha, text_sha, back, gap = 0, hashlib.sha256(), hashlib.sha256(), ByteToText(vocabulary), ""
                for ids in groups:
                    n += len(ids)
                    ids_sha.update((gap + ",".join([names[i] for i in ids])).encode())
                    text_sha.update(back.feed(ids).encode())
                    gap = ","
                text_sha.update(back.feed([], True).encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(documents.select("doc_id", "text"), lambda batches: run(batches, vocabulary_of(source.value)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, path: str, column: str = "token_ids") -> DataFrame:
    """``documents`` with the ids of the whole text as an array column and their number as ``n_tokens``.

    Existing columns of these names are replaced.
    """
    source = _vocabulary(documents, path)
    base = documents.drop(column, "n_tokens")
    names = base.columns

    @forgetting
    def run(batches, vocabulary):
        for b in batches:
            for r0 in range(0, max(1, b.num_rows), 256):
                part = b.slice(r0, 256)
                ids = [list(chain.from_iterable(g)) for g in vocabulary.encode_all([t or "" for t in part.column("text").to_pylist()])]
                extra = [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*names, column, "n_tokens"])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return in_arrow(base, lambda batches: run(batches, vocabulary_of(source.value)), schema)


def decoded(encoded_rows: DataFrame, path: str, column: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded_rows`` with the text of their ids as column ``text``; a null list is an empty text.

    Rows that come straight from :func:`encoded` are decoded in the same worker process, with the same vocabulary.
    """
    source = _vocabulary(encoded_rows, path)
    base = encoded_rows.drop(text) if text in encoded_rows.columns else encoded_rows
    names = base.columns

    def run(batches):
        vocabulary = vocabulary_of(source.value)
        for b in batches:
            out = []
            for ids in b.column(column):
                back, ids = ByteToText(vocabulary), ids.as_py() or []
                out.append("".join(back.feed(ids[i : i + GROUP]) for i in range(0, len(ids), GROUP)) + back.feed([], True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, text])

    from pyspark.sql import types as T

    return in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField(text, T.StringType())]))
