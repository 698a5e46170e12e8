"""Weak supervision of text quality: rules vote or abstain, EM estimates how far to trust them.

Every rule looks at one property of a whole text and votes good (1), bad (-1)
or abstains (0). The votes of all documents are counted by pattern; there are
at most 3 ** rules patterns however large the corpus is, and only these counts
reach the driver. Expectation-maximisation on them estimates the share of good
documents and, for each rule, how often it is right on good and on bad ones.
A document is kept when its posterior probability of being good reaches one
half (and the base rule does not fail it).

The hidden class is tied to the meaning of the votes by start and prior: a rule
is taken to be right on nearly all good documents, and to notice less than half
of the bad ones (each kind of bad text shows in a few rules only). The prior
weighs as much as the share ``PRIOR`` of all documents.

Rows: a null text has no words and fails the base rule; an empty table gives
no rows; repeated rows vote each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, stored

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
RULES = ("length", "word_length", "symbols", "dup_lines", "repeat_words", "letters", "line_ends", "capitals", "plain_words")
ROUNDS = 200
PRIOR = 0.002
SHARE, RIGHT_ON_BAD, RIGHT_ON_GOOD = 0.85, 0.4, 0.97  # where EM starts, and its prior


def _vote(x: float, good: bool, bad: bool) -> int:
    return -1 if bad else 1 if good else 0


def measures(text: str) -> tuple[int, int, int, int, int, tuple[int, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        twice = {w for w, c in Counter(windows).items() if c > 1} if len(set(windows)) < len(windows) else ()
        if twice:
            covered = 0  # the word up to which is counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(i, covered)
                    covered = i + 3
    letters = sum(w.isalpha() or any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in words) if n else 0
    plain = sum(w.strip(".,;:!?\"'()-").isalnum() for w in text.split())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    ends = sum(x.rstrip(WHITE)[-1:] in ".!?:;\"'»”)…" for x in lines)
    per = max(1, n)
    mean = word_chars / per
    votes = (
        _vote(n, n >= 100, n < 50),
        _vote(mean, 3 <= mean <= 12, mean < 2.2 or mean > 20),
        _vote(symbols, symbols <= 0.02 * n, symbols > 0.1 * n),
        _vote(dup, len(lines) > 1 and dup == 0, dup > 0.3 * len(lines)),
        _vote(repeat, repeat <= 0.1 * n, repeat > 0.3 * n),
        _vote(letters, letters >= 0.9 * n, letters < 0.7 * n),
        _vote(ends, ends >= 0.7 * len(lines), ends < 0.3 * len(lines)) if len(lines) > 1 else 0,
        _vote(upper, upper <= 0.1 * word_chars, upper > 0.4 * word_chars),
        _vote(plain, plain >= 0.9 * n, plain < 0.6 * n),
    )
    return n, word_chars, symbols, dup, repeat, votes if n else (-1, *[0] * (len(RULES) - 1))


class Estimate:
    """Share of good documents; per rule the chance of a right vote on good and on bad ones."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        rules = patterns.shape[1] if patterns.size else len(RULES)
        self.share = SHARE
        start = np.array([[RIGHT_ON_BAD], [RIGHT_ON_GOOD]])
        self.right = np.repeat(start, rules, axis=1)  # on bad, on good
        total = counts.sum()
        if not total:
            return
        weight = PRIOR * total + 1
        up, down = patterns == 1, patterns == -1
        for _ in range(rounds):
            p = self.posterior(patterns) * counts
            q = counts - p
            self.share = (p.sum() + SHARE * weight) / (total + weight)
            before = self.right.copy()
            for k, (mine, hit) in enumerate(((q, down), (p, up))):
                cast = (mine[:, None] * (up | down)).sum(0)
                self.right[k] = ((mine[:, None] * hit).sum(0) + start[k] * weight) / (cast + weight)
            if np.abs(before - self.right).max() < 1e-9:
                break

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of good: prior, and of each rule's good and bad vote."""
        bad, good = self.right
        return float(np.log(self.share / (1 - self.share))), np.log(good / (1 - bad)), np.log((1 - good) / bad)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        prior, up, down = self.weights()
        return 1 / (1 + np.exp(-(prior + (patterns == 1) @ up + (patterns == -1) @ down)))


def measured(documents: DataFrame) -> DataFrame:
    """Per document its counts and votes."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = [measures(t or "") for t in b.column("text").to_pylist()]
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            votes = [pa.array([r[5][i] for r in rows], pa.int8()) for i in range(len(RULES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, *votes], names=["doc_id", *columns, *RULES])

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in columns) + ", " + ", ".join(f"{r} byte" for r in RULES)
    return in_arrow(documents.select("doc_id", "text"), run, schema)


def estimate(votes: DataFrame) -> Estimate:
    """EM over the counts of the vote patterns (at most 3 ** rules rows)."""
    rows = votes.groupBy(*RULES).count().collect()
    rows = sorted(tuple(r) for r in rows)
    return Estimate(np.array([r[:-1] for r in rows]).reshape(len(rows), len(RULES)), np.array([r[-1] for r in rows], float))


def judged(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, probability."""
    rows = stored(measured(documents), "votes")
    prior, up, down = estimate(rows).weights()
    odds = F.lit(prior)
    for rule, u, d in zip(RULES, up.tolist(), down.tolist()):
        odds = odds + F.when(F.col(rule) == 1, u).when(F.col(rule) == -1, d).otherwise(0.0)
    probability = 1 / (1 + F.exp(-odds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (odds >= 0)).alias("kept"),
        probability.alias("probability"),
    )
