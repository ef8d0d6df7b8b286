"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0), which says nothing. A latent-class model gives each rule an accuracy of its own among
good and among bad documents (so a rule may err on one side only). Expectation-maximisation with Beta priors estimates these accuracies and
the share of good documents, and the posterior probability of good decides, in place of demanding that all rules pass: a bad vote of a rule
that often errs on good documents is outvoted by the others. No label is read. Documents of one vote pattern are alike to the model, so only
the pattern's count, one of at most 3**RULES, comes to the driver; the posterior is then a sum of looked-up log-odds, by DataFrame functions.

Defined results: null text has no words; texts without words fail the base rules; any length; ties and repeated rows are judged row by
row, and a posterior of exactly 0.5 keeps; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, durable, strings, whole

#: The symbols that are counted, and the white space that parts words.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\v\f\r"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    upper: int
    lines: int
    ends: int
    doubled: int
    letters: int
    plain: int

    whole = 1  # what counts of a text as such are divided by


def repeats(words: list[bytes], window: int = 3) -> tuple[int, int]:
    """Words in windows that are found twice or more (the first one included), and words equal to the word before."""
    if len(words) < 2:
        return 0, 0
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    doubled = int((w[1:] == w[:-1]).sum())
    n = len(w) - window + 1
    if n < 1 or len(numbers) == len(w):
        return 0, doubled
    key = w[:n]
    for i in range(1, window):
        if i > 1:  # numbered anew at each step, so that keys stay small
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(numbers) + w[i : n + i]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice, cover = (times >= 2)[back], np.zeros(len(w), bool)
    for i in range(window):
        cover[i : n + i] |= twice
    return int(cover.sum()), doubled


def measure(text: str) -> Measures:
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, WHITE))
    repeated, doubled = repeats(words)
    plain = sum(w.rstrip(".,;:!?").isalpha() for w in text.split())
    ends, letters = sum(map(text.count, ".!?")), sum(map(str.isalpha, text))
    return Measures(len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated, sum(map(str.isupper, text)), lines, ends, doubled, letters, plain)


class Rule(NamedTuple):
    """Good within [low, high] of a ratio, bad outside [worst_low, worst_high], between them no vote."""

    name: str
    over: str
    under: str
    low: float
    high: float
    worst_low: float
    worst_high: float

    def vote(self, m: Measures) -> int:
        ratio = getattr(m, self.over) / max(1, getattr(m, self.under))
        return 1 if self.low <= ratio <= self.high else 0 if self.worst_low <= ratio <= self.worst_high else -1


RULES = (
    Rule("symbols a word", "n_symbols", "n_words", 0, 0.02, 0, 0.1),
    Rule("letters", "letters", "word_chars", 0.9, 1, 0.8, 1),
    Rule("plain words", "plain", "n_words", 0.85, 1, 0.6, 1),
    Rule("capitals", "upper", "word_chars", 0.002, 0.12, 0, 0.3),
    Rule("repeated windows", "n_repeat_words", "n_words", 0, 0.15, 0, 0.4),
    Rule("doubled words", "doubled", "n_words", 0, 0.04, 0, 0.15),
    Rule("sentence ends a word", "ends", "n_words", 0.02, 0.4, 0.004, 0.8),
    Rule("repeated lines", "n_dup_lines", "lines", 0, 0.2, 0, 0.5),
    # Weak on purpose: good texts break these too, so that a bad vote of theirs alone must not decide.
    Rule("words", "n_words", "whole", 150, 1e9, 80, 1e9),
    Rule("word length", "word_chars", "n_words", 4.4, 5.8, 3.9, 7),
    Rule("words a line", "n_words", "lines", 15, 90, 6, 180),
)


class Estimate(NamedTuple):
    """Share of good documents; accuracy[c, j]: probability that a vote of rule j is right for a document of class c (0 bad, 1 good)."""

    good: float
    accuracy: np.ndarray


def weights(e: Estimate) -> tuple[float, np.ndarray]:
    """The log-odds of good before any vote, and what a vote of bad, none, or good of each rule adds."""
    bad, good = np.clip(e.accuracy, 1e-12, 1 - 1e-12)  # for the logarithms alone
    adds = np.stack([np.log1p(-good) - np.log(bad), np.zeros(len(good)), np.log(good) - np.log1p(-bad)], axis=1)
    return float(np.log(e.good / (1 - e.good))), adds


def posterior(patterns: np.ndarray, e: Estimate) -> np.ndarray:
    base, adds = weights(e)
    return 1 / (1 + np.exp(-np.clip(base + adds[np.arange(patterns.shape[1]), patterns + 1].sum(axis=1), -700, 700)))


#: Pseudo-counts: before any document, four votes of five of a rule are right, and of four documents two are good.
RIGHT, WRONG, CLASS = 4.0, 1.0, 2.0


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, settled: float = 1e-9) -> Estimate:
    """Maximum a posteriori by EM; patterns: a row of votes each. It starts from the share of good among the votes cast."""
    cast = np.maximum(1, (patterns != 0).sum(axis=1))
    p, before = 0.5 + 0.45 * patterns.sum(axis=1) / cast, None
    for _ in range(rounds):
        n = np.stack([counts * (1 - p), counts * p])
        right = np.stack([n[0] @ (patterns == -1), n[1] @ (patterns == 1)])
        share = n.sum(axis=1) + CLASS
        e = Estimate(float(share[1] / share.sum()), (right + RIGHT) / (n @ (patterns != 0) + RIGHT + WRONG))
        p = posterior(patterns, e)
        if before is not None and np.abs(p - before).max(initial=0) < settled:
            break
        before = p
    return e


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Votes of pattern numbers, a column a rule."""
    return np.stack([codes // 3**i % 3 - 1 for i in range(len(RULES))], axis=1)


def vote_patterns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts and the pattern's number of every row; no shuffle."""

    def run(batches):
        for b in batches:
            found = [measure(t) for t in strings(b.column("text"))]
            code = [sum((r.vote(m) + 1) * 3**i for i, r in enumerate(RULES)) for m in found]
            counts = [pa.array([m[i] for m in found], pa.int64()) for i in range(len(COLUMNS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(code, pa.int32())], ["doc_id", *COLUMNS, "pattern"])

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(df, id_col)}, {', '.join(f'{c} long' for c in COLUMNS)}, pattern int")


def probability(e: Estimate, pattern: str = "pattern") -> Column:
    """The posterior of good of a pattern's number."""
    base, adds = weights(e)
    odds = F.lit(base)
    for i, own in enumerate(adds.tolist()):
        digit = F.pmod(F.floor(F.col(pattern) / F.lit(3**i)), F.lit(3)).cast("int")
        odds = odds + F.element_at(F.array(*map(F.lit, own)), digit + 1)
    return 1 / (1 + F.exp(-odds))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, quality (posterior probability) of every row; no shuffle but of pattern counts."""
    measured = durable(vote_patterns(df, id_col, text_col))
    seen = measured.groupBy("pattern").count().collect()  # at most 3**RULES rows
    codes, counts = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    p = probability(estimate(unpacked(codes), counts.astype(float)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"), p.alias("quality"))
