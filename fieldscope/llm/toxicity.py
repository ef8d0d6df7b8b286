"""Toxic passages by maximum-scoring segments.

Words get the log-odds of toxic against clean training texts (a word counts once a text, so that one text alone can't make it
toxic) under a Dirichlet prior; those whose log-odds differ from 0 by
MIN_Z standard deviations keep them, all others only a small negative drift. A linear scan finds every maximal scoring segment of a
text. Under clean word frequencies the expected number of segments of score S in n words is K n exp(-lambda S) (the extreme-value law of
local scores); lambda solves sum p(w) exp(lambda s(w)) = 1 and K is fitted to clean training texts. Segments with an expectation below
MAX_E are significant; their evidence -ln E is summed and a logistic curve fitted on the training rows turns it into a score.

The word statistics and the curve are fitted on a sample of about `sample_rows` labelled rows (a documented parameter, chosen by a hash of
the id, all of the labels where these are fewer); every document is scored.

Defined results: null and empty texts have no segment and get the score of no evidence; any length; repeated rows are scored row by row;
without labelled rows of both kinds no word counts as toxic and the score is the prior 0.05; an empty table gives no rows; label, language and
source columns are not read for scoring.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, durable, sampled, strings, whole

SAMPLE_ROWS, MIN_Z, MAX_E, DRIFT = 20_000, 3.0, 0.01, 0.05
WORDS = re.compile(r"[^\W_]+")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_sample(labels: DataFrame, label_col: str, sample_rows: int, id_col: str = "doc_id", holdout: bool = True) -> DataFrame:
    """id, label of about sample_rows labelled rows outside the held-out fold, chosen by a hash of the id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.where(fold(id_col) != 0) if holdout else rows
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    return sampled(rows, "__id", min(1.0, sample_rows / max(1, rows.count())))


def with_sample(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """text, label of the sampled rows. The sample's size is bounded, so that it is broadcast."""
    return docs.select(F.col(id_col).alias("__id"), whole(text_col).alias("text")).join(F.broadcast(sample), "__id").select("text", F.col("__label").cast("int").alias("label"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal scoring segments, in linear time: a stack of candidates by their cumulative sums."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # begin, end, sum before, sum after, index of the nearest earlier candidate with a smaller sum before
    for at in np.flatnonzero(scores > 0).tolist():
        begin, end, before, after = at, at + 1, float(total[at]), float(total[at + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append([begin, end, before, after, j])
                break
            begin, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


class Model:
    """Word scores, extreme-value parameters, and the logistic curve over the summed evidence."""

    def __init__(self, scores: dict[str, float], lam: float, ln_k: float, curve: tuple[float, ...]):
        self.scores, self.lam, self.ln_k, self.curve = scores, lam, ln_k, curve

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The number of words; begin, end (in words), score and evidence of each significant segment."""
        words = WORDS.findall(text.lower())
        if self.scores.keys().isdisjoint(words):
            return len(words), []
        s = np.fromiter(map(self.scores.get, words, [-DRIFT] * len(words)), float, len(words))
        base, found = self.ln_k + math.log(len(words)), []
        for begin, end, score in segments(s):
            evidence = self.lam * score - base
            if evidence > -math.log(MAX_E):
                found.append((begin, end, score, evidence))
        return len(words), found

    def score(self, found: list) -> float:
        none, some, slope = self.curve
        x = none + (some + slope * math.log1p(sum(f[3] for f in found)) if found else 0.0)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, x))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, holdout: bool = True, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = with_sample(docs, labelled_sample(labels, "toxic", sample_rows, id_col, holdout), text_col, id_col)

    def counted(batches):
        """Counts of a partition, passed on before they grow large."""
        n = [Counter(), Counter()]

        def flush():
            words = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in n)], ["word", "n0", "n1"])
            n[0].clear(), n[1].clear()
            return out

        for b in batches:
            for text, label in zip(strings(b.column("text")), b.column("label").to_pylist(), strict=True):
                n[label == 1].update(set(WORDS.findall(text.lower())))
                if len(n[0]) + len(n[1]) > 400_000:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(counted, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = durable(counts)
    n0, n1 = (float(x or 0) for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        return Model({}, 1.0, 0.0, (math.log(0.05 / 0.95), 0.0, 1.0))
    prior = 0.5 + 100 * (F.col("n0") + F.col("n1")) / (n0 + n1)
    odds = F.log((F.col("n1") + prior) / n1) - F.log((F.col("n0") + prior) / n0)
    z = odds / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    kept = counts.withColumn("odds", odds).where(F.abs(z) >= MIN_Z).select("word", "odds", "n0").collect()  # of the bounded sample
    scores = {r["word"]: max(-2.0, min(8.0, r["odds"])) - DRIFT for r in kept}
    # lambda: the positive root of the clean generating function, by bisection. Words unseen in clean text count half an occurrence.
    p = np.array([(r["n0"] + 0.5) / n0 for r in kept])
    s = np.array([scores[r["word"]] for r in kept])
    rest = max(0.0, 1 - p.sum())
    excess = lambda x: float((p * np.exp(x * s)).sum() + rest * math.exp(-x * DRIFT)) - 1
    low, high = 1e-3, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    lam = low
    kinds = "label int, n long, x double"

    def measured(of):
        """label, number of words and one number of each text with words."""

        def run(batches):
            for b in batches:
                out = []
                for text, label in zip(strings(b.column("text")), b.column("label").to_pylist(), strict=True):
                    if words := WORDS.findall(text.lower()):
                        found = segments(np.fromiter(map(scores.get, words, [-DRIFT] * len(words)), float, len(words)))
                        out.append((label, len(words), of(len(words), [f[2] for f in found])))
                columns = zip(*out, strict=True) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64()), strict=True)], ["label", "n", "x"])

        return rows.mapInArrow(run, kinds).toPandas()  # three numbers for each row of the bounded sample

    seen = measured(lambda n, each: float(max(each, default=0.0)))
    clean = seen[(seen["label"] != 1) & (seen["x"] > 0)]
    # The maximum of lambda S - ln(K n) has Euler's constant as its mean.
    ln_k = min(0.0, max(-8.0, float((lam * clean["x"] - np.log(clean["n"])).mean() - 0.5772))) if len(clean) >= 20 else -2.0

    def evidence(n: int, each) -> float:
        e = lam * np.asarray(each, float) - ln_k - math.log(n)
        return math.log1p(float(e[e > -math.log(MAX_E)].sum()))

    seen = measured(evidence)
    return Model(scores, lam, ln_k, logistic(seen["x"].to_numpy(), (seen["label"] == 1).to_numpy(float)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Intercept, step where there is evidence, and slope, by Newton's method with a small ridge on the latter two."""
    m, w, pull = np.stack([np.ones_like(x), x > 0, x], axis=1), np.zeros(3), np.array([1e-6, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag(pull)
        w = w + np.clip(np.linalg.solve(h, m.T @ (y - p) - pull * w), -2, 2)
    return tuple(map(float, w))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_words and the significant passages (in words) of every row; no shuffle."""

    def run(batches):
        for b in batches:
            scored = [model.passages(t) for t in strings(b.column("text"))]
            spans = [[{"begin": f[0], "end": f[1], "score": f[2], "evidence": f[3]} for f in found] for _, found in scored]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(f) for _, f in scored]), pa.array([n for n, _ in scored], pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_words", "passages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {ddl(docs, id_col)}, score double, n_words long, passages array<struct<begin:long,end:long,score:double,evidence:double>>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "passages")


def keep(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below `most`, with all their columns; no shuffle."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(model.passages(t or "")[1]) < most for t in strings(b.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
