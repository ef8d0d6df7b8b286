"""A quality classifier on graded ratings: cumulative-link regression with shared hashed-text weights and ordered thresholds.

P(grade <= k) = sigmoid(threshold_k - w.x) with increasing thresholds, for any number of grades. x holds square roots of the shares of
hashed words and word shapes, and a few bands of whole-text measures. The expected grade and the probability of a grade above the cut
come from the same model.

The weights are fitted on the driver by stochastic gradients over the hashed features of about `sample_rows` labelled rows (a documented
parameter, chosen by a hash of the id, all of the labels where these are fewer); every document is scored.

Defined results: null and empty texts have the features of no words; any length; repeated rows are scored row by row; with fewer than two
grades among the labels every document gets that grade (0 without labels) and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import Memo, ddl, strings, whole
from fieldscope.llm.toxicity import labelled_sample, with_sample

BUCKETS, SAMPLE_ROWS = 1 << 15, 8_000
RUN = re.compile(r"(.)\1+", re.S)


def word_codes(word: str) -> int:
    """The buckets of a word and of its shape, in one number."""
    shape = RUN.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "o" if c.isalpha() else "0" if c.isdigit() else c for c in word))
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (BUCKETS // 2) << 16 | BUCKETS // 2 + zlib.crc32(b"shape " + shape.encode("utf-8", "surrogatepass")) % (BUCKETS // 4)


def features(text: str, codes: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    measures = {"length": n.bit_length(), "distinct": round(10 * len(set(words)) / n) if n else -1, "lines": round(10 * len(set(lines)) / len(lines)) if lines else -1}
    bands = [3 * BUCKETS // 4 + zlib.crc32(f"{k} {v}".encode()) % (BUCKETS // 4) for k, v in measures.items()]
    at, counts = np.unique(np.concatenate([code >> 16, code & 0xFFFF]), return_counts=True)
    return np.concatenate([at, bands]).astype(np.int32), np.concatenate([np.sqrt(counts / max(1, n)), np.full(len(bands), 0.3)]).astype(np.float32)


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def above(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each grade k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[at] @ value), -30, 30)))

    def expected(self, above: np.ndarray) -> float:
        return float(self.grades[0] + (np.diff(self.grades) * above).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, epochs: int = 12, rate: float = 0.5, ridge: float = 1e-6, seed: int = 0) -> Model:
    """Maximum likelihood by AdaGrad; thresholds are the first one and positive increments, so that they stay ordered."""
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS), np.zeros(0))
    k = np.searchsorted(grades, grade)
    share = np.array([(k <= i).mean() for i in range(len(grades) - 1)])
    t = np.log(share / (1 - share))
    first, steps = t[0], np.log(np.maximum(np.diff(t), 1e-3))
    weights, g2, h2, rng = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), np.full(len(t), 1.0), np.random.default_rng(seed)
    sizes = np.array([len(a) for a, _ in rows])
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            at, value, row = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch]), np.repeat(np.arange(len(batch)), sizes[batch])
            eta = np.bincount(row, weights[at] * value, len(batch))
            t = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            padded = np.concatenate([[-np.inf], t, [np.inf]])
            up, low = (1 / (1 + np.exp(-np.clip(padded[k[batch] + d] - eta, -40, 40))) for d in (1, 0))
            up, low = np.where(k[batch] == len(t), 1.0, up), np.where(k[batch] == 0, 0.0, low)
            p, du, dl = np.maximum(up - low, 1e-12), up * (1 - up), low * (1 - low)
            d_eta = (du - dl) / p  # of the negative log-likelihood
            g = np.bincount(at, d_eta[row] * value, BUCKETS) / len(batch) + ridge * weights
            g2 += g * g
            weights -= rate * g / np.sqrt(g2)
            d_t = np.array([(-(du / p)[k[batch] == i].sum() + (dl / p)[k[batch] == i + 1].sum()) / len(batch) for i in range(len(t))])
            d = np.concatenate([[d_t.sum()], [d_t[i + 1 :].sum() * np.exp(steps[i]) for i in range(len(steps))]])
            h2 += d * d
            move = rate * d / np.sqrt(h2)
            first, steps = first - move[0], steps - move[1:]
    return Model(grades, weights, first + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    def hashed(batches):
        codes = Memo(word_codes, 100_000)
        for b in batches:
            rows = [features(t, codes) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (0, 1))], ["label", "at", "value"])

    rows = with_sample(docs, labelled_sample(labels, grade_col, sample_rows, id_col), text_col, id_col)
    t = rows.mapInArrow(hashed, "label int, at binary, value binary").toArrow()  # numbers of the bounded sample
    found = sorted(zip(t["at"].to_pylist(), t["value"].to_pylist(), t["label"].to_pylist(), strict=True))  # one order on every run
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v, _ in found], np.array([k for _, _, k in found], int))


def score_documents(docs: DataFrame, model: Model, cut: int | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade above `cut`, the lowest grade unless given), kept; no shuffle."""
    at_cut = model.grades.index(cut) if cut is not None else 0

    def run(batches):
        codes = Memo(word_codes, 100_000)
        for b in batches:
            above = [model.above(*features(t, codes)) for t in strings(b.column("text"))]
            tail = [float(a[at_cut]) if len(a) else 1.0 for a in above]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.expected(a) for a in above], pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(docs, id_col)}, expected_grade double, tail_probability double").withColumn("kept", F.col("tail_probability") >= least)


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns; no shuffle."""

    def run(batches):
        codes = Memo(word_codes, 100_000)
        for b in batches:
            above = [model.above(*features(t or "", codes)) for t in strings(b.column(text_col))]
            yield b.filter(pa.array([not len(a) or float(a[0]) >= least for a in above], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
