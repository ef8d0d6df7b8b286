"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, all but letters become one space, and each run of 1 to 4 characters, spaces included, is hashed into one of a fixed
number of buckets. Per language the counts of the buckets, smoothed, give a matrix of log-probabilities, which is broadcast; a batch of texts
is scored by sparse look-ups in it, summed by text. The prior is the share of a language among all rows that may be learned from.

The counts come from about `per_language` texts a language (a documented parameter; all where there are fewer), chosen by a 64-bit hash of the
id; the prior is counted over all rows and every document is scored. The matrix holds at most MOST_CELLS numbers: with many languages the
buckets are fewer, so no language is left out and the broadcast stays bounded.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text where nothing can be learned; any length,
the whole text counts; repeated rows are scored row by row; of equally likely languages the first in order wins; a null id is hashed as the
empty text; an empty table gives no rows; columns other than id, text and (for learning) language are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, strings, whole

LONGEST, BUCKETS, MOST_CELLS, PER_LANGUAGE, ALPHA, FOLDS, HELD = 4, 1 << 16, 1 << 24, 5_000, 0.5, 4, 2
UNKNOWN = "und"
REST = re.compile(r"[\W\d_]+")
#: Fixed values of a multiplicative hash.
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Characters and cells (characters times languages) that are looked up at once.
PIECE, CELLS = 1 << 18, 1 << 20


def fold(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def letters(text: str) -> str | None:
    """The text as runs of letters between spaces, at least LONGEST characters; None if it has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    return f" {REST.sub(' ', text.lower())} ".ljust(LONGEST)


def grams(codes: np.ndarray, buckets: int):
    """For each length the buckets of the runs of that length, by their first place."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(1)) * STEP
        x = (h ^ (h >> np.uint32(15))) * MIX
        yield n, (x >> np.uint32(8)) & np.uint32(buckets - 1)


def pieces(texts: list[str | None], most: int):
    """(codes, owner of each character, characters left in its text) of the texts, in pieces that overlap by less than a run's length.

    A run counts in the piece that it begins in.
    """
    known = [i for i, t in enumerate(texts) if t is not None]
    if not known:
        return
    sizes = np.array([len(texts[i]) for i in known])
    codes = np.frombuffer("".join(texts[i] for i in known).encode("utf-32-le", "surrogatepass"), "<u4")
    ends, owner = np.cumsum(sizes), np.array(known)
    for at in range(0, len(codes), most):
        upto = min(len(codes), at + most)
        place = np.searchsorted(ends, np.arange(at, upto), "right")
        yield codes[at : upto + LONGEST - 1], owner[place], ends[place] - np.arange(at, upto)


class Model(NamedTuple):
    """Languages in order; matrix[bucket, language] of log-probabilities; log-prior of each language."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray


def bucket_count(languages: int) -> int:
    n = BUCKETS
    while n > 16 and n * languages > MOST_CELLS:
        n //= 2
    return n


def score(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The most likely language's index and its posterior probability, of prepared texts (see letters)."""
    width = len(model.languages)
    total = np.tile(model.prior, (len(texts), 1))
    for codes, owner, left in pieces(texts, max(1024, min(PIECE, CELLS // width))):
        for n, bucket in grams(codes, len(model.matrix)):
            m = min(len(bucket), len(left))
            inside = left[:m] >= n
            own = owner[:m][inside]
            if not len(own):
                continue
            begin = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            total[own[begin]] += np.add.reduceat(model.matrix[bucket[:m][inside]], begin, axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    odds = np.exp(total - total[np.arange(len(texts)), best][:, None])
    return best, 1 / odds.sum(axis=1)


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, holdout: bool) -> DataFrame:
    """id, text, lang of the rows that may be learned from."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.where(fold(id_col) != HELD) if holdout else rows
    return rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, holdout: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts by language and bucket; the driver gets one row of sums a language, of at most MOST_CELLS numbers in all."""
    rows = learnable(docs, id_col, text_col, lang_col, holdout)
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(known)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    buckets = bucket_count(len(names))
    number = {x: i for i, x in enumerate(names)}
    # A language's share of rows as the highest hash that is taken.
    edge = {x: min(2**63 - 1, int(min(1.0, per_language / n) * 2**64) - 2**63) for x, n in known.items()}
    edges = docs.sparkSession.createDataFrame([(x, number[x], e) for x, e in edge.items()], "lang string, number int, edge long")
    sample = rows.join(F.broadcast(edges), "lang").where(F.xxhash64("id") <= F.col("edge")).select("number", "text")

    def counted(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for language, text in zip(b.column("number").to_pylist(), strings(b.column("text")), strict=True):
                if (t := letters(text)) is None:
                    continue
                own = held.setdefault(language, np.zeros(buckets, np.int64))
                for codes, _, left in pieces([t], PIECE):
                    for n, bucket in grams(codes, buckets):
                        m = min(len(bucket), len(left))
                        own += np.bincount(bucket[:m][left[:m] >= n], minlength=buckets)
            if len(held) * buckets > MOST_CELLS // 4:
                yield from sums(held)
                held = {}
        yield from sums(held)

    def sums(held):
        for language, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), language, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["number", "bucket", "n"])

    found = sample.mapInArrow(counted, "number int, bucket int, n long").groupBy("number", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets, len(names)))
    counts[found["bucket"].to_numpy(), found["number"].to_numpy()] = found["n"].to_numpy()
    matrix = np.log(counts + ALPHA) - np.log(counts.sum(axis=0) + ALPHA * buckets)
    n = np.array([known[x] for x in names], float)
    return Model(names, matrix.astype(np.float32), np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability) of every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [letters(t) if m.languages else None for t in part.column("text").to_pylist()]
                if m.languages:
                    best, p = score(m, texts)
                    out = [(m.languages[i], float(x)) if t is not None else (UNKNOWN, 0.0) for i, x, t in zip(best.tolist(), p.tolist(), texts, strict=True)]
                else:
                    out = [(UNKNOWN, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD).alias("held_out"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(docs, id_col)}, held_out boolean, lang_pred string, score double")
