"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into slices. A list holds, for one slice and one block of candidates, the components from which the partial scores of
that slice come; lists are rows of their own and lie with any task. A candidate's score is the sum of its partial scores over all slices.

Phase 1 gathers, slice by slice, the heads of the lists: the k + 1 candidates with the best partial scores of each query. Their missing slices
are resolved, and the k-th best whole score of a query is a safe cutoff t: no member of its result falls below it. Phase 2 sends the cutoffs to
all lists. An entry of the result has a partial score of t / slices or more in some list, and its partial score with the greatest that the
other slices can add (a product of norms) reaches t; only such entries are collected, and a list whose norms cannot reach t / slices for any
query is skipped whole. A list with more than DENSE such entries of a query returns the fact alone, not the entries. Phase 3 resolves the
missing slices of the collected entries in their blocks, and a query's dense blocks as a whole; each block returns k rows a query at most.

Equal vectors are one candidate with its k + 1 smallest ids, so a very common vector is scored once. Queries come in rounds of about ROUND
(a documented bound: their components and cutoffs are broadcast); candidates are neither broadcast nor replicated.

Defined results: vectors that are null or hold null or non-finite components take no part; fewer than k candidates give all; vectors of
other lengths count as filled up with zeros; ties go to the smaller id; a row is no candidate for queries with its own id; rows that repeat an
id are candidates each; queries of equal id and vector are one, those of equal id and other vectors each give a result under that id; empty
tables give no rows; other columns are not read; scores beyond 64 bits are not defined.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import durable

SLICES, BLOCK, BLOCK_CELLS, ROUND, AT_ONCE, DENSE = 2, 2048, 1 << 20, 16_384, 1024, 64
LISTS = "block long, slice int, n int, components binary, norms binary, ids binary"
ENTRIES = "query int, block long, row int, slice int, partial double"
FOUND = "query int, query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, components floor(scale * x) as doubles; only vectors of finite components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """v, own: the k + 1 smallest ids of each distinct vector, each with the number of its rows (k at most). Limited before the shuffle."""
    times = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    first = times.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.collect_list(F.struct("id", "times")).alias("own"))


def edges(width: int) -> list[int]:
    return np.linspace(0, width, SLICES + 1).astype(int).tolist()


def cut_lists(distinct: DataFrame, width: int) -> DataFrame:
    """The lists of up to BLOCK candidates each, one for each slice. ids: (row, id, times) of a block."""
    at = edges(width)

    def run(batches):
        vectors, own, most = [], [], 0

        def lists():
            m = np.zeros((len(vectors), most))
            for row, v in zip(m, vectors, strict=True):
                row[: len(v)] = v
            parts = [m[:, i:j] for i, j in zip(at, at[1:], strict=False)]
            norms = np.stack([np.sqrt((p * p).sum(axis=1)) for p in parts], axis=1)
            ids = np.array([(r, i, n) for r, o in enumerate(own) for i, n in o], "<i8")
            rows = [(j, len(m), p.tobytes(), norms.tobytes(), ids.tobytes()) for j, p in enumerate(parts)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["slice", "n", "components", "norms", "ids"])

        for b in batches:
            for v, o in zip(b.column("v"), b.column("own").to_pylist(), strict=True):
                v = v.values.to_numpy()
                if vectors and (len(vectors) == BLOCK or (len(vectors) + 1) * max(most, len(v)) > BLOCK_CELLS):
                    yield lists()
                    vectors, own, most = [], [], 0
                vectors.append(v)
                own.append([(x["id"], x["times"]) for x in o])
                most = max(most, len(v))
        if vectors:
            yield lists()

    rows = distinct.mapInArrow(run, LISTS.split(", ", 1)[1]).withColumn("__n", F.monotonically_increasing_id())
    # The rows of a block follow each other within their partition, whose number stands in the upper bits.
    block = F.expr(f"((__n >> 33) << 33) + ((__n & {(1 << 33) - 1}L) div {SLICES})")
    return durable(rows.select(block.alias("block"), "slice", "n", "components", "norms", "ids"))


class Round(NamedTuple):
    """Queries of a round: ids, components by slice, norms by slice, cutoffs."""

    ids: np.ndarray
    parts: list[np.ndarray]
    norms: np.ndarray
    cutoffs: np.ndarray


def round_of(rows: pa.Table, width: int) -> Round:
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    m = np.zeros((len(order), width))
    for to, v in zip(m, (rows["v"][int(i)].values.to_numpy() for i in order), strict=True):
        to[: len(v)] = v
    at = edges(width)
    parts = [np.ascontiguousarray(m[:, i:j]) for i, j in zip(at, at[1:], strict=False)]
    return Round(rows["id"].to_numpy()[order], parts, np.stack([np.sqrt((p * p).sum(axis=1)) for p in parts], axis=1), np.full(len(order), -np.inf))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Partial scores of queries with candidates, exact: as 64-bit integers where sums of doubles might not be."""
    n = min(q.shape[1], c.shape[1])
    q, c = q[:, :n], c[:, :n]
    if n * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) >= 2.0**53:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return q @ c.T


def pairwise(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Partial scores of each query with the candidate beside it, exact."""
    n = min(q.shape[1], c.shape[1])
    q, c = q[:, :n], c[:, :n]
    if n * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) >= 2.0**53:
        q, c = q.astype(np.int64), c.astype(np.int64)
    return np.einsum("ij,ij->i", q, c)


def _list(components: bytes, n: int) -> np.ndarray:
    return np.frombuffer(components).reshape(n, -1)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _entries(query, block, row, part: int, partial) -> pa.RecordBatch:
    n = len(query)
    columns = [pa.array(query, pa.int32()), pa.array(np.broadcast_to(block, n), pa.int64()), pa.array(row, pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(np.asarray(partial, float))]
    return pa.RecordBatch.from_arrays(columns, ["query", "block", "row", "slice", "partial"])


def gather(lists: DataFrame, sent, k: int) -> DataFrame:
    """Phase 1: the k + 1 best entries of each query and slice, over the lists of a task and then over all."""

    def run(batches):
        queries: Round = sent.value
        n = len(queries.ids)
        best = [[np.full((n, k + 1), -np.inf), np.zeros((n, k + 1), np.int64), np.zeros((n, k + 1), np.int64)] for _ in range(SLICES)]
        for r in _rows(batches):
            c, held = _list(r["components"], r["n"]), best[r["slice"]]
            for at in range(0, n, AT_ONCE):
                q = slice(at, at + AT_ONCE)
                partial = product(queries.parts[r["slice"]][q], c).astype(float)
                if r["n"] > k + 1:
                    top = np.argpartition(partial, r["n"] - k - 1, axis=1)[:, -k - 1 :]
                else:
                    top = np.broadcast_to(np.arange(r["n"]), partial.shape)
                both = [np.concatenate([held[0][q], np.take_along_axis(partial, top, axis=1)], axis=1)]
                both += [np.concatenate([held[1][q], np.full(top.shape, r["block"])], axis=1), np.concatenate([held[2][q], top], axis=1)]
                first = np.argsort(-both[0], axis=1, kind="stable")[:, : k + 1]
                for to, x in zip(held, both, strict=True):
                    to[q] = np.take_along_axis(x, first, axis=1)
        for part, (partial, block, row) in enumerate(best):
            query, place = np.nonzero(partial > -np.inf)
            yield _entries(query, block[query, place], row[query, place], part, partial[query, place])

    first = Window.partitionBy("query", "slice").orderBy(F.desc("partial"), "block", "row")
    local = lists.select("block", "slice", "n", "components").mapInArrow(run, ENTRIES)
    return local.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")


def collect(lists: DataFrame, sent) -> DataFrame:
    """Phase 2: the entries that can reach the cutoffs; row -1 for a query of whose block too many can."""

    def run(batches):
        queries: Round = sent.value
        t = queries.cutoffs
        slack = 1e-6 + 1e-9 * np.abs(np.where(np.isfinite(t), t, 0))  # for the roots in the norms
        for r in _rows(batches):
            part, norms = r["slice"], np.frombuffer(r["norms"]).reshape(r["n"], SLICES)
            able = np.flatnonzero(queries.norms[:, part] * norms[:, part].max() + slack >= t / SLICES)
            c, others = _list(r["components"], r["n"]), [j for j in range(SLICES) if j != part]
            for at in range(0, len(able), AT_ONCE):
                q = able[at : at + AT_ONCE]
                partial = product(queries.parts[part][q], c)
                most = partial + queries.norms[q][:, others] @ norms[:, others].T
                enough = (partial >= t[q, None] / SLICES) & (most + slack[q, None] >= t[q, None])
                dense = enough.sum(axis=1) > DENSE
                yield _entries(q[dense], r["block"], np.full(int(dense.sum()), -1), part, np.zeros(int(dense.sum())))
                query, row = np.nonzero(enough & ~dense[:, None])
                yield _entries(q[query], r["block"], row, part, partial[query, row])

    return lists.select("block", "slice", "n", "components", "norms").mapInArrow(run, ENTRIES)


def resolve(entries: DataFrame, lists: DataFrame, sent, k: int) -> DataFrame:
    """Phase 3: the k best rows a query and block among the entries that reach the cutoffs, their missing slices resolved."""

    def best(queries: Round, q: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray):
        keep = score >= queries.cutoffs[q]
        q, row, score = q[keep], row[keep], score[keep]
        # To each candidate its ids, but for the query's own, as often as they occur.
        begin = np.searchsorted(ids[:, 0], row)
        each = np.searchsorted(ids[:, 0], row, side="right") - begin
        at = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        q, score = np.repeat(q, each), np.repeat(score, each)
        times = np.where(ids[at, 1] == queries.ids[q], 0, ids[at, 2])
        q, score, vec = np.repeat(q, times), np.repeat(score, times), np.repeat(ids[at, 1], times)
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], vec[first], score[first]

    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        queries, out = sent.value, []
        if len(asked) and len(parts):
            parts = parts.sort_by("slice").to_pylist()
            c = [_list(p["components"], p["n"]) for p in parts]
            ids = np.frombuffer(parts[0]["ids"], "<i8").reshape(-1, 3)
            q, row, part, partial = (asked[x].to_numpy() for x in ("query", "row", "slice", "partial"))
            dense = np.unique(q[row < 0])
            for at in range(0, len(dense), AT_ONCE):
                own = dense[at : at + AT_ONCE]
                score = sum(product(queries.parts[j][own], c[j]).astype(np.int64) for j in range(SLICES))
                enough = np.nonzero(score >= queries.cutoffs[own, None])
                out.append(best(queries, own[enough[0]], enough[1], score[enough], ids))
            few = (row >= 0) & ~np.isin(q, dense)
            pair, back = np.unique(q[few].astype(np.int64) << 32 | row[few], return_inverse=True)
            one, other = pair >> 32, pair & 0xFFFFFFFF
            score = np.zeros(len(pair), np.int64)
            for j in range(SLICES):
                known, mine = np.zeros(len(pair), bool), (part[few] == j) & (np.abs(partial[few]) < 2.0**53)
                value = np.zeros(len(pair), np.int64)
                known[back[mine]], value[back[mine]] = True, partial[few][mine].astype(np.int64)
                missing = np.flatnonzero(~known)
                for at in range(0, len(missing), 20_000):
                    m = missing[at : at + 20_000]
                    value[m] = pairwise(queries.parts[j][one[m]], c[j][other[m]])
                score += value
            out.append(best(queries, one, other, score, ids))
        q, vec, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        columns = [pa.array(q, pa.int32()), pa.array(queries.ids[q], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())]
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), columns, strict=True)))

    held = lists.select("block", "slice", "n", "components", "ids")
    return entries.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, FOUND)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col, scale)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    lists = cut_lists(candidates(rows, k), width)
    queries = rows.where(F.col("id") % every == 0).distinct()
    rounds = max(1, -(-queries.count() // ROUND))
    queries = durable(queries.withColumn("round", F.pmod(F.xxhash64("id", "v"), F.lit(rounds))))
    first, out = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"), None

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    for number in range(rounds):
        own = round_of(queries.where(F.col("round") == number).select("id", "v").toArrow(), width)  # about ROUND rows
        heads = resolve(gather(lists, sent := spark.sparkContext.broadcast(own), k), lists, sent, k)
        for query, cutoff in ranked(heads).where(F.col("rank") == k).select("query", "score").collect():  # one number for each query
            own.cutoffs[query] = cutoff
        sent = spark.sparkContext.broadcast(own)
        found = ranked(resolve(collect(lists, sent), lists, sent, k)).select("query_id", "rank", "vec_id", "score")
        found = durable(found) if rounds > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
