"""The near-copy search: links joined in one task and in rounds, and bounds that exclude no alike pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldscope.llm import simhash


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in list(up) if find(x) != x}


def test_few_links_are_joined_as_many_are(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (200, 260)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    local = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    texts = edges.select(F.format_string("n%04d", "a").cast("binary").alias("a"), F.format_string("n%04d", "b").cast("binary").alias("b"))
    named = {bytes(r["node"]).decode(): bytes(r["component"]).decode() for r in simhash.components(texts).collect()}
    monkeypatch.setattr(simhash, "LOCAL_LINKS", 20)  # some rounds, then one task
    some = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    monkeypatch.setattr(simhash, "LOCAL_LINKS", 0)
    rounds = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    want = roots(pairs)
    assert local == some == want and named == {f"n{k:04d}": f"n{v:04d}" for k, v in want.items()}
    assert {k: v for k, v in rounds.items() if k != v} == want
    assert simhash.components(edges.where("false")).collect() == []


def test_folded_parities_exclude_no_alike_pair(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], []
    for i in range(400):
        n = int(rng.integers(5, 900))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        share = rng.uniform(0.5, 1.0)
        own = x[rng.random(len(x)) < share]
        y = np.unique(np.concatenate([own, rng.integers(0, 2**63, max(0, int(len(x) * (1 - share))), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        words = [np.packbits(np.bincount((h % np.uint64(simhash.CELLS)).astype(int), minlength=simhash.CELLS).astype(np.uint8) & 1).view(np.int64).tolist() for h in (x, y)]
        rows.append((i, len(x), len(y), *words))
        wanted.append(both >= 0.8 * (len(x) + len(y) - both))
    df = spark.createDataFrame(rows, "i int, x_size long, y_size long, x array<long>, y array<long>")
    sides = [c.alias(f"{s}_fold_{j}") for s in "xy" for j, c in enumerate(simhash.folded(s))]
    kept = {r["i"]: r["kept"] for r in df.select("i", "x_size", "y_size", *sides).select("i", F.expr(simhash.folds_allow(0.8)).alias("kept")).collect()}
    assert all(kept[i] for i, alike in enumerate(wanted) if alike) and sum(wanted) > 50
    assert sum(not k for k in kept.values()) > 0.4 * (len(wanted) - sum(wanted))
