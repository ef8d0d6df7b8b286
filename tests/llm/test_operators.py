import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldscope.llm import bpe_codec, hilbert, line_dedup, packing, quality, simhash, token_counts, topk, toxicity, weak_rules
from fieldscope.llm.common import vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ İ é", "ab\x1cc\x85d\xa0e", "½²①٣", "日本語テスト", "it's I'LL 'S", "x" * 3000, "a  b \n c\n d ", "#$%&* 123", "same text", "same text", "😀 é࢏", "word " * 20000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    more = [" ".join(rng.choice(["the", "Cat", "sat.", "on\n", "mats,", "über", "run"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = [(i, t, "en", "s" if i % 3 else None, None if t is None else len(t), "clash", "clash") for i, t in enumerate(ODD + more)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_token_counts_and_codec_equal_the_library(docs):
    lib, t = Tokenizer.from_file(WORD), texts(docs)
    want = {i: lib.encode(x, add_special_tokens=False).ids for i, x in t.items()}
    for r in token_counts.count_tokens(docs, WORD).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(want[r["doc_id"]]), len(t[r["doc_id"]].encode()), len(want[r["doc_id"]]) > 2048)
    for r in bpe_codec.encode_digests(docs, WORD).collect():
        ids = want[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunk_maps_compose():
    """Whatever the chunks, and in whatever order neighbours are composed, the maps give the count of the text read from end to end."""
    c, lib, rng = token_counts.counter(WORD), Tokenizer.from_file(WORD), random.Random(11)
    signs = ["a", "s", "t", "'", "r", "e", "l", " ", "1", "½", ".", "é", "Σ", "日", "the", "ing", "<|endoftext|>", "\x1c"]
    texts = [*filter(None, ODD[:-1]), *("".join(rng.choice(signs) for _ in range(30)) for _ in range(300))]
    for t in texts:
        want = len(lib.encode(t, add_special_tokens=False).ids)
        for size in (1, 3, 8):
            assert c.count_chunks([(p, c.chunk_map(x, before) if x else None) for p, before, x in c.chunks(t, size)]) == want == c.count(t)
    a, b, d = (c.chunk_map(x) for x in ("it'", "re th", "e en'"))
    left, right = c.compose(c.compose(a, b), d), c.compose(a, c.compose(b, d))
    for entry in (token_counts.START, c.read(token_counts.START, "sun's")[0], c.read(token_counts.START, "!")[0]):
        assert c.at(left, entry) == c.at(right, entry) == c.read(entry, "it're the en'")


def test_long_texts_are_counted_in_chunks(docs):
    got = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, WORD, long_bytes=40, chunk=33).collect()}
    assert got == {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, WORD).collect()}
    assert token_counts.count_tokens(docs, WORD, long_bytes=40, chunk=33).count() == docs.count()


def test_packing_loses_and_repeats_nothing(docs):
    lib, t = Tokenizer.from_file(BYTE), texts(docs)
    rows = packing.pack(docs, BYTE, with_ids=True).collect()
    found, sequences = Counter(), {}
    for r in rows:
        ids = [*lib.encode(t[r["doc_id"]], add_special_tokens=False).ids, 1]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert piece == r["ids"] and zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        found.update((r["doc_id"], i) for i in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert all(n == copies[d] for (d, _), n in found.items()) and {d for d, _ in found} == set(t)
    for pieces in sequences.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0


def brute_bm25(ids, corpus, seed, d):
    own, mean = [x[:-1].tolist() for x in ids], sum(map(len, corpus)) / len(corpus)
    total = 0.0
    for t in set(own[seed]):
        df, tf = sum(t in x[:-1] for x in corpus), own[d].count(t)
        idf = np.log(1 + (len(corpus) - df + 0.5) / (df + 0.5))
        total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean))
    return total


def test_neighbours_are_ordered_by_bm25_of_the_corpus():
    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(2, 40, rng.integers(1, 30)), 1).astype("<u2") for _ in range(40)]
    elsewhere = [np.append(rng.integers(2, 40, 20), 1).astype("<u2") for _ in range(60)]
    everything, held = ids + elsewhere, np.zeros(1 << 16, int)
    for x in everything:
        held[np.unique(x[:-1])] += 1
    shard = packing.Shard(ids, packing.Corpus(len(everything), sum(map(len, everything)), held))
    for seed in range(5):
        shard.alive[:] = True
        shard.alive[seed] = False
        got, want = shard.neighbours(seed), [brute_bm25(ids, everything, seed, d) for d in range(len(ids))]
        assert seed not in got and set(got) == {d for d in range(len(ids)) if d != seed and set(ids[d][:-1]) & set(ids[seed][:-1])}
        assert all(want[x] >= want[y] - 1e-9 for x, y in zip(got, got[1:], strict=False))


def test_packing_puts_lexical_neighbours_together(spark):
    rng = random.Random(5)
    topics = [[f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in x] for x in ("xyz", "klm", "rst")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(400))) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BYTE).collect()
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append(r["doc_id"] % 3)
    same = sum(x == w[0] for w in windows.values() for x in w)
    assert same > 0.75 * len(got)


def test_hilbert_steps_are_neighbours_and_runs_are_even(docs):
    place = hilbert.curve(2, 3)
    at = {h: divmod(c, 8) for c, h in enumerate(place)}
    assert sorted(place) == list(range(64)) and all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(63))
    t, rows = texts(docs), hilbert.shard_documents(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert all(r["size"] == len(t[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(t[r["doc_id"]].encode()) for r in rows)


def test_shards_follow_the_curve_and_prune_files(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(1, 3000), rng.choice(["de", "en", "fr"]), f"s{rng.randrange(9)}", rng.randrange(1, 3000), "clash") for i in range(1500)]
    rows += [rows[0]] * 700 + [(None, None, None, None, None, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cell string")
    hilbert.write_shards(df, hilbert.dimensions(), str(tmp_path / "out"), files=30)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("__c", hilbert.cell_of(hilbert.dimensions()))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    spans = back.groupBy("hilbert_shard").agg(F.min("__c").alias("low"), F.max("__c").alias("high"), F.count("*").alias("n"), F.collect_set("lang").alias("langs")).orderBy("hilbert_shard").collect()
    assert len(spans) == 24 and all(x["high"] <= y["low"] for x, y in zip(spans, spans[1:], strict=False)) and max(s["n"] for s in spans) - min(s["n"] for s in spans) <= 1
    assert sum("fr" in s["langs"] for s in spans) <= 12  # a filter on a language reads half of the shards at most


def test_weak_rules_count_as_a_loop(docs):
    t = texts(docs)
    for r in weak_rules.judge(docs).collect():
        x = t[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + i for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for i in range(3)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(cover))
        assert r["n_dup_lines"] == sum(y in lines[:k] for k, y in enumerate(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def brute_em(votes, rounds=60):
    """The same model, document by document."""
    p = [0.5 + 0.45 * sum(v) / max(1, sum(x != 0 for x in v)) for v in votes]
    for _ in range(rounds):
        good = (sum(p) + weak_rules.CLASS) / (len(p) + 2 * weak_rules.CLASS)
        right = [[weak_rules.RIGHT] * len(votes[0]) for _ in range(2)]
        cast = [[weak_rules.RIGHT + weak_rules.WRONG] * len(votes[0]) for _ in range(2)]
        for v, x in zip(votes, p, strict=True):
            for j, one in enumerate(v):
                for c, share in ((0, 1 - x), (1, x)):
                    cast[c][j] += share * (one != 0)
                    right[c][j] += share * (one == 2 * c - 1)
        acc = [[a / b for a, b in zip(r, n, strict=True)] for r, n in zip(right, cast, strict=True)]
        for i, v in enumerate(votes):
            like = [1 - good, good]
            for j, one in enumerate(v):
                for c in (0, 1):
                    like[c] *= 1 if one == 0 else acc[c][j] if one == 2 * c - 1 else 1 - acc[c][j]
            p[i] = like[1] / sum(like)
    return p


def test_posterior_equals_brute_force(spark):
    rng, rows = random.Random(14), []
    for i in range(160):
        w = ["".join(rng.choice("abcdeor") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(55, 90))]
        kind = i % 4
        w = [x + "###" for x in w] if kind == 1 and i % 8 == 1 else [x.upper() + "!!" for x in w] if kind == 2 and i % 8 == 2 else w
        w = [rng.choice(w[:3]) for _ in w] if kind == 3 and i % 8 == 3 else w
        rows.append((i, ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) + "."))
    rows += [rows[0], (900, None), (901, "")]
    got = weak_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    votes = {i: [r.vote(weak_rules.measure(t or "")) for r in weak_rules.RULES] for i, t in rows}
    ids = [i for i, _ in rows]
    want = dict(zip(ids, brute_em([votes[i] for i in ids]), strict=True))
    assert len(got) == len(rows) and all(abs(r["quality"] - want[r["doc_id"]]) < 1e-4 for r in got)
    assert any(not r["kept"] and not r["base_failed"] for r in got)


def test_em_finds_the_better_rule():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.65)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    found = weak_rules.estimate(votes, np.ones(4000))
    assert abs(found.good - 0.7) < 0.05 and (found.accuracy[:, 0] > found.accuracy[:, 2] + 0.15).all()
    even = weak_rules.posterior(np.zeros((1, 3), int), weak_rules.Estimate(0.5, found.accuracy))
    assert even[0] == 0.5  # a tie, which keeps


def test_line_dedup(spark):
    rows = [(i, "boiler plate\nown " + str(i) + ("\nrare" if i < 2 else ""), "h") for i in range(30)] + [(99, None, "h"), (100, "boiler plate", "other")]
    out = {r["id"]: (r["text"], r["__dropped"]) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, text string, source string"), ratio=0.2).collect()}
    assert out[5] == ("own 5", 1) and out[0] == ("own 0\nrare", 1) and out[99] == (None, 0) and out[100] == ("boiler plate", 0)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_line_dedup_of_odd_pages(spark, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    foot, long = "\tall rights\r", "\n".join(f"own line {i}" for i in range(50_000))
    rows = [(1, f"{foot}\n{foot}\n\t\n", None), (2, f"all rights\n{long}", None), (2, "all rights", None), (3, "", "a"), (4, None, "a"), (5, "x\nfoot", "b"), (6, "foot\t\ny", "b"), (7, "alone", "c"), (7, "alone", "d")]
    df = spark.createDataFrame([(*r, "u", "v", "w", "z") for r in rows], "id long, text string, source string, drop string, lines string, page string, __dropped string")
    got = line_dedup.drop_boilerplate(df, ratio=0.6, counts=("n", "gone")).collect()
    assert sorted((r["id"], r["text"], r["n"], r["gone"]) for r in got if r["text"] is not None) == sorted([(1, "\t\n", 4, 2), (2, long, 50_001, 1), (2, "", 1, 1), (3, "", 1, 0), (5, "x", 2, 1), (6, "y", 2, 1), (7, "alone", 1, 0), (7, "alone", 1, 0)])
    assert all((r["drop"], r["lines"], r["page"], r["__dropped"]) == ("u", "v", "w", "z") for r in got) and len(got) == len(rows)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.normal(size=6).astype("float32") for i in range(260)}
    v[7] = v[6] = v[5]
    rows = [(i, x.tolist(), "c") for i, x in v.items()] + [(900, None, "c"), (950, [float("nan")] * 6, "c"), (951, [None, 1.0], "c")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")).collect()
    q = {i: np.floor(256 * x.astype(float)).astype(int) for i, x in v.items()}
    want = [(i, k + 1, c, -s) for i in q if i % 50 == 0 for k, (s, c) in enumerate(sorted((-int(q[i] @ q[c]), c) for c in q if c != i)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def brute_top(rows, k=5, every=50):
    """rows: (id, vector). Queries of equal id and vector are one."""
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for i, own in {(i, tuple(v)) for i, v in q if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), j) for j, v in q if j != i)[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("dense, rounds", [(64, 16_384), (0, 16_384), (2, 2)])
def test_top_k_of_odd_vectors(spark, dense, rounds, monkeypatch):
    monkeypatch.setattr(topk, "DENSE", dense)
    monkeypatch.setattr(topk, "ROUND", rounds)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in rng.choice(np.arange(1, 5000), 300, replace=False)]
    rows += [(50 * i, rng.normal(size=8).tolist()) for i in range(6)]
    common = rng.normal(size=8).tolist()
    rows += [(i, common) for i in range(6000, 6150)] + [(6001, common)] * 9  # a very common vector, and repeated rows
    rows += [(0, common), (7001, [1.0]), (7002, [0.5] * 11), (7050, [-3.0, 2.0]), (8000, []), (8001, [3e6, -3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (3, [0.0, 0.0])]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == brute_top(rows)
    assert topk.top_k(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).count() == 0


def brute_fingerprint(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items, linked):
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in items}


def test_simhash_equals_brute_force(docs):
    fp = {i: brute_fingerprint(t, 3) for i, t in texts(docs).items()}
    want = brute_groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_of().alias("h"), "component_id").collect():
        assert r["h"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_simhash_takes_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), ("c", "quite another text here"), ("d", None), (None, "nothing like the others at all")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("b", "a"), ("a", "a"), (None, "a"), ("c", "c"), ("d", "d"), (None, None)]))


def plain_groups(v, radius):
    plain = simhash.Union(len(v))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius).tolist():
            plain.join(i, j)
    return [plain.find(i) for i in range(len(v))]


@pytest.mark.parametrize("shard_rows", [2000, 120, 40])
def test_vantage_point_tree_loses_no_pair(shard_rows):
    rng = np.random.default_rng(4)
    bit = lambda n: np.uint64(1) << rng.integers(0, 63, n, dtype=np.uint64)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    ball = base[0] ^ bit(300) ^ bit(300)  # so dense that no boundary divides it
    v = np.unique(np.concatenate([base, base[:400] ^ bit(400) ^ bit(400), ball]))
    shards, dealt, union = [0], [], simhash.Union(len(v))
    tree = simhash.grow(v[::2], 2, 2.0, shard_rows, shards)
    simhash.dealt(tree, v, np.arange(len(v)), 2, dealt)
    rows, of = (np.concatenate(x) for x in zip(*dealt, strict=True))
    assert of.max() < shards[0] and (shard_rows >= 2000 or len(np.unique(of)) > 4)
    for s in np.unique(of):
        own, found = rows[of == s], simhash.Union(int((of == s).sum()))
        simhash.search(v[own], 2, found)
        assert all(int(v[own[a]] ^ v[own[b]]).bit_count() <= 2 for a, b in found.links)
        for a, b in found.links:
            union.join(int(own[a]), int(own[b]))
    assert [union.find(i) for i in range(len(v))] == plain_groups(v, 2)


def test_leaves_follow_the_rows():
    """Each value of the sample stands for as many rows as there are more of them: the shards stay of one size."""
    v = np.random.default_rng(9).integers(0, 2**63, 40_000, dtype=np.uint64)
    for n in (1e6, 1e9):
        shards, want = [0], int(simhash.PER_SHARD * n / simhash.SHARD_ROWS)
        simhash.grow(v[:want], 2, n / min(want, len(v)), simhash.SHARD_ROWS * max(1, want / len(v)), shards)
        assert shards[0] >= min(want, len(v)) / simhash.PER_SHARD / 2


def test_links_of_a_hot_node_are_joined(spark):
    edges = spark.range(1, 5000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.createDataFrame([(7000, 7001), (7001, 7002), (4999, 7000), (8001, 8000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in [*range(1, 5000), 7000, 7001, 7002]} | {8001: 8000}


def test_samples_of_very_many_rows(spark):
    from fieldscope.llm.common import sampled

    df = spark.range(200_000)
    assert 100 < sampled(df, "id", 1e-3).count() < 300 and sampled(df, "id", 1.0).count() == 200_000
    below = int(20_000 / 1e11 * 2**64) - 2**63  # of a hundred thousand million labelled rows
    assert below > -(2**63) and f"{below}" in sampled(df, "id", 20_000 / 1e11)._jdf.queryExecution().toString()


def test_segments_equal_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]

        def maximal(lo, hi):
            best = max(((sum(s[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return maximal(lo, i) + [(i, j, best[0])] + maximal(j, hi)

        assert [(i, j, round(x, 9)) for i, j, x in toxicity.segments(np.array(s))] == [(i, j, round(x, 9)) for i, j, x in maximal(0, len(s))]


def test_score_equals_a_plain_calculation():
    model = toxicity.Model({"vile": 4.0, "mean": 1.5, "kind": -2.0}, 0.9, -1.0, (-4.0, 1.0, 2.0))
    text = "a kind word then vile mean vile words and so on until vile again"
    words = text.split()
    s = [model.scores.get(w, -toxicity.DRIFT) for w in words]
    best = max((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    n, found = model.passages(text)
    evidence = 0.9 * best[0] + 1.0 - np.log(len(words))
    assert n == len(words) and max(found, key=lambda f: f[2])[:2] == best[1:] and abs(max(f[3] for f in found) - evidence) < 1e-9
    x = -4.0 + 1.0 + 2.0 * np.log1p(sum(f[3] for f in found))
    assert abs(model.score(found) - 1 / (1 + np.exp(-x))) < 1e-12 and abs(model.score([]) - 1 / (1 + np.exp(4.0))) < 1e-12


def test_cumulative_link_equals_a_plain_calculation():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(50, 6, replace=False).astype(np.int32), rng.random(6).astype(np.float32)) for _ in range(400)]
    hidden = rng.normal(size=50) * 3
    grade = np.digitize([float(hidden[a] @ v) + rng.logistic() * 0.3 for a, v in rows], [-1.5, 1.5])
    model = quality.fit(rows, grade, epochs=60)
    assert (np.diff(model.thresholds) > 0).all()

    def loss(m):
        total = 0.0
        for (a, v), g in zip(rows, grade, strict=True):
            above = [1.0, *(1 / (1 + np.exp(t - float(m.weights[a] @ v))) for t in m.thresholds), 0.0]
            assert np.allclose(above[1:-1], m.above(a, v)) and abs(m.expected(m.above(a, v)) - sum(k * (above[k] - above[k + 1]) for k in range(3))) < 1e-9
            total -= np.log(max(1e-12, above[g] - above[g + 1]))
        return total / len(rows)

    share = np.log(np.cumsum(np.bincount(grade))[:2] / len(grade) / (1 - np.cumsum(np.bincount(grade))[:2] / len(grade)))
    assert loss(model) < 0.6 * loss(quality.Model([0, 1, 2], np.zeros(quality.BUCKETS), share))


def test_classifiers_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good plain words here" if i % 2 else "b4d $$ text ##") + (" vile scum" if i % 5 == 1 else ""), "x", "y", "z") for i in range(40)]
    rows += [(100, None, "x", "y", "z"), (101, "", "x", "y", "z"), (102, "vile " * 200_000, "x", "y", "z"), (1, rows[1][1], "x", "y", "z"), (None, "plain", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, label string, score string")
    tox, qual = toxicity.train(df, labels), quality.train(df, labels)
    scored, graded = toxicity.score_documents(df, tox).collect(), quality.score_documents(df, qual).collect()
    assert len(scored) == len(graded) == len(rows) and all(0 <= r["score"] <= 1 for r in scored) and all(0 <= r["tail_probability"] <= 1 for r in graded)
    by = {r["doc_id"]: r for r in scored}
    assert by[100]["score"] == by[101]["score"] and by[100]["n_words"] == 0
    assert toxicity.keep(df, tox).columns == df.columns and quality.keep(df, qual).columns == df.columns


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeor") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(900):
        w, toxic, grade = [word() for _ in range(60)], int(rng.random() < 0.2), rng.randrange(3)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "scumbag", "jerkface"]))
        w = [x + "%&" if rng.random() < (2 - grade) * 0.4 else x for x in w]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, grade, toxic))
    docs, lab = spark.createDataFrame([*rows, (1000, None, "x")], "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (g, t) for i, g, t in labels}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, lab)).collect()}
    assert sum(got[i]["predicted"] == truth[i][1] for i in held) > 0.97 * len(held) and got[1000]["predicted"] == 0
    model = quality.train(docs, lab)
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    graded = {r["doc_id"]: r["expected_grade"] for r in quality.score_documents(docs, model).collect()}
    assert sum(abs(graded[i] - truth[i][0]) < 0.7 for i in held) > 0.9 * len(held)


def test_empty_tables(spark, empty):
    labels, vectors = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (token_counts.count_tokens(empty, WORD), bpe_codec.encode_documents(empty, WORD), packing.pack(empty, BYTE), hilbert.shard_documents(empty), weak_rules.judge(empty), line_dedup.drop_boilerplate(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), topk.top_k(vectors), toxicity.score_documents(empty, toxicity.train(empty, labels)), quality.score_documents(empty, quality.train(empty, labels))):
        assert df.count() == 0


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [*base[:100], "changed", *base[101:]]
    other = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base)), (4, " ".join(base)), (None, "no id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 3]


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def groups_of(spark, rows, **how):
    """The first id of each row's group."""
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    return {r["id"]: r["first"]["id"] for r in found.collect()}


def test_pairs_are_linked_from_the_similarity_on(spark):
    rng, rows, pairs = random.Random(3), [(9000, "")], []
    for i in range(0, 600, 2):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([60, 250]))]
        copy = list(base)
        for _ in range(rng.randint(1, len(base) // 20)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(9000)}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append((i, i + 1, len(a & b) / len(a | b)))
    group = groups_of(spark, rows)
    assert group[9000] == 9000 and sum(j >= 0.8 for *_, j in pairs) > 50
    assert all((group[a] == group[b]) == (j >= 0.8) for a, b, j in pairs)


def test_copies_of_one_id_and_one_text(spark):
    """Rows that share an id but not the text are documents each; of equal rows one stays; a third of the rows is one text."""
    rng = random.Random(21)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(3)]
    rows = [(1, long[0]), (1, long[1]), (2, long[2]), (2, long[2]), *((i, long[0]) for i in range(100, 160)), (7, None), (8, ""), (9, " \n"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, row string, digest string, id string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted([(1, long[0]), (1, long[1]), (2, long[2]), (7, ""), (-1, "x"), (-1, "x")])
    assert simhash.keep_one(df).columns == df.columns


def test_all_alike_pairs_are_linked_whatever_is_nearest(spark):
    """Families around one text: the nearest row of a row is often not alike while a farther one is."""
    rng, rows = random.Random(12), []
    for f in range(12):
        base = [f"w{rng.randrange(9000)}" for _ in range(120)]
        for k in range(25):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9000)}"
            rows.append((100 * f + k, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    want = brute_groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for radius in (0, 3):  # whether the fingerprints help or not
        assert groups_of(spark, rows, radius=radius) == want


def test_short_texts_at_the_least_similarity_are_all_linked(spark):
    rng, rows, pairs = random.Random(13), [], []
    for i in range(0, 1200, 2):
        base = [f"w{rng.randrange(90000)}" for _ in range(rng.randint(8, 60))]
        more = (len(base) - 4) // 4  # so many words more that the similarity is 0.8 or just above
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + [f"z{rng.randrange(90000)}" for _ in range(more)]))]
        pairs.append((i, i + 1))
    group = groups_of(spark, rows)
    assert sum(group[a] == group[b] for a, b in pairs) == len(pairs) and len(set(group.values())) == len(pairs)


def test_packing_of_many_texts_without_terms(spark):
    rows = [(i, None if i % 2 else "") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and all(r["length"] == r["doc_tokens"] == 1 for r in got)
    filled = Counter(r["sequence_id"] for r in got)
    assert max(filled.values()) == packing.WINDOW and sum(filled.values()) == 3000
