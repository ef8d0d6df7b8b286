"""SimHash near-duplicates by a distributed vantage-point tree.

A fingerprint bit is set if it is set in over half the hashes of a text's word shingles. Equal fingerprints are collapsed first, so a
group of copies counts once. A vantage-point tree grown on a sample deals the distinct fingerprints to shards: those within mu of a node's
pivot go left, the others right. Two fingerprints within the radius of which one is left and one right are both within mu + radius of the
pivot, so the right ones that near the boundary are also sent left and no pair is lost. The sample holds PER_SHARD rows for each shard, so
there are as many leaves as the rows need; a path whose copies add up to MOST_COPIES is not divided further. A leaf that is larger than a
shard and that no boundary divides is cut into groups, and each two groups meet in a shard of their own. Inside a shard the same recursion
runs on arrays down to small leaves, which are compared whole; a shard returns the pairs that span its groups, never all pairs. These are
joined by alternating large-star and small-star steps.

copy_groups (the pipeline's stage) links texts whose sets of shingles have a similarity (Jaccard) of `least` or more. Texts of equal sets
are collapsed; the tree finds pairs of near fingerprints, which are compared by their sets. What the fingerprints miss is found without
them: of two alike texts the first shingles, in one order for all texts, share one. Rows of such prefixes whose shingle occurs in one group
only are dropped; then one row of each other group is compared with the first group's of its shingle, and last all pairs of still different
groups that share a prefix shingle and that sizes, places and parities of shingles do not exclude. No pair of the least similarity is left
out. The pairs of the last step can grow with the square of a family of texts that share a rare shingle and are not alike.

Defined results: null and empty texts, and those without words, have fingerprint zero and are linked with each other; any length; rows
that repeat share a fingerprint; rows without id keep their fingerprint and take the component of their equals; ids may be of any type with
an order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, durable, lookup, strings, whole

SEED, LEAF, PIECE = 42, 64, 65_536
SHARD_ROWS, PER_SHARD = 32_768, 64
#: A boundary near which more than this share of the rows lies divides too little to be worth its copies.
MOST_COPIED, MOST_COPIES = 0.45, 32.0
#: Up to so many rows (of at most 100 bytes) are broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 300_000


def hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and cut at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def fingerprint(h: np.ndarray) -> bytes:
    """64 bits, little-endian."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), PIECE):  # so that the bits of a long text are not all held
        bits = np.unpackbits(h[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            total += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").tobytes()


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary) of every row; no shuffle."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(hashes(t, shingle)) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(df, id_col)}, fp binary")


# The tree. A node is (pivot, mu, left, right), a leaf (number of its first shard, groups).


def split_at(d: np.ndarray, radius: int) -> int:
    """mu for which the left with its copies is about as large as the right."""
    counts = np.bincount(d, minlength=int(d.max()) + radius + 2)
    upto = np.cumsum(counts)
    mu = np.arange(len(counts) - radius)
    return int(mu[np.argmin(np.maximum(upto[mu + radius], len(d) - upto[mu]))])


def best_split(values: np.ndarray, radius: int, pivots: int):
    """(pivot, mu, distances) of the boundary with the fewest copies, or None if none divides well. Pivots are values, in a fixed order."""
    found = []
    for i in range(pivots):
        pivot = values[(i * 7919) % len(values)]
        d = np.bitwise_count(values ^ pivot)
        mu = split_at(d, radius)
        left, right = int((d <= mu + radius).sum()), int((d > mu).sum())
        if left + right <= (1 + MOST_COPIED) * len(values) and max(left, right) < 0.95 * len(values):
            found.append((left + right, i, pivot, mu, d))
    return min(found, key=lambda x: x[:2])[2:] if found else None


def grow(values: np.ndarray, radius: int, scale: float, shard_rows: int, shards: list[int], copies: float = 1.0):
    """A tree on a sample of which each value stands for `scale` rows; `shards` holds the number of shards and is counted up."""
    rows = len(values) * scale
    split = best_split(values, radius, 8) if rows > shard_rows and len(values) >= 16 and copies < MOST_COPIES else None
    if split is None:
        groups = max(1, math.ceil(rows / shard_rows))
        leaf = (shards[0], groups)
        shards[0] += groups * groups
        return leaf
    pivot, mu, d = split
    left, right = values[d <= mu + radius], values[d > mu]
    copies *= (len(left) + len(right)) / len(values)
    return (pivot, mu, *(grow(side, radius, scale, shard_rows, shards, copies) for side in (left, right)))


def dealt(tree, values: np.ndarray, rows: np.ndarray, radius: int, out: list) -> None:
    """Appends (rows, shards) of every leaf. In a leaf of several groups a row meets each other group in a shard of the two."""
    if len(tree) == 4:
        pivot, mu, left, right = tree
        d = np.bitwise_count(values[rows] ^ pivot)
        dealt(left, values, rows[d <= mu + radius], radius, out)
        dealt(right, values, rows[d > mu], radius, out)
        return
    first, groups = tree
    own = ((values[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % groups
    for other in range(groups):
        met = np.flatnonzero(own != other) if groups > 1 else np.arange(len(rows))
        low, high = np.minimum(own[met], other), np.maximum(own[met], other)
        out.append((rows[met], first + low * groups + high))


class Union:
    """Disjoint sets; `links` are the pairs that joined two of them."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def search(values: np.ndarray, radius: int, union: Union) -> None:
    """Unites all rows of a shard that differ in up to `radius` bits."""
    todo = [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            v = values[rows]
            i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius, 1))
            for a, b in zip(rows[i].tolist(), rows[j].tolist(), strict=True):
                union.join(a, b)
        elif (split := best_split(values[rows], radius, 4)) is not None:
            _, mu, d = split
            todo += [rows[d <= mu + radius], rows[d > mu]]
        else:  # so dense that no boundary divides it: flood from row to row, which leaves few to compare where rows are linked
            rest = rows
            while len(rest):
                front, rest = [int(rest[0])], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = np.bitwise_count(values[rest] ^ values[x]) <= radius
                    for y in rest[near].tolist():
                        union.join(x, y)
                    front += rest[near].tolist()
                    rest = rest[~near]


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8")


def near_pairs(rows: DataFrame, n: int, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: pairs of nodes within the radius that span each group of a shard. rows: node (of any type), fp; n: their number."""
    want = max(8192.0, PER_SHARD * n / shard_rows)
    share = min(1.0, want / max(1, n))
    values = _words(rows.where(F.rand(11) < share).select("fp").toArrow()["fp"].combine_chunks())
    tree = grow(values, radius, 1 / share, shard_rows, [0])
    kind = ddl(rows, "node")

    def route(batches):
        for b in batches:
            out: list = []
            dealt(tree, _words(b.column("fp")), np.arange(b.num_rows), radius, out)
            for at in range(0, len(out), 8):
                r = pa.array(np.concatenate([x for x, _ in out[at : at + 8]]))
                shard = pa.array(np.concatenate([s for _, s in out[at : at + 8]]), pa.int64())
                yield pa.RecordBatch.from_arrays([shard, b.column("node").take(r), b.column("fp").take(r)], ["shard", "node", "fp"])

    def link(t):
        t = t.sort_by([("fp", "ascending")])
        nodes, union = t["node"].combine_chunks(), Union(len(t))
        search(_words(t["fp"].combine_chunks()), radius, union)
        a, b = (pa.array([x[i] for x in union.links], pa.int64()) for i in (0, 1))
        return pa.table({"a": nodes.take(a), "b": nodes.take(b)})

    return rows.select("node", "fp").mapInArrow(route, f"shard long, node {kind}, fp binary").groupBy("shard").applyInArrow(link, f"a {kind}, b {kind}")


#: Up to so many links (of two nodes, at most 100 bytes) are joined by one task, beyond it by rounds over the cluster.
LOCAL_LINKS = 50_000


def contracted(edges: DataFrame) -> DataFrame:
    """node, component of links (a, b) that are few: disjoint sets in one task."""
    kind = ddl(edges, "a")

    def run(batches):
        up: dict = {}
        types: list = []

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for t in batches:
            types.append(t.schema.field("a").type)
            for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
                for x in (a, b):
                    up.setdefault(x, x)
                x, y = sorted((find(a), find(b)))
                up[y] = x
        nodes = [x for x in up if find(x) != x]
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, types[0]), pa.array([find(x) for x in some], types[0])], ["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b) that is not the smallest itself; a written table after each round."""
    greater = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")

    def settled(links: DataFrame):
        links = durable(links.where("a <> b").select(*greater).distinct())
        return links, links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()

    def least(links: DataFrame) -> DataFrame:
        return links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held"))

    edges, state = settled(edges)
    while state[0]:
        if state[0] <= LOCAL_LINKS:
            return durable(contracted(edges))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = lookup(both, least(both), "a", "held", 2 * state[0])
        large = met.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        lowest = least(large)
        met = lookup(large, lowest, "a", "held", state[0])
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        edges, after = settled(small)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row; fingerprints link at `radius` or fewer differing bits."""
    fps = durable(fingerprints(df, shingle, id_col, text_col))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("held")))
    n, total = distinct.agg(F.count("*"), F.sum("held")).first()
    found = components(near_pairs(distinct.select(F.col("fp").alias("node"), "fp"), n, radius, shard_rows))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least_id", "held", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("fps"))
    named = lookup(grouped, ids, "component", "fps", n).select("fp", "component_id", "held")
    return lookup(fps, named, "fp", "held", total or 0).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """64 bits as 16 hexadecimal digits, the highest first."""
    return F.lower(F.concat(*(F.substring(F.hex(fp), 2 * i + 1, 2) for i in range(7, -1, -1))))


# Texts that are alike by their sets of shingles.


def small(rows: DataFrame) -> DataFrame:
    """rows (of at most 100 bytes each) with a hint to broadcast them, if their counted number is small; else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def digest(text_col: str):
    return F.unhex(F.md5(whole(text_col).cast("binary")))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest, text: rows of equal id and digest hold the same text."""
    return docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), whole(text_col).alias("text"))


def shingle_order(texts: DataFrame, n: int, shingle: int, share: float = 0.05, least_rows: int = 2048, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts holds in two texts or more, sorted, and their counts: the `most` commonest. They only save pairs.

    The sample is a share of the texts, so that a shingle of so many texts is known as common at every size of the input.
    """

    def each(batches):
        for b in batches:
            for t in strings(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(t, shingle)).view(np.int64))], ["h"])

    sample = texts.select("text").where(F.rand(5) < max(share, min(1.0, least_rows / max(1, n))))
    often = sample.mapInArrow(each, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(most).toArrow()
    common, counts = often["h"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


CELLS = 2048


#: Cells of the folded parities, in words of 64 bits, that travel with the rows of shingles.
FOLDED = 4


def folded(parities: str = "parities"):
    """The parities in FOLDED words: a cell is the parity of all cells of its number modulo the fewer."""
    words = CELLS // 64
    xor = lambda j: "^".join(f"{parities}[{k}]" for k in range(j, words, FOLDED))
    return [F.expr(xor(j)).alias(f"fold_{j}") for j in range(FOLDED)]


def prefix_length(size: int, share: float) -> int:
    return size - math.ceil(share * size - 1e-9) + 1


def signatures(texts: DataFrame, shingle: int, least: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """id, digest, key of the set of shingles, fp, size, parities of the shingles in CELLS cells, and the set's prefix.

    The prefix holds the first shingles in the order of (count, hash), rare ones first: so many that a smaller alike set shares one.
    """
    types = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["key", "fp", "size", "parities", "prefix"]

    def signed(text: str):
        h = np.unique(hashes(text, shingle))
        key, fp = xxhash.xxh3_128_digest(h.tobytes()), fingerprint(h)
        if not len(h):
            return key, fp, 0, [0] * (CELLS // 64), []
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0) if len(common) else np.zeros(len(h), int)
        odd = np.bincount((h % np.uint64(CELLS)).astype(int), minlength=CELLS).astype(np.uint8) & 1
        first = h[np.lexsort((h, seen))[: prefix_length(len(h), least)]]
        return key, fp, len(h), np.packbits(odd).view(np.int64), first.view(np.int64)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = zip(*map(signed, part.column("text").to_pylist()), strict=True)
                columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), *columns], ["id", "digest", *names])

    return texts.mapInArrow(run, f"id {ddl(texts, 'id')}, digest binary, key binary, fp binary, size long, parities array<long>, prefix array<long>")


#: Pairs of one node that meet its text in one task.
TOGETHER = 256


def alike(texts: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose similarity is `least` or more. sets: rep, home (id and digest of a row with that set).

    Texts, which are much smaller than their hashed shingles, are brought to the pairs. The pairs of a hot node are parted by a hash, and its
    text is sent to each part.
    """

    def compare(batches):
        seen: dict[int, np.ndarray] = {}

        def grams(node: int, text: str) -> np.ndarray:
            if node not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[node] = np.unique(hashes(text, shingle))
            return seen[node]

        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 32):  # few texts at once as strings
                part = batch.slice(at, 32)
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                    x, y = grams(a, x), grams(b, y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    pairs = durable(pairs)
    total, asked = pairs.count(), pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    homes = durable(sets.join(asked, "rep").select("rep", "home.id", "home.digest"))
    met, parts = pairs, []
    for node in ("a", "b"):
        held = pairs.groupBy(node).agg(F.count("*").alias("held")).withColumn("parts", F.ceil(F.col("held") / TOGETHER))
        met = lookup(met, held, node, "held", total).withColumn(f"{node}_part", F.pmod(F.xxhash64("a", "b"), "parts")).drop("parts")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        parts.append(held.select(F.lit(node).alias("side"), F.col(node).alias("rep"), each.alias("part")))
    sent = durable(homes.join(parts[0].unionByName(parts[1]), "rep"))
    found = texts.join(small(sent), ["id", "digest"]).select("side", "rep", "part", "text").dropDuplicates(["rep", "part", "side"])
    for node, column in (("a", "x"), ("b", "y")):
        own = found.where(F.col("side") == node).select(F.col("rep").alias(node), F.col("part").alias(f"{node}_part"), F.col("text").alias(column))
        met = met.join(own, [node, f"{node}_part"])
    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def copy_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, digest, key), sets (key, held, grp) and groups (grp, sets, first: id and digest of the group's first row)."""
    texts = identified(docs, id_col, text_col)
    signed = durable(signatures(texts, shingle, least, *shingle_order(texts, docs.count(), shingle)))
    # All columns but id and digest are the same for equal sets, so that any row gives them.
    one = [F.first(c).alias(c) for c in ("fp", "size", "parities", "prefix")]
    sets = signed.groupBy("key").agg(F.min(F.struct("id", "digest")).alias("home"), F.count("*").alias("held"), *one)
    sets = durable(sets.withColumn("rep", F.monotonically_increasing_id()))
    measures = sets.select("rep", "size", "parities")

    def grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
        named = found.select(F.col("node").alias("rep"), "component")
        return rows.join(small(named), "rep", "left").withColumnRenamed("component", "grp")  # null: a group of its own

    def merged(found: DataFrame | None, pairs: DataFrame) -> DataFrame:
        links = alike(texts, sets, pairs, shingle, least)
        return components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def several(rows: DataFrame) -> DataFrame:
        """Rows whose shingle occurs in several groups."""
        w, grp = Window.partitionBy("token"), F.coalesce("grp", "rep")
        return rows.withColumns({"low": F.min(grp).over(w), "high": F.max(grp).over(w)}).where("low <> high").drop("low", "high")

    def possible(pairs: DataFrame) -> DataFrame:
        """a, b of those pairs (x_rep, y_rep) whose sizes and parities do not exclude the similarity."""
        pairs = durable(pairs)
        nodes = pairs.select(F.explode(F.array("x_rep", "y_rep")).alias("rep")).distinct()
        own = durable(measures.join(small(nodes), "rep", "left_semi"))
        near = pairs.join(side(own, "x"), "x_rep").join(side(own, "y"), "y_rep").where(sizes_allow(least))
        odd = F.aggregate(F.zip_with("x_parities", "y_parities", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return near.where(odd <= (1 - least) / (1 + least) * (F.col("x_size") + F.col("y_size")) + 1e-9).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(c if c == "token" else f"{name}_{c}") for c in rows.columns))

    found = merged(None, near_pairs(sets.select(F.col("rep").alias("node"), "fp"), sets.count(), radius))
    folds = [f"fold_{j}" for j in range(FOLDED)]
    tokens = grouped(sets.select("rep", "size", "prefix", *folded()), found).select("rep", "grp", "size", *folds, F.posexplode("prefix").alias("at", "token"))
    shared = durable(several(tokens))
    # One row of each group against the first of its shingle: as many pairs as rows, which join most of what the tree left apart.
    heads = shared.groupBy("token", F.coalesce("grp", "rep").alias("grp")).agg(F.min("rep").alias("x_rep"))
    heads = heads.withColumn("y_rep", F.min("x_rep").over(Window.partitionBy("token"))).where("x_rep <> y_rep").select("x_rep", "y_rep").distinct()
    found = merged(found, possible(heads))
    # Then all pairs of groups that are still apart.
    rest = durable(several(grouped(shared.drop("grp"), found)).withColumn("grp", F.coalesce("grp", "rep")))
    apart = f"x.token = y.token and x_grp <> y_grp and x_rep < y_rep and {in_place(least)} and {folds_allow(least)}"
    pairs = side(rest, "x").alias("x").join(side(rest, "y").alias("y"), F.expr(apart)).select("x_rep", "y_rep").distinct()
    found = merged(found, possible(pairs))
    homes = grouped(sets.select("rep", "key", "home", "held"), found).withColumn("grp", F.coalesce("grp", "rep"))
    return signed.select("id", "digest", "key"), homes, homes.groupBy("grp").agg(F.min("home").alias("first"), F.count("*").alias("sets"))


def sizes_allow(least: float) -> str:
    return f"least(x_size, y_size) >= {least!r} * greatest(x_size, y_size) - 1e-9"


def folds_allow(least: float) -> str:
    """Whether the folded parities leave room for the similarity: each cell that differs is a shingle that only one set has."""
    odd = " + ".join(f"bit_count(x_fold_{j} ^ y_fold_{j})" for j in range(FOLDED))
    return f"{odd} <= {(1 - least) / (1 + least)!r} * (x_size + y_size) + 1e-9"


def in_place(least: float) -> str:
    """Whether a shingle at the places x_at and y_at can be the first that two sets of the similarity share."""
    share, low = 2 * least / (1 + least), "least(x_size, y_size)"
    room = f"least(x_size - x_at, y_size - y_at) >= {least / (1 + least)!r} * (x_size + y_size) - 1e-9"
    return f"({sizes_allow(least)} and {room} and if(x_size <= y_size, x_at, y_at) < {low} - ceil({share!r} * {low} - 1e-9) + 1)"


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """id, digest, first (id and digest of its group's first row, by id) of every row of docs."""
    rows, homes, groups = copy_groups(docs, **how)
    named = lookup(homes, groups, "grp", "sets", homes.count()).select("key", "first", "held")
    return lookup(rows, named, "key", "held", rows.count()).select("id", "digest", "first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each group of near-copies the row with the smallest id, with all columns; rows without id stay.

    Of rows that share the id, that with the least digest of its text stays, and of those that share the text too, the first by a hash of all
    columns: the same on every run.
    """
    own = docs.where(F.col(id_col).isNotNull())
    rows, _, groups = copy_groups(own, id_col=id_col, text_col=text_col, **how)
    kept = groups.select("first.id", "first.digest", F.lit(True).alias("kept"))
    times = rows.groupBy("id", "digest").agg(F.count("*").alias("times")).join(kept, ["id", "digest"], "left")
    # All rows stay but those that are marked: as gone, or as kept but repeated.
    marks = durable(times.where("kept is null or times > 1").select("id", "digest", F.coalesce("kept", F.lit(False)).alias("kept")))
    marked = own.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), F.struct("*").alias("row"))
    single = marked.join(small(marks), ["id", "digest"], "left_anti").select("row.*")
    w = Window.partitionBy("id", "digest").orderBy(F.xxhash64("row"))
    again = marked.join(small(marks.where("kept")), ["id", "digest"], "left_semi").withColumn("place", F.row_number().over(w)).where("place = 1")
    return single.unionByName(again.select("row.*")).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
