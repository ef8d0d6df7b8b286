"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes, a space and the text. Offsets where tokens of both end cut them into groups; an A and a B token that
overlap are linked. A pair of ids is one number, A's id in the upper 32 bits. A partition counts its pairs by np.unique; partial counts are
range-partitioned and sorted by pair, runs are summed, and each range becomes a shard: a file of sorted pairs and their counts in the shared
folder. A second pass looks its pairs up in the memory-mapped shards by searchsorted.

Neither tokenizer joins a white-space run to what stands before it, so texts are cut there into units, which are aligned independently: a
partition aligns each distinct unit once and counts how often it occurs. Which characters allow a cut is read from B's vocabulary.

Memory: units and counts are passed on before they grow beyond fixed bounds; the highest count of each B id is one number an id. A pair has
at most one row a partition (and flush) before the sort, whatever the number of its links. A shard's file is named by its task attempt and
known by the row that the attempt returns, so that repeated attempts do no harm.

Defined results: null and empty texts, and those whose B tokens do not give the bytes back (they hold U+2581), have no tokens and count
nothing; any length; repeated rows count and are returned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, durable, shared_folder, strings, whole
from fieldscope.llm.packing import byte_bpe

#: Unicode white space, as both tokenizers' patterns know it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = "\u2581"  # B's sign for a space
#: Distinct units, aligned at once and held by a partition; distinct pairs held; units of a text held as a list.
AT_ONCE, MOST_UNITS, MOST_PAIRS, IN_LIST = 50_000, 250_000, 1 << 20, 200_000
LONG_TEXT, MOST_CHARS = 1 << 20, 1 << 24
TABLE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Aligner:
    """Units of texts and their alignment. B must keep texts as they are and fall back to bytes."""

    def __init__(self, a_path: str, b_path: str):
        coder = byte_bpe(a_path).coder
        self.encode_a = coder.encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_ids = range(self.b.get_piece_size())
        own = [i for i in b_ids if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        pieces = {i: self.b.id_to_piece(i) for i in b_ids}
        as_bytes = lambda i: bytes([int(pieces[i][3:5], 16)]) if self.b.is_byte(i) else pieces[i].replace(SPACE, " ").encode()
        self.b_bytes = [as_bytes(i) for i in b_ids]
        self.a_size = np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)])
        self.b_size = np.array(list(map(len, self.b_bytes)))
        self.a_text, self.b_text = ([str(i) for i in range(n)] for n in (len(self.a_size), len(self.b_size)))
        self.space = self.b.piece_to_id(SPACE)
        if sum(map(self.b.is_byte, b_ids)) != 256 or not self.keeps(" ﬁ ½  x\n\t　É\x00 </s> "):
            raise ValueError("the second vocabulary changes texts or has no bytes to fall back to")
        # A cut before a run of white space is certain where no piece holds its first character behind another one.
        joined = {c for i in own for c in pieces[i][1:] if set(pieces[i]) != {c}}
        self.cuts = "".join(c for c in " \n" if (SPACE if c == " " else c) not in joined)
        stays = f"(?![{self.cuts}])[{WHITE}]" if self.cuts else f"[{WHITE}]"
        self.unit = re.compile(f"[{WHITE}]*[^{WHITE}]*(?:{stays}[{WHITE}]*[^{WHITE}]*)*")

    def keeps(self, text: str) -> bool:
        return b"".join(map(self.b_bytes.__getitem__, self.b.encode(text))) == (" " + text).encode()

    def units(self, text: str | None):
        """Lists of the units of a space and the text; they join to it. None for texts without tokens."""
        if not text or SPACE in text:
            return
        if len(text) <= LONG_TEXT:
            yield list(filter(None, self.unit.findall(" " + text)))
        else:
            found = filter(None, (m[0] for m in self.unit.finditer(" " + text)))
            while part := list(islice(found, IN_LIST)):
                yield part

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it is given: that is the unit's own, or is taken off."""
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u == " ":
                out[i] = [self.space]
            elif u[0] != " ":
                out[i] = out[i][1:]
        return out


class Links:
    """The alignment of units, one after the other: for each link its unit, its pair, and whether a group ends there."""

    def __init__(self, aligner: Aligner, units: list[str]):
        a, b = list(map(aligner.encode_a, units)), aligner.encode_b(units)
        data = [u.encode("utf-8", "surrogatepass") for u in units]
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_end, b_end = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        ends = np.union1d(a_end, b_end)
        self.at_a, self.at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        unit_end = np.cumsum(np.fromiter(map(len, data), np.int64, len(units)))
        if b"".join(map(aligner.b_bytes.__getitem__, self.b.tolist())) != b"".join(data):
            raise ValueError("a unit was not encoded as its own bytes")
        self.unit = np.searchsorted(unit_end, ends)
        self.pair = self.a[self.at_a] << 32 | self.b[self.at_b]
        self.closes = (a_end[self.at_a] == ends) & (b_end[self.at_b] == ends)
        self.n_links = np.bincount(self.unit, minlength=len(units))
        self.n_groups = np.bincount(self.unit[self.closes], minlength=len(units))

    def groups(self, aligner: Aligner) -> list[str]:
        """For each unit its groups as a1,a2|b1;a3|b2,b3."""
        a, b = (list(map(t.__getitem__, x.tolist())) for t, x in ((aligner.a_text, self.a), (aligner.b_text, self.b)))
        ends_a, ends_b = (self.at_a[self.closes] + 1).tolist(), (self.at_b[self.closes] + 1).tolist()
        out, i, j = [], 0, 0
        for x, y in zip(ends_a, ends_b, strict=True):
            out.append((a[i] if x == i + 1 else ",".join(a[i:x])) + "|" + (b[j] if y == j + 1 else ",".join(b[j:y])))
            i, j = x, y
        at = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        return [";".join(out[i:j]) for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sums of their counts."""
    distinct, back = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, counts)
    return distinct, total


def partial_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair, n: links of each pair of ids, as counted by a partition (or a part of it)."""

    def run(batches):
        own, seen, chars = aligner(a_path, b_path), Counter(), 0
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def taken():
            """The pairs held so far with those of the units seen, which are then forgotten."""
            got = [(pairs, counts)]
            for at in range(0, len(seen), AT_ONCE):
                some = dict(islice(seen.items(), at, at + AT_ONCE))
                links = Links(own, list(some))
                got.append(summed(links.pair, np.fromiter(some.values(), np.int64)[links.unit]))
            seen.clear()
            return summed(*map(np.concatenate, zip(*got, strict=True)))

        def rows():
            for at in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000]), pa.array(counts[at : at + 100_000])], ["pair", "n"])

        for batch in batches:
            for text in strings(batch.column("text")):
                for part in own.units(text):
                    seen.update(part)
                chars += len(text)
                if len(seen) > MOST_UNITS or chars > 4 * MOST_CHARS:
                    pairs, counts, chars = *taken(), 0
                    if len(pairs) > MOST_PAIRS:
                        yield from rows()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = taken()
        yield from rows()

    return texts.select("text").mapInArrow(run, "pair long, n long")


def local_or_remote(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class Writer:
    """The shards of a range: sorted pairs and counts arrive in order and are written as two runs of 64-bit integers."""

    def __init__(self, uri: str, most: int = 1 << 22):
        self.store, self.path = local_or_remote(uri)
        self.most, self.keys, self.counts, self.held, self.files = most, [], [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        return self.flush() if self.held >= self.most else []

    def flush(self) -> list[tuple[str, int, int]]:
        """(file, lowest pair, pairs) of the shard that is written, if any."""
        if not self.held:
            return []
        keys = np.concatenate(self.keys)
        name = f"{self.path}/shard-{TaskContext.get().taskAttemptId()}-{self.files}"
        with self.store.open_output_stream(name) as out:
            out.write(keys.tobytes())
            for c in self.counts:
                out.write(c.tobytes())
        row = (name.rsplit("/", 1)[1], int(keys[0]), len(keys))
        self.keys, self.counts, self.held, self.files = [], [], 0, self.files + 1
        return [row]


def write_shards(partial: DataFrame, uri: str) -> DataFrame:
    """Sums the runs of the range-partitioned, sorted partial counts into shards.

    Rows (shard, low, n) of shards, and rows (b, best) of the highest count of each B id in a range. durable: the files are written once.
    """

    def run(batches):
        out, best = Writer(uri), {}
        last, rest = None, 0  # the run that may go on in the next batch

        def took(keys, counts):
            b = keys & 0xFFFFFFFF
            order = np.lexsort((counts, b))
            ends = np.concatenate([np.flatnonzero(np.diff(b[order])), [len(b) - 1]])
            for x, n in zip(b[order][ends].tolist(), counts[order][ends].tolist(), strict=True):
                best[x] = max(best.get(x, 0), n)
            return out.add(keys, counts)

        found = []
        for batch in batches:
            keys, counts = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            if not len(keys):
                continue
            begin = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            keys, counts = keys[begin], np.add.reduceat(counts, begin)
            if last is not None and keys[0] == last:
                counts[0] += rest
            elif last is not None:
                keys, counts = np.concatenate([[last], keys]), np.concatenate([[rest], counts])
            last, rest = int(keys[-1]), int(counts[-1])
            if len(keys) > 1:
                found += took(keys[:-1], counts[:-1])
        if last is not None:
            found += took(np.array([last]), np.array([rest]))
        found += out.flush()
        nothing = [None] * len(found)
        if found:
            shard, low, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64())], ["shard", "low", "n", "b", "best"])
        b = sorted(best)
        none = [None] * len(b)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(b, pa.int64()), pa.array([best[x] for x in b], pa.int64())], ["shard", "low", "n", "b", "best"])

    ranged = partial.repartitionByRange("pair").sortWithinPartitions("pair")
    return durable(ranged.mapInArrow(run, "shard string, low long, n long, b long, best long"))


class Shards:
    """Counts by pair, from the shards' files. Local files are memory-mapped; others are read, one at a time."""

    def __init__(self, uri: str, listed: list[tuple[str, int, int]]):
        self.store, self.path = local_or_remote(uri)
        self.listed = sorted(listed, key=lambda x: x[1])
        self.lows, self.open = np.array([x[1] for x in self.listed], np.int64), {}

    def columns(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            name, _, n = self.listed[i]
            path = f"{self.path}/{name}"
            if isinstance(self.store, fs.LocalFileSystem):
                data = np.memmap(path, np.int64, "r")
            else:
                self.open.clear()
                with self.store.open_input_file(path) as f:
                    data = np.frombuffer(f.read(), np.int64)
            self.open[i] = data[:n], data[n:]
        return self.open[i]

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Of sorted pairs, all of which were counted."""
        out = np.zeros(len(pairs), np.int64)
        at = np.searchsorted(self.lows, pairs, "right") - 1
        for i in np.unique(at).tolist():
            mine = at == i
            keys, n = self.columns(i)
            place = np.searchsorted(keys, pairs[mine])
            if not np.array_equal(keys[place], pairs[mine]):
                raise RuntimeError("a pair is missing from the counted shards")
            out[mine] = n[place]
        return out


class Units:
    """Distinct units seen by a task: their numbers in TABLE and their groups. Forgotten beyond a bound."""

    def __init__(self, own: Aligner, shards: Shards, best: np.ndarray):
        self.own, self.shards, self.best = own, shards, best
        self.clear()

    def clear(self) -> None:
        self.number, self.groups, self.table, self.chars = {}, [], np.zeros((0, len(TABLE)), np.int64), 0

    def learn(self, units: list[str]) -> None:
        tables = [self.table]
        for at in range(0, len(units), AT_ONCE):
            some = units[at : at + AT_ONCE]
            links = Links(self.own, some)
            distinct, back = np.unique(links.pair, return_inverse=True)
            counts = self.shards.counts(distinct)[back]
            first = np.concatenate([[0], np.cumsum(links.n_links)[:-1]])
            is_best = (counts == self.best[links.pair & 0xFFFFFFFF]).astype(np.int64)
            tables.append(np.stack([links.n_a, links.n_b, links.n_groups, links.n_links, np.add.reduceat(is_best, first), np.add.reduceat(counts, first)], axis=1))
            for u, g in zip(some, links.groups(self.own), strict=True):
                self.number[u] = len(self.groups)
                self.groups.append(g)
                self.chars += len(u) + len(g)
        self.table = np.concatenate(tables)

    def known(self, lists: list[list[str]]) -> None:
        """Makes all units of the lists known."""
        if len(self.number) > MOST_UNITS or self.chars > MOST_CHARS:
            self.clear()
        new = set().union(*lists)
        new.difference_update(self.number)
        if new:
            self.learn(list(new))


class Alignment:
    """Pair counts of a corpus: shards in a folder, their list, and the highest count of each B id."""

    def __init__(self, spark, uri: str, listed: list[tuple[str, int, int]], best: np.ndarray):
        self.spark, self.uri, self.listed, self.best = spark, uri, listed, best

    def remove(self) -> None:
        """Deletes the counts, here and in the shared folder."""
        store, path = local_or_remote(self.uri)
        store.delete_dir(path)

    def pairs(self) -> DataFrame:
        """a, b, n of every linked pair of ids; a task reads a shard."""
        uri = f"{self.uri}/shards"

        def run(batches):
            for batch in batches:
                for name, low, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "low", "n")), strict=True):
                    keys, counts = Shards(uri, [(name, low, n)]).columns(0)
                    for at in range(0, n, 100_000):
                        k = keys[at : at + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(np.array(counts[at : at + 100_000]))], ["a", "b", "n"])

        listed = self.spark.createDataFrame(self.listed, "shard string, low long, n long").repartition(max(1, len(self.listed)))
        return listed.mapInArrow(run, "a long, b long, n long")


def count_pairs(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> Alignment:
    """Counts the links of all texts by pair of ids."""
    spark = docs.sparkSession
    uri = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    store, path = local_or_remote(uri)
    store.create_dir(f"{path}/shards", recursive=True)
    # A written table: the range partitioning reads it twice, for its bounds and for the rows.
    partial_counts(docs.select(whole(text_col).alias("text")), a_path, b_path).write.parquet(f"{uri}/partial")
    written = write_shards(spark.read.parquet(f"{uri}/partial"), f"{uri}/shards")
    listed = [(r["shard"], r["low"], r["n"]) for r in written.where("shard is not null").select("shard", "low", "n").collect()]
    best = np.zeros(len(aligner(a_path, b_path).b_size), np.int64)
    for b, n in written.where("b is not null").groupBy("b").agg(F.max("best")).collect():  # a row an id of B's vocabulary
        best[b] = n
    return Alignment(spark, uri, listed, best)


def align(docs: DataFrame, counts: Alignment, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (or groups_sha256) of every row; no shuffle."""
    uri, listed, best = f"{counts.uri}/shards", counts.listed, docs.sparkSession.sparkContext.broadcast(counts.best)
    last = "groups_sha256" if digest else "groups"

    def aligned(units: Units, lists) -> tuple:
        total, hashed, texts = np.zeros(len(TABLE), np.int64), hashlib.sha256(), []
        for part in lists:
            at = list(map(units.number.__getitem__, part))
            total += units.table[at].sum(axis=0)
            text = (";" if texts else "") + ";".join(map(units.groups.__getitem__, at))
            texts.append("" if digest else text)
            hashed.update(text.encode())
        return *total.tolist(), (hashed.hexdigest() if texts else "") if digest else "".join(texts)

    def run(batches):
        own = aligner(a_path, b_path)
        units = Units(own, Shards(uri, listed), best.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                texts = part.column("text").to_pylist()
                short = [list(own.units(t)) if len(t) <= LONG_TEXT else None for t in texts]
                units.known([u for lists in short if lists for u in lists])
                for t, lists in zip(texts, short, strict=True):
                    rows.append(aligned(units, lists) if lists is not None else None)
                for i, t in enumerate(texts):
                    if rows[i] is None:
                        rows[i] = aligned(units, known(units, own.units(t)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], ["doc_id", *TABLE, last])

    def known(units: Units, lists):
        for part in lists:
            units.known([part])
            yield part

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(docs, id_col)}, {', '.join(f'{c} long' for c in TABLE)}, {last} string")


def align_corpus(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both passes; the result is durable and the shards are removed."""
    counts = count_pairs(docs, a_path, b_path, text_col)
    out = durable(align(docs, counts, a_path, b_path, digest, id_col, text_col))
    counts.remove()
    return out
