"""Packing by lexical retrieval.

Documents are encoded once. How many documents hold each token id, their number and their mean length are counted over the corpus: a table no
longer than the vocabulary. A vocabulary numbers its tokens by the order of their merges, so a document's highest ids are its rarest terms;
documents are ranged by their three highest, which brings those that share rare terms together, and by a hash, which parts copies that are
too many for a task. A task cuts its range into shards of a bounded number of ids and makes an inverted index of each. A window is opened by
a seed document; BM25 with all of the seed's terms (or its rarest `query_terms`) scores its unused neighbours in the shard, and these fill
the window greedily, best first. The document that reaches the window's end is cut there and its rest seeds the next window, so windows are
full. What is left at the end of a task goes into sequences whose lengths are powers of two, which need no padding. A sequence's id holds the
partition and its number there. Neighbours in other shards are not looked up: that would meet all shards with all.

Defined results: null and empty texts are the single id 1; documents of any length are cut into as many pieces as needed; repeated rows are
packed each; an empty table gives no rows; columns not named are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import ddl, durable, strings, whole
from fieldscope.llm.wordbpe import printable_bytes

WINDOW, END_ID, K1, B = 2048, 1, 1.2, 0.75
SHARD_IDS, TASK_IDS = 1 << 20, 1 << 26
#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of texts as the vocabulary's library gives them, with its special strings recognised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte, vocab = str.maketrans(printable_bytes()), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t.translate(as_byte).encode("latin-1"): i for t, i in vocab.items() if t not in self.special}
        self.coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _plain(self, text: str) -> bytes:
        return np.asarray(array("H", self.coder.encode_ordinary(text)), "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u2").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(self.cut.split(text)))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class Corpus:
    """Counts over all documents, for BM25: their number, their mean length, and how many of them hold each id."""

    def __init__(self, documents: int, ids: int, held: np.ndarray):
        self.mean = max(1.0, ids / max(1, documents))
        self.idf = np.log(1 + (documents - held + 0.5) / (held + 0.5))


class Shard:
    """An inverted index over the documents of a shard, and the packing of them into windows. Ids are terms, but for the last one."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus, query_terms: int | None = None):
        self.ids, n = ids, len(ids)
        lengths = np.array([len(x) - 1 for x in ids], np.int64)
        term = np.concatenate([x[:-1] for x in ids]).astype(np.uint64)
        key, tf = np.unique(term << np.uint64(32) | np.repeat(np.arange(n, dtype=np.uint64), lengths), return_counts=True)
        term, self.doc = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        norm = K1 * (1 - B + B * (lengths + 1) / corpus.mean)
        self.weight = corpus.idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.begin = np.searchsorted(term, np.arange(len(corpus.idf) + 1))
        self.idf, self.query_terms = corpus.idf, query_terms
        self.alive, self.next = np.ones(n, bool), 0

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents that share terms with the seed, best BM25 score first, ties in their order."""
        terms = np.unique(self.ids[seed][:-1])
        if self.query_terms is not None:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[: self.query_terms]]
        spans = [slice(i, j) for i, j in zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist(), strict=True) if j - i > 1]
        if not spans:
            return []
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.ids))
        found = np.flatnonzero(self.alive & (score > 0))
        return found[np.argsort(-score[found], kind="stable")].tolist()

    def take(self, seed: int | None, budget: int) -> list[int]:
        """Documents to follow the seed until their ids reach the budget, or all are used."""
        out = []
        while True:
            for d in self.neighbours(seed) if seed is not None else []:
                if budget <= 0:
                    return out
                out.append(d)
                self.alive[d] = False
                budget -= len(self.ids[d])
            while self.next < len(self.ids) and not self.alive[self.next]:
                self.next += 1
            if budget <= 0 or self.next == len(self.ids):
                return out
            seed = self.next  # a new seed within the window
            out.append(seed)
            self.alive[seed] = False
            budget -= len(self.ids[seed])
            if budget <= 0:
                return out


class Packer:
    """Windows of a task, over its shards; an open window goes from one shard to the next."""

    def __init__(self, partition: int, corpus: Corpus, query_terms: int | None):
        self.sequence, self.used, self.base, self.rows = 0, 0, partition << 32, []
        self.corpus, self.query_terms = corpus, query_terms

    def place(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, WINDOW - self.used)
            piece = ids[start : start + n].astype("<u4").tobytes()
            self.rows.append((doc, start, n, zlib.crc32(piece), len(ids), self.base + self.sequence, self.used, piece))
            start, self.used = start + n, self.used + n
            if self.used == WINDOW:
                self.sequence, self.used = self.sequence + 1, 0

    def shard(self, docs: list, ids: list[np.ndarray]) -> None:
        index, seed = Shard(ids, self.corpus, self.query_terms), None
        while True:
            taken = index.take(seed, WINDOW - self.used)
            if not taken:
                return
            for d in taken:
                self.place(docs[d], ids[d])
            seed = taken[-1] if self.used else None

    def finish(self) -> None:
        """The open window's pieces, cut anew into sequences of powers of two."""
        last = [r for r in self.rows if r[5] == self.base + self.sequence]
        self.rows = [r for r in self.rows if r[5] != self.base + self.sequence]
        room = used = 0
        left = sum(r[2] for r in last)
        for doc, start, n, _, whole_ids, _, _, piece in last:
            done = 0
            while done < n:
                if used == room:
                    self.sequence += 1
                    room, used = 1 << (left.bit_length() - 1), 0
                m = min(n - done, room - used)
                part = piece[4 * done : 4 * (done + m)]
                self.rows.append((doc, start + done, m, zlib.crc32(part), whole_ids, self.base + self.sequence, used, part))
                done, used, left = done + m, used + m, left - m


def encoded(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit, the end included), n, rare (the three highest ids in one number) of every row."""

    def run(batches):
        coder = byte_bpe(path)
        for b in batches:
            ids = [coder.encode(t) + END_ID.to_bytes(2, "little") for t in strings(b.column("text"))]
            rare = []
            for x in ids:
                top = np.unique(np.frombuffer(x, "<u2"))[-3:].tolist()
                rare.append(sum(t << 16 * i for i, t in enumerate(top, 3 - len(top))))
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), n, pa.array(rare, pa.int64())], ["doc_id", "ids", "n", "rare"])

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(df, id_col)}, ids binary, n long, rare long")


def corpus_counts(rows: DataFrame) -> Corpus:
    """Over all rows of encoded(); one count for each id of the vocabulary comes to the driver."""

    def held(batches):
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in strings(b.column("ids")):
                n[np.unique(np.frombuffer(x, "<u2")[:-1])] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    documents, ids = rows.agg(F.count("*"), F.sum("n")).first()
    counts = rows.select("ids").mapInArrow(held, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << 16, np.int64)
    total[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return Corpus(documents, ids or 0, total)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, query_terms: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary, 32-bit) if asked for."""
    types = [None, *[pa.int64()] * 6, pa.binary()]
    documents = durable(encoded(df, path, id_col, text_col))
    corpus = corpus_counts(documents)
    total = documents.agg(F.sum("n")).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK_IDS), min(-(-total // SHARD_IDS), 4 * cores))
    ranged = documents.withColumn("salt", F.xxhash64("ids", "doc_id")).repartitionByRange(tasks, "rare", "salt").sortWithinPartitions("rare", "salt")

    def run(batches):
        packer, docs, ids, held, kind = Packer(TaskContext.get().partitionId(), corpus, query_terms), [], [], 0, None

        def rows(keep: int):
            ready = packer.rows[: len(packer.rows) - keep]
            packer.rows = packer.rows[len(packer.rows) - keep :]
            for at in range(0, len(ready), 2000):
                columns = list(zip(*ready[at : at + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], types[i] or kind) for i in range(7 + with_ids)], NAMES[: 7 + with_ids])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, own in zip(b.column("doc_id").to_pylist(), strings(b.column("ids")), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(own, "<u2"))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    packer.shard(docs, ids)
                    docs, ids, held = [], [], 0
                    yield from rows(sum(1 for r in packer.rows[-WINDOW:] if r[5] == packer.base + packer.sequence))
        if ids:
            packer.shard(docs, ids)
        if kind is not None:
            packer.finish()
            yield from rows(0)

    kinds = f"doc_id {ddl(df, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranged.select("doc_id", "ids").mapInArrow(run, kinds + ", ids binary" * with_ids)
