"""BPE encoding by forced-boundary splitting, and decoding.

Two bytes that stand side by side in no token of the vocabulary can never end up in one token, so the place between them is a certain
cut. The fragments between cuts are encoded independently (the merge loop never looks across a cut) and the ids are concatenated.

Defined results: null text is the empty text (no ids, empty decoded text); any length; rows that repeat are encoded row by row; an empty
table gives no rows; other columns are not read. Memory: caches start anew beyond a fixed number of entries.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import Memo, ddl, whole
from fieldscope.llm.wordbpe import END, word_bpe


class Codec:
    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self.joined = {p for t in self.bpe.ids for b in [t.rstrip(END)] for p in zip(b, b[1:], strict=False)}
        self.packed = [self.bpe.ids.get(s, 0).to_bytes(4, "little") for s in self.bpe.symbols]
        self.fragment = Memo(self._fragment, 300_000)
        self.unit = Memo(self._unit, 400_000)
        self.shown = Memo(lambda ids: " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())), 400_000)
        self.strings = [self.bpe.strings.get(i, "") for i in range(max(self.bpe.strings) + 1)]

    def cuts(self, word: str) -> list[str]:
        """The fragments of a pre-token; the last carries the word end."""
        if self.joined.issuperset(zip(word, word[1:], strict=False)):
            return [word + END]
        out, begin = [], 0
        for i, pair in enumerate(zip(word, word[1:], strict=False), 1):
            if pair not in self.joined:
                out.append(word[begin:i])
                begin = i
        return [*out, word[begin:] + END]

    def _fragment(self, fragment: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.bpe.core.encode_single_piece(self.bpe.coded(fragment))))

    def _unit(self, unit: str) -> bytes:
        return b"".join(self.fragment[f] for w in self.bpe.pretokens(unit) for f in self.cuts(w))

    def pieces(self, text: str) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in pieces that white space or added tokens separate."""
        out = []
        for i, part in enumerate(self.bpe.parts(text)):
            if i % 2:
                out.append(self.bpe.added[part].to_bytes(4, "little"))
            else:
                out += map(self.unit.__getitem__, self.bpe.units(self.bpe.normal(part)))
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, *pieces: bytes) -> str:
        """The token strings with a space between: the vocabulary names no decoder of its own."""
        return " ".join(map(self.shown.__getitem__, filter(None, pieces)))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded text of every row; no shuffle."""
    return _coded(df, path, id_col, text_col, "ids binary, decoded string", lambda ids, text: (ids, text), (pa.binary(), pa.string()))


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids and text, taken where these are made."""
    return _coded(df, path, id_col, text_col, "ids_sha256 string, decoded_sha256 string", lambda ids, text: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), (pa.string(), pa.string()))


def _coded(df, path, id_col, text_col, columns, show, types):
    names = ["doc_id", "n_tokens", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # outputs larger than the texts need not all be held
                part = b.slice(at, 500)
                ids, shown = [], []
                for t in part.column("text").to_pylist():
                    pieces = c.pieces(t)
                    ids.append(b"".join(pieces))
                    shown.append(show(ids[-1], c.decode(*pieces)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([s[i] for s in shown], t) for i, t in enumerate(types))], names)

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {ddl(df, id_col)}, n_tokens long, {columns}")
