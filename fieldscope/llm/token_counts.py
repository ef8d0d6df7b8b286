"""Token counts by a finite-state transducer that is compiled from a BPE vocabulary.

Within a pre-token the transducer reads bytes. Any run of tokens of a BPE encoding is the encoding of its own bytes, so the last token
of a prefix is the one token that ends there and is compatible with the last token before it. What later bytes can depend on is the
longest suffix that begins some token, with the last token and the relative count at each of its positions: a finite state. A transition
carries the change of the token count. States are made when they are first reached, as in lazily determinised automata. A state of the whole
machine adds how the pre-token goes on (letters, other signs, an apostrophe that may begin a contraction) and the byte that may be its last.

A chunk of text is a map from entry state to exit state and token count. White space resets the machine, so the map is tabulated for what
runs on from the entry state up to the first white space (its head), and is one count and one exit state for the rest. Tables hold the start
state and the state that the characters before the chunk lead to; another entry state is run and added when it is met, so maps are exact for
all states. Maps compose associatively: each entry of the first table is looked up in the second. Texts beyond LONG bytes are cut into chunks
that are spread over the cluster; their maps are composed in a balanced tree for each text, the reduction of a prefix scan.

Defined results: null text counts as empty, 0 tokens; any length of text; rows that repeat or share an id are counted row by row; an
empty table gives no rows; other columns of the input are not read. Memory: caches start anew beyond a fixed number of entries.
"""

from __future__ import annotations

import pickle
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import Memo, ddl, strings, whole
from fieldscope.llm.wordbpe import END, word_bpe

LONG, CHUNK, BEFORE = 1 << 17, 1 << 16, 256
MOST_STATES = 200_000


class CountTransducer:
    """Deterministic; transitions carry changes of the number of tokens."""

    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self.begins = {t.rstrip(END)[:i] for t in self.bpe.ids for i in range(len(t) + 1)}
        self.fits = Memo(lambda ab: self.bpe.merge(ab[0] + ab[1]) == [t for t in ab if t], 1_000_000)
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.steps, self.ends = [EMPTY], {EMPTY: 0}, {}, {}

    def _last(self, state: int, byte: str, end: str) -> tuple[str, int]:
        """The last token once byte is read, and the change of the count."""
        suffix, at = self.states[state]
        s = suffix + byte
        for i in range(len(s)):
            token, before = s[i:] + end, at[len(suffix) - i]
            if before is not None and token in self.bpe.ids and self.fits[before[0], token]:
                return token, before[1] + 1
        raise AssertionError(f"no token ends in {s!r}")

    def _step(self, state: int, byte: str) -> tuple[int, int]:
        suffix, at = self.states[state]
        token, change = self._last(state, byte, "")
        s = suffix + byte
        infos = [(token, 0)] + [x and (x[0], x[1] - change) for x in at]
        while s not in self.begins:
            s = s[1:]
        key = (s, tuple(infos[j] if s[len(s) - j :] in self.begins else None for j in range(len(s) + 1)))
        n = self.numbers.setdefault(key, len(self.states))
        if n == len(self.states):
            self.states.append(key)
        self.steps[state << 8 | ord(byte)] = step = (n, change)
        return step

    def number(self, key: tuple) -> int:
        if len(self.states) > MOST_STATES:
            self._reset()
        n = self.numbers.setdefault(key, len(self.states))
        if n == len(self.states):
            self.states.append(key)
        return n

    def read(self, key: tuple, word: str) -> tuple[tuple, int]:
        """The state after the bytes, and the change of the count."""
        state, n, steps = self.number(key), 0, self.steps
        for byte in word:
            state, change = steps.get(state << 8 | ord(byte)) or self._step(state, byte)
            n += change
        return self.states[state], n

    def end(self, key: tuple, byte: str) -> int:
        """The change of the count by the last byte of a pre-token."""
        at = self.number(key) << 8 | ord(byte)
        if (last := self.ends.get(at)) is None:
            last = self.ends[at] = self._last(at >> 8, byte, END)[1]
        return last

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        key, n = self.read(EMPTY, word[:-1])
        return n + self.end(key, word[-1])


EMPTY = ("", (("", 0),))


class State(NamedTuple):
    """mode: "" outside of pre-tokens, "a" within letters, "!" within other signs, or signs that may begin a contraction and are not yet read.

    word: the transducer's state before `last`, the byte that ends the pre-token unless another follows.
    """

    mode: str
    word: tuple
    last: str


START = State("", EMPTY, "")


class StateMap(NamedTuple):
    """From entry state to (exit state, tokens), for a chunk.

    head: the characters up to the first white space; table: their results by entry state, the end of the open pre-token included if `reset`
    (there is white space); n, exit: tokens and state of what follows the head.
    """

    head: str
    table: dict
    reset: bool
    n: int
    exit: State


class TextCounter:
    """The machine over normalised text, its chunk maps and their composition."""

    def __init__(self, path: str):
        self.bpe, self.machine = word_bpe(path), CountTransducer(path)
        self.words = Memo(self.machine.count, 300_000)
        self.unit = Memo(lambda u: sum(map(self.words.__getitem__, self.bpe.pretokens(u))))
        self.mode = Memo(lambda c: next((m for m in "a!" if len(self.bpe.pretokens(c + m)) == 1), ""))

    def close(self, state: State) -> int:
        """Tokens of the open pre-token's end."""
        if state.mode in ("", "a", "!"):
            return self.machine.end(state.word, state.last) if state.mode else 0
        return self.unit[state.mode]

    def run_on(self, state: State, run: str) -> tuple[State, int]:
        """The state and the tokens after characters without white space."""
        tokens, n = self.bpe.pretokens(state.mode + run), 0
        if state.mode in ("a", "!"):  # one sign stands for those already read
            joined, tokens = tokens[0][1:], tokens[1:]
            if joined:
                word, n = self.machine.read(state.word, state.last + joined[:-1])
                state = State(state.mode, word, joined[-1])
                if not tokens:
                    return state, n
            n += self.close(state)
        last = tokens[-1].encode("latin-1").decode()
        open_from = 2 if last in ("r", "v", "l") and tokens[-2:-1] == ["'"] else 1
        if open_from == 2 or last == "'":
            return State("'" * (open_from - 1) + last, EMPTY, ""), n + sum(map(self.words.__getitem__, tokens[:-open_from]))
        mode = "" if len(last) > 1 and last[0] == "'" and last[-1].isalpha() else self.mode[last[-1]]
        if not mode:  # a digit or a contraction, which nothing joins
            return START, n + sum(map(self.words.__getitem__, tokens))
        word, more = self.machine.read(EMPTY, tokens[-1][:-1])
        return State(mode, word, tokens[-1][-1]), n + more + sum(map(self.words.__getitem__, tokens[:-1]))

    def head_of(self, text: str) -> str:
        return self.bpe.units(text)[0] if text and self.bpe.units(text[0]) else ""

    def read(self, state: State, text: str) -> tuple[State, int]:
        """The state and the tokens after any characters."""
        n, head = 0, self.head_of(text) if state.mode else ""
        if head:
            state, n = self.run_on(state, head)
            text = text[len(head) :]
        if not text:
            return state, n
        n, units = n + self.close(state), self.bpe.units(text)
        if not self.bpe.units(text[-1]):
            return START, n + sum(map(self.unit.__getitem__, units))
        state, more = self.run_on(START, units[-1])
        return state, n + more + sum(map(self.unit.__getitem__, units[:-1]))

    def chunk_map(self, chunk: str, before: str = "") -> StateMap:
        """The map of a chunk, tabulated for the start state and for that which the characters before lead to."""
        head = self.head_of(chunk)
        reset = len(head) < len(chunk)
        exit_, n = self.read(START, chunk[len(head) :]) if reset else (START, 0)
        out = StateMap(head, {}, reset, n, exit_)
        for state in {START, self.read(START, before)[0]}:
            self.through_head(out, state)
        return out

    def through_head(self, m: StateMap, state: State) -> tuple[State, int]:
        if state not in m.table:
            to, n = self.run_on(state, m.head) if m.head else (state, 0)
            m.table[state] = (START, n + self.close(to)) if m.reset else (to, n)
        return m.table[state]

    def at(self, m: StateMap, state: State) -> tuple[State, int]:
        """Exit state and tokens of a map for an entry state."""
        to, n = self.through_head(m, state)
        return (m.exit, m.n + n) if m.reset else (to, n)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a.reset:
            exit_, n = self.at(b, a.exit)
            return StateMap(a.head, a.table, True, a.n + n, exit_)
        table = {}
        for state, (between, n) in a.table.items():
            to, more = self.through_head(b, between)
            table[state] = (to, n + more)
        return StateMap(a.head + b.head, table, b.reset, b.n, b.exit)

    def total(self, maps: list[StateMap]) -> int:
        """Tokens of a text by the maps of its chunks, composed in a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[j : j + 2]) if j + 1 < len(maps) else maps[j] for j in range(0, len(maps), 2)]
        end, n = self.at(maps[0], START)
        return n + self.close(end)

    def chunks(self, text: str, size: int = CHUNK) -> list[tuple[int, str, str]]:
        """(part, characters before, chunk) of the normalised parts between added tokens; the part of an added token has no chunk."""
        out = []
        for i, part in enumerate(self.bpe.parts(text)):
            s = "" if i % 2 else self.bpe.normal(part)
            out += [(i, s[max(0, j - BEFORE) : j], s[j : j + size]) for j in range(0, len(s), size)] if s else [(i, "", "")]
        return out

    def count(self, text: str) -> int:
        """Tokens of a text, read from end to end."""
        total = 0
        for i, part in enumerate(self.bpe.parts(text)):
            if i % 2:
                total += 1
            else:
                total += sum(map(self.unit.__getitem__, self.bpe.units(self.bpe.normal(part))))
        return total

    def count_chunks(self, maps: list[tuple[int, StateMap | None]]) -> int:
        """Tokens of a text by (part, map) of its chunks in order."""
        parts: dict[int, list[StateMap]] = {}
        for part, m in maps:
            if part % 2 == 0 and m is not None:
                parts.setdefault(part, []).append(m)
        return sum(map(self.total, parts.values())) + len({part for part, _ in maps if part % 2})


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_long(rows: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of rows (doc_id, n_bytes, text): chunks are mapped apart from each other and composed for each text."""
    kind = ddl(rows, "doc_id")

    def cut(batches):
        chunks = counter(path).chunks
        for b in batches:
            for i in range(b.num_rows):
                own = b.slice(i, 1)
                found = chunks(own.column("text")[0].as_py(), size)
                for at in range(0, len(found), 16):
                    few = found[at : at + 16]
                    repeated = [own.column(c).take(pa.array([0] * len(few))) for c in ("row", "doc_id", "n_bytes")]
                    columns = [pa.array([f[0] for f in few], pa.int32()), pa.array(range(at, at + len(few)), pa.int64()), *(pa.array([f[k] for f in few], pa.string()) for k in (1, 2))]
                    yield pa.RecordBatch.from_arrays([*repeated, *columns], ["row", "doc_id", "n_bytes", "part", "place", "before", "chunk"])

    def mapped(batches):
        c = counter(path)
        for b in batches:
            found = [pickle.dumps(c.chunk_map(x, y)) if x else None for x, y in zip(b.column("chunk").to_pylist(), b.column("before").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("row", "doc_id", "n_bytes", "part", "place")), pa.array(found, pa.binary())], ["row", "doc_id", "n_bytes", "part", "place", "map"])

    def composed(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        maps = [(p, m and pickle.loads(m)) for p, m in zip(t["part"].to_pylist(), t["map"].to_pylist(), strict=True)]
        return t.slice(0, 1).select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array([counter(path).count_chunks(maps)], pa.int64()))

    own = f"row long, doc_id {kind}, n_bytes long, part int, place long"
    chunks = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, own + ", before string, chunk string")
    maps = chunks.repartition("row", "place").mapInArrow(mapped, own + ", map binary")
    return maps.groupBy("row").applyInArrow(composed, f"doc_id {kind}, n_bytes long, n_tokens long")


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; only texts beyond long_bytes are shuffled."""

    def run(batches):
        count = counter(path).count
        for b in batches:
            n = pa.array([count(t) for t in strings(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"), whole(text_col).alias("text"))
    short = rows.where(F.col("n_bytes") <= long_bytes).mapInArrow(run, f"doc_id {ddl(df, id_col)}, n_bytes long, n_tokens long")
    both = short.unionByName(count_long(rows.where(F.col("n_bytes") > long_bytes), path, chunk))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
