"""The vocabulary of a word-end BPE in a tokenizers .json file, and its way from a text to pre-tokens.

A text is cut at the literal strings of the added tokens, each part is normalised (NFC, white space, lower case) and cut at white space
into units, and a unit into pre-tokens. Pre-tokens are written one character a byte (Latin-1); END stands for the word end.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

END = "Ā"
#: Fixed value: the split pattern of the vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: str.split() also splits at these, which are no white space to the vocabulary's patterns.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")
#: Beyond these characters the libraries' Unicode tables may differ in age; there the vocabulary's own components decide.
FAR = regex.compile(r"[^\x00-\u024f]")
#: No byte of UTF-8.
END_BYTE = b"\xff"


def printable_bytes() -> dict[str, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = printable_bytes()

        def symbol(token: str) -> str:
            body, end = (token[:-4], END) if token.endswith("</w>") and len(token) > 4 else (token, "")
            return "".join(as_byte[c] for c in body) + end

        self.ids = {symbol(t): i for t, i in spec["model"]["vocab"].items()}
        self.strings = {i: t for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.added.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.as_byte = library.normalizer, library.pre_tokenizer, str.maketrans(as_byte)
        # For the merge routine the word end is a byte of its own, which joins the byte before it ahead of all other merges.
        order = [chr(b) for b in range(256) if chr(b) != "ÿ"] + ["ÿ"] + [chr(b) + END for b in range(255)] + [symbol(a) + symbol(b) for a, b in spec["model"]["merges"]]
        coded = {self.coded(t): r for r, t in reversed(list(enumerate(order)))}
        self.numbered = [b""] * len(order)
        for b, r in coded.items():
            self.numbered[r] = b
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=coded, special_tokens={})._core_bpe
        self.symbols = [b.replace(END_BYTE, b"").decode("latin-1") + (END if b.endswith(END_BYTE) else "") for b in self.numbered]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def parts(self, text: str) -> list[str]:
        """Parts in order; every second one, from index 1, is the string of an added token."""
        return self.special.split(text) if self.special and any(t in text for t in self.added) else [text]

    @staticmethod
    def coded(symbol: str) -> bytes:
        return symbol.replace(END, "").encode("latin-1") + (END_BYTE if symbol.endswith(END) else b"")

    def normal(self, part: str) -> str:
        if part.isascii():
            return part.lower()
        if FAR.search(part):
            return self.normalizer.normalize_str(part)
        return unicodedata.normalize("NFC", part).lower()

    @staticmethod
    def units(normal: str) -> list[str]:
        return normal.split() if not SEPARATORS.search(normal) else [u for u in SPACES.split(normal) if u]

    def pretokens(self, unit: str) -> list[str]:
        if FAR.search(unit):
            return [w.translate(self.as_byte) for w, _ in self.splitter.pre_tokenize_str(unit)]
        words = [unit] if unit.isalpha() else [unit[:-1], unit[-1]] if unit[-1] in ".," and unit[:-1].isalpha() else PRETOKEN.findall(unit)
        return [w.encode().decode("latin-1") for w in words]

    def merge(self, text: str) -> list[str]:
        """The tokens of a pre-token or of a fragment: the merge of least rank first, until none is left."""
        return list(map(self.symbols.__getitem__, self.core.encode_single_piece(self.coded(text))))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
