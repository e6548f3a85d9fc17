"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

Offline it is proved, by running the merges of each vocabulary string once, which
strings encode alone as one token. A pre-token that is such a string counts one
without any merging; the others go through the library's merges. A word with the
space before it stands between sure pre-token boundaries, so its count depends on
nothing else and is remembered in a table of bounded size.

Cases: null and empty texts have 0 bytes and 0 tokens; the library's special strings
inside a text count as it counts them (one token each); repeated rows are counted
each; null ids are kept; a text of any length is counted whole."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from .common import map_texts, utf8

LIMIT = 512
#: Entries of the table of remembered counts in one task.
REMEMBERED = 1_000_000
# White space as the tokenizer's pattern language defines it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The split pattern of the vocabulary (fixed value), with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes
    of Latin-1 stand for themselves, the rest for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the tokenizer of a byte-level vocabulary file does."""

    def __init__(self, path: str, whole: frozenset[str] | None = None, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        if told["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space")
        self.special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.model = Tokenizer.from_file(path).model
        self.letters = [byte_letters()[b] for b in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.odd_space = re.compile(f"[{SPACE}] | [{SPACE}]").search
        self.at_space = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])").split
        self.whole = self._prove(told["model"]["vocab"]) if whole is None else whole
        self.limit, self.known = remembered, {}

    def _prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and whose merges end in one token."""
        byte = {c: b for b, c in byte_letters().items()}
        out = []
        for entry in vocabulary:
            try:
                text = bytes(byte[c] for c in entry).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.find(text) == [text] and len(self.model.tokenize(entry)) == 1:
                out.append(text)
        return frozenset(out)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a piece of text that begins and ends at sure boundaries."""
        n = 0
        for piece in self.find(chunk):
            if piece in self.whole:
                n += 1
            else:
                n += len(self.model.tokenize("".join([self.letters[b] for b in piece.encode("utf-8")])))
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings. A single space between two
        other characters always begins a pre-token."""
        parts = self.at_space(text) if self.odd_space(text) else text.split(" ")
        if len(self.known) > self.limit:
            self.known.clear()
        known, n = self.known, 0
        if parts[0]:
            n += self._chunk(parts[0])
        # A first or last part that is empty is white space at the text's edge.
        if len(parts) > 1 and not parts[0]:
            return self._chunk(text) if len(parts) == 2 else self._chunk(" " + parts[1]) + self._rest(parts[2:], known)
        return n + self._rest(parts[1:], known)

    def _rest(self, parts: list[str], known: dict[str, int]) -> int:
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            n = 0
            for part in parts:
                found = known.get(part)
                if found is None:
                    found = known[part] = self._chunk(" " + part)
                n += found
            return n

    def count(self, text: str) -> int:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text) if text else 0
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit); no shuffle. The proved strings,
    at most as many as the vocabulary has, are sent to the tasks."""
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    whole = docs.sparkSession.sparkContext.broadcast(Counter(path).whole)

    def make() -> Callable[[list], list]:
        counter = Counter(path, whole.value)

        def work(texts: list) -> list:
            texts = [t or "" for t in texts]
            tokens = [counter.count(t) for t in texts]
            return [[len(t) if t.isascii() else len(utf8(t)) for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return map_texts(docs, [doc_id], fields, make, text)
