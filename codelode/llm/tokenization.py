"""Encoding and decoding with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes that is determinised lazily. It
rests on a property of BPE: of a text's canonical encoding every prefix of tokens is canonical too,
so each prefix of bytes has exactly one *last token*, and whether token t may follow token s depends
on s and t alone. A state therefore is the list of earlier positions that a token may still begin
at: for each the trie node that the bytes since then have reached and the last token there. Reading
a byte moves every node, finds the one token that ends here and may follow, and yields the next
state; transitions are remembered, so common byte strings cost one look-up a byte. A token is
emitted when all positions that are still open agree on it, at most one longest token later.

Vocabulary files are read from a path on each executor; they are never part of this package.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: Memory bounds of one worker, in entries; a full memory is emptied and filled again.
MAX_STATES, MAX_WORDS = 400_000, 200_000

# The vocabulary's own pre-tokenisation pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The encoder of one vocabulary; ``encode`` gives a text's ids, ``decode_stream`` the text again."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = _byte_letters()
        # Tokens with other letters are special ones; no text encodes to them.
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (self.id_of[bytes(letters[c] for c in x)] for x in (left, right))
            whole = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merged.setdefault((a, b), r)
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = r, (a, b)
        self._trie()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pattern = regex.compile(PATTERN)
        self._forget()

    def _trie(self) -> None:
        """Nodes are numbers; ``next_node[node][byte]``, ``token_at[node]`` (-1: none)."""
        self.next_node: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        canonical = set(self.rank)
        for i, b in self.bytes_of.items():
            if len(b) > 1 and i not in canonical:
                continue  # e.g. special tokens: no merge makes them
            node = 0
            for x in b:
                if x not in self.next_node[node]:
                    self.next_node[node][x] = len(self.token_at)
                    self.next_node.append({})
                    self.token_at.append(-1)
                node = self.next_node[node][x]
            self.token_at[node] = i

    def _forget(self) -> None:
        self._states: dict[tuple, int] = {}
        self._state: list[tuple] = []
        self._moves: list[dict[int, int]] = []
        self._emits: list[dict[int, tuple[int, ...]]] = []
        self._words: dict[str, tuple[int, ...]] = {}
        self._number((-1, ((0, ()),)))

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE would leave the two tokens as they are, side by side.

        Undo both tokens' merges from the latest to the earliest. At each step the pieces that touch
        at the seam are known; had they a merge earlier than those still to be undone, BPE would have
        joined them first.
        """
        key = (left, right)
        if (known := self._pairs.get(key)) is not None:
            return known
        last = len(self.merged)
        a, b, limit, result = left, right, last, True
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < limit:
                result = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Of equal merges the left one happens first, so the right one is undone first.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        self._pairs[key] = result
        return result

    def _number(self, state: tuple) -> int:
        n = self._states.get(state)
        if n is None:
            n = self._states[state] = len(self._state)
            self._state.append(state)
            self._moves.append({})
            self._emits.append({})
        return n

    def _advance(self, state: int, byte: int) -> int:
        """Computes and remembers the move from ``state`` by ``byte``, and the tokens that are certain then.

        A state is the last emitted token (-1: none) and, for each open position, the trie node since
        then and the tokens of its own canonical encoding that aren't emitted yet.
        """
        context, positions = self._state[state]
        ended: tuple[int, ...] | None = None
        still = []
        for node, path in positions:
            nxt = self.next_node[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if ended is None and token >= 0:
                last = path[-1] if path else context
                if last < 0 or self.may_follow(last, token):
                    ended = (*path, token)
            if self.next_node[nxt]:
                still.append((nxt, path))
        assert ended is not None, "a vocabulary without all single bytes"
        still.append((0, ended))
        common, shortest = 0, min(len(p) for _, p in still)
        while common < shortest and all(p[common] == ended[common] for _, p in still):
            common += 1
        if common:
            context, still = ended[common - 1], [(n, p[common:]) for n, p in still]
        nxt = self._number((context, tuple(still)))
        self._moves[state][byte] = nxt
        self._emits[state][byte] = ended[:common]
        return nxt

    def _run(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        out: list[int] = []
        state = 0
        for byte in data:
            if len(self._state) > MAX_STATES:
                here = self._state[state]
                self._forget()
                state = self._number(here)
            nxt = self._moves[state].get(byte)
            if nxt is None:
                nxt = self._advance(state, byte)
            if emitted := self._emits[state][byte]:
                out += emitted
            state = nxt
        # At the end the position just reached is the one that counts; its path is what remains.
        out += self._state[state][1][-1][1]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty or missing text has none."""
        if not text:
            return []
        out: list[int] = []
        for word in self._pattern.findall(text):
            ids = self._words.get(word)
            if ids is None:
                ids = self._run(word.encode("utf-8", errors="replace"))
                if len(word) <= 64:
                    if len(self._words) >= MAX_WORDS:
                        self._words.clear()
                    self._words[word] = ids
            out += ids
        return out

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """The text of a stream of ids, piece by piece; a character is given out when its last byte has come."""
        decoder = Utf8Stream()
        for i in ids:
            if piece := decoder.feed(self.bytes_of[i]):
                yield piece
        if piece := decoder.close():
            yield piece

    def decode(self, ids: list[int] | None) -> str:
        return "".join(self.decode_stream(iter(ids if ids is not None else ())))


class Utf8Stream:
    """An incremental UTF-8 state machine: how many bytes a character still needs, and which are allowed next."""

    def __init__(self) -> None:
        self._code, self._need, self._low, self._high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self._need:
                if self._low <= b <= self._high:
                    self._code, self._need = self._code << 6 | b & 0x3F, self._need - 1
                    self._low, self._high = 0x80, 0xBF
                    if not self._need:
                        out.append(chr(self._code))
                    continue
                out.append("�")
                self._need, self._low, self._high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self._code, self._need = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self._code, self._need = b & 0x0F, 2
                self._low, self._high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self._code, self._need = b & 0x07, 3
                self._low, self._high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self._need = ("�" if self._need else ""), 0
        return rest


@cache
def transducer(path: str) -> Transducer:
    """One encoder for each worker and vocabulary; its memory serves all of the worker's batches."""
    return Transducer(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def token_ids(text: Column, path: str | None = None) -> Column:
    """``text``'s ids as an array of integers, without special tokens; null and empty texts give an empty array.

    The strings of special tokens in a text are ordinary text.
    """
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series([t.encode(x) for x in texts])

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null and empty arrays give an empty text."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series([t.decode(x) for x in values])

    return decode(ids)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): one row per key. A key that is repeated is encoded once, by its greatest text."""
    one = df.groupBy(key).agg(F.max(text).alias("__text"))
    return one.select(key, token_ids(F.col("__text"), path).alias("ids"))
