"""Byte-level BPE by backtracking, without running merges.

An Aho-Corasick automaton finds the longest vocabulary token at every place of a piece. The encoder walks from left to
right and appends a token only if BPE would keep the border to the token before it (the pair-compatibility check, kept in
a table). If no prefix of the longest token fits, the last token is taken back and its place is marked as a dead end, so each
place is left at most once. What comes out is exactly what the merges would give.

Decoding is one gather over the vocabulary's bytes through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trafficloom.llm.texts import emitted, narrow, rows_of

# Fixed value: the split before merging that byte-level vocabularies of this kind use.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")
CACHED = 400_000
CACHED_BORDERS = 1_000_000
CACHED_CHARS = 64
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Cache(dict):
    """Results by text; emptied when full, so that memory stays bounded on any input."""

    def __init__(self, make, limit: int = CACHED) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Tokens are numbered by merge rank inside: 0 to 255 are the bytes, 256 + r is what merge r makes."""

    def __init__(self, path: str, ordinary_specials: bool = False) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, letters = spec["model"]["vocab"], _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rank_of = {letter: b for letter, b in letters.items()}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        names = [""] * 256
        for letter, b in letters.items():
            names[b] = letter
        for left, right in merges:
            pair = (rank_of[left], rank_of[right])
            self.merged[pair] = rank_of[left + right] = len(names)
            self.halves.append(pair)
            names.append(left + right)
        self.tokens = [bytes(letters[c] for c in name) for name in names]
        self.lengths = [len(t) for t in self.tokens]
        self.longest = max(self.lengths)
        self.ids = np.array([vocabulary[n] for n in names], dtype="<u4")
        known = {t: i for i, t in enumerate(self.tokens)}
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in known.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.packed_ids = [i.tobytes() for i in self.ids]
        self.borders = _Cache(self.keeps_border, CACHED_BORDERS)
        self.specials = {} if ordinary_specials else {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.spaced = _Cache(lambda item: b"".join(map(self.pieces.__getitem__, PIECES.findall(" " + item))))
        self.chunks = _Cache(lambda chunk: b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk))))
        self.pieces = _Cache(self._packed)
        by_id = {int(i): t for i, t in zip(self.ids, self.tokens, strict=True)}
        by_id |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def keeps_border(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the border between two tokens: their merges are undone, the latest first; no pair across the
        border may be due before the merge that was undone."""
        left, right = pair
        due = len(self.tokens)
        while True:
            if self.merged.get((left, right), due) < due:
                return False
            if max(left, right) < 256:
                return True
            if left > right:
                due, left = left, self.halves[left][1]
            else:
                # the same merge further left comes first, so an equal rank counts as well
                due, right = right + 1, self.halves[right][0]

    def _packed(self, piece: str) -> bytes:
        """Ids of one piece. The longest matches one after the other are its tokens wherever all their borders stand."""
        raw = piece.encode().decode("latin-1")
        out = [rank for _, rank in self.automaton.iter_long(raw)]
        if not all(map(self.borders.__getitem__, pairwise(out))):
            out = self.piece(raw)
        return b"".join(map(self.packed_ids.__getitem__, out))

    def piece(self, text: str) -> list[int]:
        """Ranks of the tokens of one piece, given as one letter per byte."""
        size, lengths, borders, shorter, matches = len(text), self.lengths, self.borders, self.shorter, self.automaton.iter_long
        longest = self.longest
        out: list[int] = []
        dead: set[int] = set()
        at, token, before = 0, -1, -1
        while at < size:
            if token < 0:
                # of a long piece the automaton only gets what a token can cover
                token = next(matches(text[at : at + longest]))[1]
            while token >= 0:
                end = at + lengths[token]
                if end not in dead and (before < 0 or borders[before, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before, token = end, token, -1
            else:
                dead.add(at)
                last = out.pop()
                at -= lengths[last]
                # a dead place is never entered again, so the same token is not taken twice
                before, token = out[-1] if out else -1, last
        return out

    def _plain(self, text: str) -> bytes:
        rare = _RARE_SPACE.search(text)
        joint = text.endswith(" ") or any(s in text for s in ("   ", "  \n", "\n  ", "\n \n"))
        if rare is None and not joint:
            # a single space only ever joins what follows, so the items between spaces are independent
            first, *rest = text.split(" ")
            return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))
        if _CONTROL_SPACE.search(text) is None:
            return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(text)))
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.special_split is None or self.special_split.search(text) is None:
            return np.frombuffer(self._plain(text), dtype="<u4")
        out = []
        for part in self.special_split.split(text):
            known = self.specials.get(part)
            out.append(self._plain(part) if known is None else np.array([known], dtype="<u4").tobytes())
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        shift = self.offsets[ids] - (np.cumsum(sizes) - sizes)
        return self.blob[np.arange(total) + np.repeat(shift, sizes)].tobytes()


@cache
def codec(path: str, ordinary_specials: bool = False) -> Codec:
    """One per worker process."""
    return Codec(path, ordinary_specials)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of `docs`: every whole text encoded and decoded.

    Null text is empty: no tokens, the digests of nothing. A special token's string inside a text is that token. Null ids,
    repeated rows and other columns do no harm; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = bpe.encode(text.decode())
                decoded = hashlib.sha256(bpe.decode(ids)).hexdigest()
                yield doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), decoded

        return emitted(_RESULT, rows())

    return narrow(docs, id_col, text_col).mapInArrow(run, _RESULT)
