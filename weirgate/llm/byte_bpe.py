"""Encoding of texts by a byte-level BPE vocabulary in linear time.

Bytes are mapped to Latin-1 for an Aho-Corasick automaton over the vocabulary. The longest matches from left to right
are BPE's result wherever every two neighbours are *compatible*, which is: BPE of their joined bytes gives just these
two. Compatibility is memoised by token pair. Where a pair fails, the search backs up to shorter tokens, and positions
from which no tokenisation goes on are remembered, so the work stays linear.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weirgate.functions.tokens import byte_ranks


class ByteBPE:
    """``ranks``: token bytes -> id, ids in the order of the merges; ``pattern`` splits a text before encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 200_000):
        self.split = regex.compile(pattern).findall
        self.memo_size, self.memo = memo, {}
        self.pieces = {i: t.decode("latin-1") for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.ids = {t: i for i, t in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in self.pieces.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None) for i, t in self.pieces.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.pieces):
            if self.length[i] > 1:
                pair = self._last_merge(i)
                self.halves[i] = pair
                if pair[0] != i:
                    self.merged[pair] = i
        self.fits: dict[int, bool] = {}

    def _last_merge(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``, found by merging its bytes in order of rank up to two parts."""
        parts = [self.ids[c] for c in self.pieces[token]]
        while len(parts) > 2:
            best = min(((self.merged.get(p, token), k) for k, p in enumerate(zip(parts, parts[1:]))), default=(token, 0))
            if best[0] >= token:
                return token, token  # no merge leads to it: BPE never makes it from longer input
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges of both tokens from the last to the first; the seam must never offer an earlier merge."""
        limit = 1 << 30
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit = left
                left = self.halves[left][1] if left in self.halves else left
                if left != limit:
                    continue
                limit = right + 1
                right = self.halves[right][0] if right in self.halves else right
                if right + 1 == limit:
                    return True
            else:
                limit = right + 1
                right = self.halves[right][0] if right in self.halves else right
                if right + 1 != limit:
                    continue
                limit = left
                left = self.halves[left][1] if left in self.halves else left
                if left == limit:
                    return True

    def longest(self, s: str, at: int) -> int:
        return next(self.automaton.iter_long(s, at))[1]

    def encode_piece(self, s: str) -> list[int]:
        """Ids of one piece given as Latin-1."""
        known = self.ids.get(s)
        if known is not None:
            return [known]
        greedy = [t for _, t in self.automaton.iter_long(s)]
        fits, slow = self.fits.get, self.compatible
        left = greedy[0]
        for right in greedy[1:]:
            ok = fits(left << 20 | right)
            if ok is None:
                ok = slow(left, right)
            if not ok:
                return self._search(s)
            left = right
        return greedy

    def _search(self, s: str) -> list[int]:
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, token = 0, self.longest(s, 0)
        while True:
            end = at + self.length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = self.longest(s, at)
            elif self.shorter[token] is not None:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= 64:  # longer ones hardly come back
                    if len(memo) >= self.memo_size:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(byte_ranks(path), pattern)


def encode_documents(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """key, ids: the token ids of every text, without special tokens.

    Null and empty texts have an empty list; a blank text has the ids of its blanks. Nothing is normalised or cut.
    Repeated keys come out as often as they occur; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            encode = byte_bpe(path, pattern).encode
            rows = [np.array(encode(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
