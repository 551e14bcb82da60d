"""Token budgets: how many tokens texts hold under an existing vocabulary, summed by slice.

The pieces of a public vocabulary and their ranks make a unigram model: the log-probability of a piece falls with the
logarithm of its rank. The pieces lie in a double-array trie; the trie and the count-only Viterbi search run over all
segments of a batch at once in numpy. A character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.sources.tables import domain_name, language_name, one_per_key, source_file

#: Characters worked on at once.
CHUNK = 200_000
#: Added to ranks before the logarithm; log-probability of one byte of a character that is no piece.
RANK_SHIFT, BYTE_SCORE = 40.0, -25.0


@dataclass
class DoubleArray:
    """next state = base[state] + code, valid where check[next] == state."""

    code: np.ndarray  # code point -> 1, 2, ...; 0 where no piece has it
    base: np.ndarray
    check: np.ndarray
    score: np.ndarray  # by state; -inf where no piece ends
    longest: int
    joint: str  # the characters that occur within longer pieces; no piece joins any other to its neighbours

    @classmethod
    def build(cls, pieces: dict[str, float]) -> DoubleArray:
        letters = sorted({c for p in pieces for c in p})
        code = np.zeros(0x110000, np.int32)
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        tree: dict = {}
        for p, s in pieces.items():
            node = tree
            for c in p:
                node = node.setdefault(int(code[ord(c)]), {})
            node[0] = s
        size = 1 << 20
        base, check, score = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -np.inf, np.float32)
        taken = np.zeros(size, bool)
        taken[0] = True
        first, queue = 1, [(0, tree)]
        for state, node in queue:
            score[state] = node.get(0, -np.inf)
            keys = np.array(sorted(k for k in node if k), np.int64)
            if not len(keys):
                continue
            if first + 4 * len(letters) > len(taken):
                more = len(taken)
                taken, base, check, score = np.concatenate([taken, np.zeros(more, bool)]), np.concatenate([base, np.zeros(more, np.int32)]), np.concatenate([check, np.full(more, -1, np.int32)]), np.concatenate([score, np.full(more, -np.inf, np.float32)])
            first += int(np.argmin(taken[first:]))
            at, width = first, 64
            while True:  # the first base under which every letter finds a free place
                b = at + np.flatnonzero(~taken[at : at + width]) - keys[0]
                b = b[b >= 1]
                fit = b[~taken[b[:, None] + keys].any(axis=1)] if len(b) else b
                if len(fit):
                    b = int(fit[0])
                    break
                at, width = at + width, min(width * 2, 4096)
            base[state] = b
            taken[b + keys] = True
            check[b + keys] = state
            queue += [(b + int(k), node[int(k)]) for k in keys]
        room = int(np.flatnonzero(taken)[-1]) + len(letters) + 2
        grown = max(0, room - len(base))
        cut = lambda a, fill: np.concatenate([a, np.full(grown, fill, a.dtype)])[:room].copy()
        return cls(code, cut(base, 0), cut(check, -1), cut(score, -np.inf), max(map(len, pieces)), "".join(sorted({c for p in pieces if len(p) > 1 for c in p})))

    def counts(self, segments: list[str]) -> np.ndarray:
        """Pieces on the best path through each segment."""
        out = np.zeros(len(segments), np.int64)
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        at = 0
        while at < len(order):
            end, total = at, 0
            while end < len(order) and (end == at or total + len(segments[order[end]]) <= CHUNK):
                total += len(segments[order[end]]) + 1
                end += 1
            take = order[at:end]
            out[take] = self._chunk([segments[i] for i in take])
            at = end
        return out

    def _chunk(self, segments: list[str]) -> np.ndarray:
        """``segments`` by falling length. Between two lies a position that no piece can cross."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        points = np.frombuffer(("\x00".join(segments) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        codes[starts + lengths] = 0
        n = len(points)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        place, state = np.flatnonzero(codes), np.zeros(0, np.int32)
        state = np.zeros(len(place), np.int32)
        for k in range(self.longest):
            c = codes[place + k] if len(place) else codes[:0]
            some = c > 0
            place, c, state = place[some], c[some], state[some]
            to = self.base[state] + c
            some = self.check[to] == state
            place, state = place[some], to[some]
            if not len(place):
                break
            ends = np.isfinite(self.score[state])
            row = np.full(n, -np.inf, np.float32)
            row[place[ends]] = self.score[state[ends]]
            edges.append((row, None))
        width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        lone = np.isfinite(edges[0][0]) if edges else np.zeros(n, bool)
        best, count = np.full(n + self.longest + 1, -np.inf, np.float32), np.zeros(n + self.longest + 1, np.int32)
        best[starts] = 0.0
        live = len(segments)
        rows = [r for r, _ in edges]
        for j in range(int(lengths[0]) if len(lengths) else 0):
            while live and lengths[live - 1] <= j:
                live -= 1
            here = starts[:live] + j
            so_far, number = best[here], count[here]
            raw = ~lone[here]
            if raw.any():  # bytes of a character that is no piece
                h = here[raw]
                value = so_far[raw] + BYTE_SCORE * width[h]
                better = value > best[h + 1]
                best[h[better] + 1], count[h[better] + 1] = value[better], number[raw][better] + width[h[better]]
            for k, row in enumerate(rows, 1):
                value = so_far + row[here]
                better = value > best[here + k]
                if better.any():
                    h = here[better]
                    best[h + k], count[h + k] = value[better], number[better] + 1
        return count[starts + lengths]


def unigram_pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability from the ranks of a SentencePiece vocabulary file; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -float(np.log(i + RANK_SHIFT)) - np.float64(np.log(np.log(len(names)))) for i, p in enumerate(names)}


_SEGMENT = re.compile("▁*[^▁]+|▁+")
#: Segments longer than this are cut further, around characters that no longer piece holds.
LONG = 48


def segments_of(text: str, cut: re.Pattern) -> list[str]:
    """The stretches of a text that no token crosses: a dummy blank before it, blanks as ``▁`` at the start of words."""
    out: list[str] = []
    for s in _SEGMENT.findall("▁" + text.replace(" ", "▁")):
        if len(s) <= LONG:
            out.append(s)
        else:
            out += cut.findall(s)
    return out


def cutter(trie: DoubleArray) -> re.Pattern:
    """Stretches of characters that occur within longer pieces, and of all others (each of those is a piece of its own)."""
    joint = f"[{re.escape(trie.joint)}]"
    return re.compile(f"{joint}+|(?:(?!{joint}).){{1,{LONG}}}", re.S)


def estimated_tokens(text: Column, trie) -> Column:
    """Estimated number of tokens of each text; null and empty texts have 0. ``trie``: a broadcast DoubleArray."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        number: dict[str, int] = {}
        cut = cutter(trie.value)
        per_text = [[number.setdefault(s, len(number)) for s in segments_of(t, cut)] if t else [] for t in texts]
        sizes = trie.value.counts(list(number))
        return pd.Series([int(sizes[i].sum()) if i else 0 for i in per_text], dtype="int64")

    return count(text)


def token_budget(rows: DataFrame, vocabulary: str) -> DataFrame:
    """source, lang, domain, n_docs, n_empty, n_tokens of the instructions of ``rows``, each slice named in one way.

    Rows delivered again (same row_id) count once. Missing sources, languages and domains are ``unknown``; null and
    empty instructions hold 0 tokens and are counted in ``n_empty``; rows without a row_id are left out, as they cannot
    be told from others delivered again; an empty table has no slices. Other columns are
    ignored. The counts are combined by slice before the shuffle, so that a slice with a third of all rows does no harm.
    """
    trie = rows.sparkSession.sparkContext.broadcast(DoubleArray.build(unigram_pieces(vocabulary)))
    sized = rows.where("row_id is not null").select(
        "row_id",
        source_file(F.col("source")).alias("source"),
        language_name(F.col("lang")).alias("lang"),
        domain_name(F.col("domain")).alias("domain"),
        estimated_tokens(F.col("instruction"), trie).alias("n_tokens"),
        (F.coalesce(F.length("instruction"), F.lit(0)) == 0).cast("int").alias("empty"),
    )
    once = one_per_key(sized, "row_id", "source", "lang", "domain", "n_tokens", "empty")
    return once.groupBy("source", "lang", "domain").agg(F.count("*").alias("n_docs"), F.sum("empty").alias("n_empty"), F.sum("n_tokens").alias("n_tokens"))
