"""Passages of held-out items inside a training corpus.

Texts and items are reduced to letters and digits in one case and width. A leaked passage is a stretch that holds at
least half of an item. Every such stretch contains a whole window on a fixed grid of the text, so it is enough to look
up grid windows among the items' windows at every offset. Items are indexed in groups of like length, each with a
window, a grid and hashes of its own. The lookup is approximate and the decision exact:

* the CGK random-walk embedding maps a window to a longer string, edit distance to Hamming distance: a pointer walks
  over the window and, by shared random bits of step and character, stays or moves on;
* bit-sampling LSH hashes a random subset of the embedding's positions. How often windows ``max_edits`` apart collide is
  measured when an index is built, and the sampling repeated until the target recall is met;
* windows that collide are verified by banded edit distance, and the items behind them on the text around: by the longest
  common stretch (``unbroken``) or by the edit distance of item-sized stretches.

Items are shared with the executors in blocks of a fixed size; the corpus is read once a block and never shuffled.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest window of letters; items of a block, which bounds what is shared at once; characters embedded at once.
WINDOW, BLOCK, CHUNK = 16, 5000, 400_000
#: Positions that a hash samples, the recall that repetitions must reach, pairs of windows it is measured on, most repetitions.
SAMPLED, RECALL, TRIALS, MOST_ROUNDS = 5, 0.98, 2000, 64
#: Least letters of a passage from which groups of items start. Longer items share the last group.
GROUPS = (1, 2, 4, 8, 16)


@lru_cache(maxsize=1)
def plain_code_points() -> np.ndarray:
    """Code point -> its lower-case narrow letter or digit, 0 for everything that is neither."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.decomposition(c)
        if kind.startswith(("<wide>", "<narrow>")):
            narrow = unicodedata.normalize("NFKC", c)
            c = narrow if len(narrow) == 1 else c
        low = c.lower()
        c = low if len(low) == 1 else c
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            out[cp] = ord(c)
    return out


def plain(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = plain_code_points()[points]
    return kept[kept > 0]


class WindowHash:
    """Hashes of sampled CGK embeddings of windows; the same for every process with the same seed.

    Each step of a walk reads the character under the pointer and moves on by a random bit of step and character, so two
    steps a character reach the end of the window on average. With no edits one round of all positions is enough: equal
    windows have equal embeddings.
    """

    def __init__(self, window: int, edits: int, recall: float = RECALL, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window, self.length, self.edits = window, 2 * window, edits
        most = MOST_ROUNDS if edits else 1
        self.walks = rng.integers(1, 1 << 62, (most, self.length), dtype=np.uint64) | np.uint64(1)
        sampled = min(SAMPLED, self.length) if edits else self.length
        self.kept = [np.sort(rng.choice(self.length, sampled, replace=False)) for _ in range(most)]
        self.rounds = self._rounds(recall, rng) if edits else 1

    def _rounds(self, recall: float, rng: np.random.Generator) -> int:
        """The least number of rounds after which the target share of random windows ``edits`` apart has collided."""
        a = rng.integers(1, 1 << 16, (TRIALS, self.window + self.edits)).astype(np.uint32)
        b = a.copy()
        for row in b:
            for _ in range(self.edits):
                at, kind = rng.integers(self.window), rng.integers(3)
                if kind == 0:
                    row[at] = rng.integers(1, 1 << 16)
                elif kind == 1:
                    row[at:-1] = row[at + 1 :].copy()
                else:
                    row[at + 1 :], row[at] = row[at:-1].copy(), rng.integers(1, 1 << 16)
        starts = np.arange(TRIALS) * (self.window + self.edits)
        met = np.zeros(TRIALS, bool)
        for r in range(len(self.walks)):
            met |= self(mixed(a.ravel()), starts, r) == self(mixed(b.ravel()), starts, r)
            if met.mean() >= recall:
                return r + 1
        return len(self.walks)

    def __call__(self, characters: np.ndarray, starts: np.ndarray, round_: int) -> np.ndarray:
        """One hash for the window at each start of ``mixed`` characters. A pointer past the window's end reads 0."""
        at, end = starts.copy(), starts + self.window
        total = np.zeros(len(starts), np.uint64)
        kept, last = set(self.kept[round_].tolist()), int(self.kept[round_][-1])
        padded = np.append(characters, np.uint64(0))
        for step in range(last + 1):
            bits = padded[np.where(at < end, at, len(characters))] * self.walks[round_, step]
            if step in kept:
                total = (total ^ (bits >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step)
            at += (bits >> np.uint64(63)).astype(np.int64)
        return total ^ (total >> np.uint64(31))


def mixed(points: np.ndarray) -> np.ndarray:
    """Characters as spread 64-bit numbers."""
    out = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def within_edits(window: str, text: str, limit: int) -> bool:
    """Whether some stretch of ``text`` lies within ``limit`` edits of ``window`` (Sellers' algorithm)."""
    column = list(range(len(window) + 1))
    for c in ["", *text]:
        if c:
            last, column[0] = column[0], 0
            for i, w in enumerate(window, 1):
                last, column[i] = column[i], min(last + (w != c), column[i] + 1, column[i - 1] + 1)
        if column[-1] <= limit:
            return True
    return False


def edits_apart(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """For each row whether ``a`` lies within ``limit`` edits of some beginning of ``b`` (a band of the edit table, all rows at once).

    ``b`` has ``limit`` columns more than ``a``.
    """
    rows, n = a.shape
    far = limit + 1
    band = np.full((rows, 2 * limit + 1), far, np.int16)  # column d: b has been read d - limit characters further than a
    band[:, limit:] = np.arange(limit + 1)
    for i in range(n):
        new = np.full_like(band, far)
        for d in range(2 * limit + 1):
            j = i + d - limit
            if 0 <= j < b.shape[1]:
                new[:, d] = band[:, d] + (a[:, i] != b[:, j])
            if j == -1:
                new[:, d] = i + 1
            if d < 2 * limit:
                np.minimum(new[:, d], band[:, d + 1] + 1, out=new[:, d])
            if d and j >= 0:
                np.minimum(new[:, d], new[:, d - 1] + 1, out=new[:, d])
        band = new
    return band.min(1) <= limit


class _Group:
    """The windows of items of like length by hash."""

    def __init__(self, items: list[int], lengths: np.ndarray, bases: np.ndarray, points: np.ndarray, shortest: int, edits: int):
        self.window = max(1, min(WINDOW, (shortest + 1) // 2))
        # a stretch may lose as many letters as there are edits, and must still hold a whole window of the grid
        self.stride = max(1, shortest - edits - self.window + 1)
        self.edits = edits if self.window > 2 * edits else 0
        self.hash = WindowHash(self.window, self.edits)
        self.items, self.longest = len(lengths), int(lengths.max())
        whole = [i for i in items if lengths[i] >= self.window]
        count = [lengths[i] - self.window + 1 for i in whole]
        owner = np.repeat(np.array(whole, np.int64), count)
        offset = np.concatenate([np.arange(c) for c in count]) if count else np.empty(0, np.int64)
        characters = mixed(points)
        self.buckets = []
        for r in range(self.hash.rounds):
            k = self.hash(characters, bases[owner] + offset, r)
            order = np.argsort(k, kind="stable")
            self.buckets.append((k[order], owner[order], offset[order]))

    def candidates(self, characters: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (start, item, offset) of windows that collide in some round."""
        out = []
        for r, (keys, owners, offsets) in enumerate(self.buckets):
            found = self.hash(characters, starts, r)
            lo, hi = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
            hit = np.flatnonzero(hi > lo)
            many = hi[hit] - lo[hit]
            at = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            out.append((np.repeat(starts[hit], many) * self.items + owners[at]) * self.longest + offsets[at])
        keys = np.unique(np.concatenate(out))
        keys, offset = np.divmod(keys, self.longest)
        return np.stack([*np.divmod(keys, self.items), offset], 1)


class Items:
    """An index of items, and the exact check. ``unbroken``: a passage must stand in the text without any edit."""

    def __init__(self, items: list[tuple[int, str]], share: float, edits: int, unbroken: bool = True):
        self.edits, self.unbroken = edits, unbroken
        texts = [(i, t) for i, q in items if len(t := plain(q))]
        self.ids = [i for i, _ in texts]
        self.lengths = np.array([len(t) for _, t in texts], np.int64)
        self.least = np.array([max(1, math.ceil(n * share)) for n in self.lengths], np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if texts else np.empty(0, np.int64)
        self.points = np.concatenate([t for _, t in texts]) if texts else np.empty(0, np.uint32)
        self.groups = []
        for lo, hi in zip(GROUPS, [*GROUPS[1:], math.inf]):
            if some := [i for i in range(len(texts)) if lo <= self.least[i] < hi]:
                self.groups.append(_Group(some, self.lengths, self.bases, self.points, int(self.least[some].min()), edits))

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(position in ``texts``, item) for every item that leaked into a text."""
        out: list[tuple[int, int]] = []
        batch: list[tuple[int, np.ndarray]] = []
        size = 0
        for n, t in enumerate(texts):
            if t:
                batch.append((n, plain(t)))
                size += len(batch[-1][1])
            if size > CHUNK:
                out += self._leaks(batch)
                batch, size = [], 0
        return out + self._leaks(batch)

    def _leaks(self, batch: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for g in self.groups:
            some = [(n, p) for n, p in batch if len(p) >= g.window]
            if not some:
                continue
            first = np.cumsum([0, *(len(p) for _, p in some)])
            starts = np.concatenate([f + np.arange(0, len(p) - g.window + 1, g.stride) for f, (_, p) in zip(first, some)])
            points = np.concatenate([p for _, p in some])
            found = g.candidates(mixed(points), starts)
            for lo in range(0, len(found), CHUNK // 64):
                part = found[lo : lo + CHUNK // 64]
                page = np.searchsorted(first, part[:, 0], side="right") - 1
                good = self._sure(points, part, first[page], first[page + 1], g.window, g.edits)
                out |= {(some[k][0], self.ids[i]) for k, i in zip(page[good].tolist(), part[good, 1].tolist())}
        return sorted(out)

    def _sure(self, points: np.ndarray, found: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, edits: int) -> np.ndarray:
        """Whether colliding windows are within the edits of each other, and the stretch around holds enough of the item."""
        start, item, offset = found.T
        text = np.append(points, np.uint32(0))
        reach = start[:, None] + np.arange(window + edits)
        mine = self.points[(self.bases[item] + offset)[:, None] + np.arange(window)]
        near = np.flatnonzero(edits_apart(mine, text[np.where(reach < end[:, None], reach, len(points))], edits))
        start, item, offset, begin, end = start[near], item[near], offset[near], begin[near], end[near]
        if not len(near):
            return near
        # letters of the item against the text beside them, and up to ``edits`` places off where passages may be edited
        place = np.arange(self.lengths[item].max())
        inside = place < self.lengths[item][:, None]
        own = np.append(self.points, np.uint32(0))[np.where(inside, self.bases[item][:, None] + place, len(self.points))]
        same = np.zeros(inside.shape, bool)
        for off in range(0 if self.unbroken else -self.edits, 1 if self.unbroken else self.edits + 1):
            at = (start - offset)[:, None] + place + off
            same |= (own == text[np.where((at >= begin[:, None]) & (at < end[:, None]), at, len(points))]) & inside
        if self.unbroken:
            ends = np.where(~same, place, -1)
            run = place - np.maximum.accumulate(ends, axis=1)
            return near[(run * same).max(1) >= self.least[item]]
        total = np.concatenate([np.zeros((len(same), 1), np.int64), same.cumsum(1)], 1)
        upto = np.minimum(np.arange(total.shape[1]) + self.least[item][:, None], self.lengths[item][:, None])
        likely = (np.take_along_axis(total, upto, 1) - total).max(1) >= self.least[item] - self.edits
        sure, known = [], set()
        for r in np.flatnonzero(likely):
            if (begin[r], item[r]) in known:
                continue
            q = "".join(map(chr, self.points[self.bases[item[r]] : self.bases[item[r]] + self.lengths[item[r]]]))
            lo = max(begin[r], start[r] - offset[r] - self.edits)
            around = "".join(map(chr, points[lo : min(end[r], start[r] - offset[r] + len(q) + self.edits)]))
            least = int(self.least[item[r]])
            # the passage holds the window that was found
            if any(within_edits(q[i : i + least], around, self.edits) for i in range(max(0, offset[r] + window - least), min(offset[r], len(q) - least) + 1)):
                known.add((begin[r], item[r]))
                sure.append(r)
        return near[np.array(sure, np.int64)]


def leaked(rows: DataFrame, items: DataFrame, share: float = 0.5, max_edits: int = 1, unbroken: bool = True, block: int = BLOCK) -> DataFrame:
    """table_name, row_key, item_id where a text holds at least ``share`` of an item as one passage.

    ``rows``: table_name, row_key, text; ``items``: item_id, question. Candidates are windows up to ``max_edits`` apart; the
    passage itself must be the item's own (``unbroken``) or may be as many edits apart. Letters and digits of any script
    count; case, width and everything else do not. Null and empty texts, null keys and items without letters give no
    rows; other columns are ignored; repeated rows count once; empty tables give no rows; whole texts are searched, of
    any length. Items are shared in blocks of ``block``, so their number is not bounded: a text is read once a block.
    """
    held_out = items.where("question is not null and item_id is not null").select("item_id", "question").distinct()
    blocks = -(-held_out.count() // block)
    keyed = rows.where("row_key is not null").select("table_name", "row_key", "text")
    found = []
    for b in range(blocks):
        part = [(r["item_id"], r["question"]) for r in held_out.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)) == b).collect()]
        found.append(keyed.mapInPandas(_search(rows.sparkSession.sparkContext.broadcast(part), share, max_edits, unbroken), "table_name string, row_key long, item_id long"))
    if not found:
        return keyed.select("table_name", F.col("row_key").cast("long").alias("row_key"), F.lit(0).cast("long").alias("item_id")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[int, str], ...], share: float, edits: int, unbroken: bool) -> Items:
    """The index of a block, built once in each Python worker."""
    return Items(list(items), share, edits, unbroken)


def _search(shared, share: float, edits: int, unbroken: bool):
    def search(batches):
        index = _index(tuple(shared.value), share, edits, unbroken)
        for pdf in batches:
            found = index.leaks(pdf["text"].tolist())
            names, keys = pdf["table_name"].tolist(), pdf["row_key"].tolist()
            yield pd.DataFrame([(names[n], keys[n], i) for n, i in found], columns=["table_name", "row_key", "item_id"]).astype({"row_key": "int64", "item_id": "int64"})

    return search
