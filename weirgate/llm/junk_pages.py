"""Keyword-stuffed pages and link lists among documents.

A text is cut into pieces (lines, sentences within lines, and stretches of about 60 characters within long ones). Each
piece shows a vector of binned measures: its share of links, figures and of words that the page repeats, how much of the
page these words make up, how many words hold sentences together, how densely separators, tags and prices stand, its
length and its end. A hidden Markov model
with the states prose, link list, tag list and menu gives the most likely states of all pieces of a page; none of the
measures decides by itself. A page is junk if more than half of its visible characters lie in words of link and tag lists.

The probabilities of the model are fitted by ``junk_training`` (Baum-Welch on a bounded sample of pages) and stored
beside this module. Measures are taken with numpy over the code points of many pages at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of the model. Prose and keyword lists have one state for each way of writing words, as their measures differ;
#: tag lists are keywords that repeat one another, and tags and prices, which need not.
PROSE, PROSE_LATIN, LINKS, KEYWORDS, KEYWORDS_LATIN, TAGS, MENU = range(7)
STATES, JUNK = 7, (LINKS, KEYWORDS, KEYWORDS_LATIN, TAGS)
#: Characters of pages measured at once, and about how many visible characters a piece of a long line has.
CHUNK, PIECE = 1_000_000, 60
MODEL = Path(__file__).with_name("junk_model.npz")

_LINK = re.compile(r"</?a\b[^>]*>|(?:https?|ftp)://[A-Za-z0-9\-._~:/?#@!$&*+,;=%]+|(?<![A-Za-z0-9@.\-])(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,10}/[A-Za-z0-9\-._~/?#=&%+]*|\bwww\.[A-Za-z0-9\-.]+", re.I)
#: Characters and words that hold sentences together, ends of sentences, separators of lists, signs of tags and prices.
GLUE_CHARACTERS = "的了是在和与及若如应可须将把于为而但并且或因被对从向由以其这那该此之则所也还都只曾否能会要有无不"
GLUE_WORDS = "the a an of to is are was were be that this and or but if when it its while although because should may must can will has have had which who what how not so than then before after".split()
STOPS, SEPARATORS, LABELS, CLOSING = "。！？!?", "，、；;|｜,•·/\t", "#＃￥¥$€", "”’」』）)\"'"

SPACE, HAN, LETTER, DIGIT, GLUE, STOP, SEPARATOR, LABEL, LINK_SIGN, CLOSE = (1 << i for i in range(10))
_LOW, _WORD_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Code point -> bits of what the character is."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x30000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            if c.isspace():
                out[cp] |= SPACE
            elif c.isdigit():
                out[cp] |= DIGIT
            elif 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp:
                out[cp] |= HAN
            elif c.isalpha():
                out[cp] |= LETTER
    for some, bit in ((GLUE_CHARACTERS, GLUE), (STOPS, STOP), (SEPARATORS, SEPARATOR), (LABELS, LABEL), (CLOSING, CLOSE), ("\x01", LINK_SIGN)):
        out[[ord(c) for c in some]] |= bit
    return out


def _word_hashes(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each stretch [lo, hi) of the code points, which do not overlap."""
    if not len(lo):
        return np.empty(0, np.uint64)
    place = np.zeros(len(points), np.int64)
    place[lo] = lo
    place = np.arange(len(points)) - np.maximum.accumulate(place)
    powers = np.multiply.accumulate(np.full(65, _LOW, np.uint64))
    mixed = (points.astype(np.uint64) + np.uint64(7)) * powers[place % 65] + place.astype(np.uint64)
    edges = np.stack([lo, hi], 1).ravel()
    sums = np.add.reduceat(np.concatenate([mixed, np.zeros(1, np.uint64)]), edges)[::2]
    return (sums ^ (sums >> np.uint64(29))) * _WORD_MIX


@lru_cache(maxsize=1)
def _glue_hashes() -> np.ndarray:
    text = " ".join(GLUE_WORDS)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in GLUE_WORDS])
    starts = ends - [len(w) + 1 for w in GLUE_WORDS]
    return np.sort(_word_hashes(points, starts, ends - 1))


@dataclass
class Pieces:
    """The pieces of a batch of pages in order."""

    page: np.ndarray  # which page
    visible: np.ndarray  # visible characters
    measures: np.ndarray  # pieces x measures, binned


#: Edges of the bins of each measure: a value falls in the bin of the number of edges it reaches.
BINS = {
    "links": (0.02, 0.12, 0.4, 0.8),
    "repeats": (0.15, 0.35, 0.6, 0.85),
    "density": (0.01, 0.025, 0.05, 0.1),
    "glue": (0.02, 0.06, 0.12, 0.2),
    "separators": (0.02, 0.08, 0.18, 0.3),
    "labels": (0.01, 0.05, 0.12),
    "figures": (0.1, 0.3, 0.55),
    "size": (8, 20, 45),
    "ended": (1,),
    "latin": (0.5,),
}


def measured(texts: list[str]) -> Pieces:
    """The pieces of pages. A page without visible characters has none."""
    hidden = [_LINK.sub(lambda m: "\x01" * len(m[0]), t) if "/" in t or "www." in t or "WWW." in t or "<a" in t else t for t in texts]
    sizes = np.array([len(t) + 1 for t in hidden], np.int64)
    points = np.frombuffer("\n".join([*hidden, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = kinds()[points]
    page = np.repeat(np.arange(len(texts)), sizes)
    shown = (bits & SPACE) == 0
    here = np.arange(len(points))

    # ends of pieces: line ends, stops with the brackets that close after them, full stops of other scripts before a blank
    after = np.concatenate([bits[1:], [np.uint16(SPACE)]])
    stop = ((bits & STOP) > 0) | ((points == 46) & ((after & (SPACE | CLOSE)) > 0) & (np.concatenate([[0], bits[:-1] & DIGIT]) == 0))
    last_stop = stop & ((after & (STOP | CLOSE)) == 0)
    closing = ((bits & CLOSE) > 0) & np.concatenate([[False], stop[:-1]]) & ((after & (STOP | CLOSE)) == 0)
    line = (points == 10) | (points == 13)
    cut = line | last_stop | closing
    # long stretches are cut at the first separator or blank after each PIECE characters
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], cut[:-1]]), here, 0))
    split = np.flatnonzero(((bits & (SEPARATOR | SPACE)) > 0) & ~cut & (here - begin >= PIECE))
    if len(split):
        group = begin[split] * np.int64(1 << 20) + (here[split] - begin[split]) // PIECE
        cut[split[np.concatenate([[True], group[1:] != group[:-1]])]] = True
    starts = np.flatnonzero(np.concatenate([[True], cut[:-1]]))
    total = lambda a: np.add.reduceat(a.astype(np.int32), starts)
    visible = total(shown)

    # words: single Han characters and stretches of letters
    letter = (bits & LETTER) > 0
    lo = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    hi = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    lower = np.where((points >= 65) & (points <= 90), points + 32, points)
    hashes = _word_hashes(lower, lo, hi)
    known = _glue_hashes()
    is_glue = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    han = (bits & HAN) > 0
    glue_sign = (bits & GLUE) > 0
    words = han.astype(np.int32)
    words[lo] += 1
    glue = glue_sign.astype(np.int32)
    glue[lo[is_glue]] += 1

    # repetition: pairs of Han neighbours and words, without those that hold sentences together, three times in a page
    content = han & ~glue_sign
    pair = np.flatnonzero(content[:-1] & content[1:])
    keys = (points[pair].astype(np.uint64) << np.uint64(21)) | points[pair + 1].astype(np.uint64)
    worded = ~is_glue & (hi - lo > 1)
    plain = lo[worded]
    places = np.concatenate([pair, plain])
    keys = np.concatenate([keys * _LOW, hashes[worded]]) ^ ((page[places].astype(np.uint64) + np.uint64(1)) * _WORD_MIX)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again, counted = np.zeros(len(points), np.int32), np.zeros(len(points), np.int32)
    counted[places] = 1
    again[places] = counts[inverse] >= 3
    in_page = np.maximum(np.bincount(page[places], minlength=len(texts)), 20)
    density = np.zeros(len(points))
    density[places] = (counts[inverse] - 1) / in_page[page[places]]

    ended = np.maximum.reduceat((last_stop | closing).astype(np.int8), starts)
    n = np.maximum(visible, 1)
    n_words = np.maximum(total(words), 1)
    values = {
        "links": total(bits & LINK_SIGN > 0) / n,
        "repeats": total(again) / np.maximum(total(counted), 3),
        "density": np.add.reduceat(density, starts) / np.maximum(total(counted), 1),
        "glue": total(glue) / n_words,
        "separators": total(bits & SEPARATOR > 0) / n_words,
        "labels": total(bits & LABEL > 0) / n_words,
        "figures": total(bits & DIGIT > 0) / n,
        "size": visible,
        "ended": ended,
        "latin": total(letter & (points < 0x250)) / n,
    }
    some = visible > 0
    return Pieces(page[starts][some], visible[some], np.stack([np.searchsorted(BINS[k], values[k][some], side="right") for k in BINS], 1).astype(np.int8))


@dataclass
class Model:
    """Log-probabilities of the first state, of moves, and of each bin of each measure in each state."""

    first: np.ndarray
    moves: np.ndarray
    emit: list[np.ndarray]  # for each measure: states x bins

    @classmethod
    def load(cls, path: Path = MODEL) -> Model:
        with np.load(path) as z:
            return cls(np.log(z["first"]), np.log(z["moves"]), [np.log(z[k]) for k in BINS])

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """Log-probability of each piece in each state."""
        return sum(e.T[measures[:, i]] for i, e in enumerate(self.emit))

    def states(self, pieces: Pieces) -> np.ndarray:
        """The most likely states of the pieces of all pages (Viterbi); of equal ones the first."""
        scores = self.scores(pieces.measures)
        if not len(scores):
            return np.empty(0, np.int8)
        starts = np.flatnonzero(np.concatenate([[True], pieces.page[1:] != pieces.page[:-1]]))
        lengths = np.diff(np.append(starts, len(scores)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        best = scores[starts] + self.first
        came = np.zeros((len(scores), STATES), np.int8)
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # pages with more than t pieces
        for t in range(1, lengths[0]):
            k = active[t]
            through = best[:k, :, None] + self.moves
            at = starts[:k] + t
            came[at] = through.argmax(1)
            best[:k] = through.max(1) + scores[at]
        out = np.empty(len(scores), np.int8)
        state = best.argmax(1)
        for t in range(lengths[0] - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            out[at] = state[:k]
            state[:k] = came[at, state[:k]]
        return out


@lru_cache(maxsize=1)
def model() -> Model:
    return Model.load()


def chunks_of(texts: list[str | None]):
    """(positions, texts) of pages with content, about CHUNK characters at once."""
    places, batch, size = [], [], 0
    for k, t in enumerate(texts):
        if t:
            places.append(k), batch.append(t)
            size += len(t)
            if size > CHUNK:
                yield places, batch
                places, batch, size = [], [], 0
    if batch:
        yield places, batch


def junk_shares(texts: list[str | None], by: Model | None = None) -> np.ndarray:
    """The share of visible characters in link lists and tag lists; 0 for null, empty and blank texts."""
    out = np.zeros(len(texts))
    for places, batch in chunks_of(texts):
        pieces = measured(batch)
        junk = np.isin((by or model()).states(pieces), JUNK)
        whole = np.bincount(pieces.page, pieces.visible, len(batch))
        out[places] = np.bincount(pieces.page, pieces.visible * junk, len(batch)) / np.maximum(whole, 1)
    return out


def junk_pages(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id, junk of the documents whose share of link and tag lists exceeds ``limit``.

    Null, empty and blank texts are never junk; repeated doc_ids come out once; an empty table gives no rows; other
    columns are ignored. Every document is judged alone, from its whole text, so nothing is shuffled but the result.
    """

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return pd.Series(junk_shares(texts.tolist()), dtype="float64")

    return docs.select("doc_id", share("text").alias("junk")).where(F.col("junk") > limit).distinct()
