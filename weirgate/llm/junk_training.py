"""Fitting of the hidden Markov model of ``junk_pages``: Baum-Welch on a bounded sample of pages without labels.

``LEAN`` says, as a prior of ``WEIGHT`` pieces a state, which bins a state leans to, so that the states keep their
meaning; everything else comes from the pages. Run ``python -m weirgate.llm.junk_training FOLDER`` to fit from
documents.parquet in FOLDER and write the model.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from weirgate.llm.junk_pages import BINS, KEYWORDS, KEYWORDS_LATIN, LINKS, MENU, MODEL, PROSE, PROSE_LATIN, STATES, TAGS, Model, chunks_of, measured

#: Pages of the sample, rounds, weight of the prior in pieces, and of moves between states.
SAMPLE, ROUNDS, WEIGHT, STAY = 6000, 8, 6000.0, 0.9

#: Prior probabilities of the bins of each measure by state.
LEAN = {
    "links": {PROSE: (94, 3, 2, 0.6, 0.4), LINKS: (4, 6, 15, 30, 45), KEYWORDS: (94, 3, 2, 0.5, 0.5), MENU: (90, 5, 3, 1, 1)},
    "repeats": {PROSE: (55, 25, 13, 5, 2), PROSE_LATIN: (40, 25, 18, 10, 7), LINKS: (40, 10, 15, 15, 20), KEYWORDS: (3, 7, 15, 25, 50), TAGS: (30, 20, 20, 15, 15), MENU: (45, 20, 15, 10, 10)},
    "density": {PROSE: (60, 25, 10, 4, 1), LINKS: (30, 25, 20, 15, 10), KEYWORDS: (1, 4, 15, 35, 45), TAGS: (25, 25, 25, 15, 10), MENU: (50, 25, 15, 7, 3)},
    "glue": {PROSE: (4, 11, 25, 30, 30), PROSE_LATIN: (3, 4, 10, 25, 58), LINKS: (80, 10, 5, 3, 2), KEYWORDS: (90, 7, 2, 0.6, 0.4), MENU: (55, 15, 12, 10, 8)},
    "separators": {PROSE: (45, 35, 14, 5, 1), LINKS: (60, 15, 10, 8, 7), KEYWORDS: (12, 10, 28, 27, 23), MENU: (50, 20, 12, 10, 8)},
    "labels": {PROSE: (97, 2, 0.7, 0.3), LINKS: (90, 4, 3, 3), KEYWORDS: (90, 5, 3, 2), TAGS: (4, 6, 20, 70), MENU: (95, 3, 1.4, 0.6)},
    "figures": {PROSE: (80, 16, 3, 1), LINKS: (85, 10, 4, 1), KEYWORDS: (70, 24, 5, 1), MENU: (30, 20, 25, 25)},
    "size": {PROSE: (5, 20, 40, 35), LINKS: (15, 30, 30, 25), KEYWORDS: (10, 20, 30, 40), MENU: (40, 35, 15, 10)},
    "ended": {PROSE: (35, 65), LINKS: (96, 4), KEYWORDS: (90, 10), MENU: (90, 10)},
    "latin": {PROSE: (96, 4), PROSE_LATIN: (2, 98), LINKS: (70, 30), KEYWORDS: (96, 4), KEYWORDS_LATIN: (2, 98), TAGS: (60, 40), MENU: (60, 40)},
}
FIRST = (0.4, 0.3, 0.08, 0.03, 0.03, 0.02, 0.14)
#: The state whose measures a state leans to where it has none of its own.
LIKE = {PROSE_LATIN: PROSE, KEYWORDS_LATIN: KEYWORDS, TAGS: KEYWORDS}


def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    share = lambda a: np.asarray(a, float) / np.sum(a)
    moves = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(moves, STAY)
    return np.array(FIRST), moves, [np.stack([share(LEAN[k].get(s, LEAN[k].get(LIKE.get(s)))) for s in range(STATES)]) for k in BINS]


def _sums(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of states, expected moves and log-likelihood of one page (scaled forward and backward sums)."""
    like = np.exp(scores - scores.max(1, keepdims=True))
    n = len(like)
    alpha, beta, scale = np.empty((n, STATES)), np.ones((n, STATES)), np.empty(n)
    a = first * like[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ moves) * like[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = moves @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
    after = like[1:] * beta[1:] / scale[1:, None]
    return alpha * beta, moves * (alpha[:-1].T @ after), float(np.log(scale).sum() + scores.max(1).sum())


def log_likelihood(text: str, m: Model) -> float:
    return _sums(m.scores(measured([text]).measures), np.exp(m.first), np.exp(m.moves))[2]


def fit(texts: list[str], rounds: int = ROUNDS, say=print) -> Model:
    pages = []
    for _, batch in chunks_of(texts):
        pieces = measured(batch)
        pages += np.split(pieces.measures, np.flatnonzero(np.diff(pieces.page)) + 1)
    first0, moves0, emit0 = prior()
    first, moves, emit = first0, moves0, emit0
    for r in range(rounds):
        m = Model(np.log(first), np.log(moves), [np.log(e) for e in emit])
        n_first, n_moves, n_emit = first0 * WEIGHT, moves0 * WEIGHT, [e * WEIGHT for e in emit0]
        for page in pages:
            post, moved, _ = _sums(m.scores(page), first, moves)
            n_first = n_first + post[0]
            n_moves = n_moves + moved
            for i, e in enumerate(n_emit):
                np.add.at(e.T, page[:, i], post)
        first, moves, emit = n_first / n_first.sum(), n_moves / n_moves.sum(1, keepdims=True), [e / e.sum(1, keepdims=True) for e in n_emit]
        say(f"round {r + 1}: first {np.round(first, 3)}, staying {np.round(np.diag(moves), 3)}")
    return Model(np.log(first), np.log(moves), [np.log(e) for e in emit])


def save(m: Model, path=MODEL) -> None:
    np.savez_compressed(path, first=np.exp(m.first), moves=np.exp(m.moves), **{k: np.exp(e) for k, e in zip(BINS, m.emit)})


def sample_of(folder: str, size: int = SAMPLE, seed: int = 11) -> list[str]:
    import pyarrow.parquet as pq

    texts = sorted({t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist() if t and t.strip()})
    random.Random(seed).shuffle(texts)
    return texts[:size]


if __name__ == "__main__":
    save(fit(sample_of(sys.argv[1])))
