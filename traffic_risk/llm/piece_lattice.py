"""Viterbi over the piece lattices of many words at once.

Words of one length are rows of a matrix of characters. For every start all rows walk the pieces' prefix tree together, a
character a step; a step looks up (state, character) in an open hash table, whose keys are exact numbers. The two best scores up to every place are
arrays over the words, updated in the order of a word-by-word forward pass, so scores and ties are the same.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

LONGEST = 48
"""Characters of words that are worth a matrix; longer ones are rare."""
FEWEST = 16
"""Words of one length that are."""
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """The prefix tree of pieces. State 0 is the root."""

    keys: np.ndarray
    """By slot: state and character of a step, as one number; all ones where there is none."""
    nexts: np.ndarray
    piece: np.ndarray
    """Id of the piece that ends at a state, or -1."""
    score: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(pieces: dict[str, tuple[int, float]]) -> Tree:
        """``pieces`` has every piece and every beginning of one, as in a vocabulary."""
        state = {"": 0} | {p: k + 1 for k, p in enumerate(pieces)}
        piece, score = np.full(len(state), -1, dtype=np.int32), np.zeros(len(state))
        for p, (i, s) in pieces.items():
            piece[state[p]], score[state[p]] = i, s
        bits, mix = max(4, (4 * len(state)).bit_length()), int(_MIX)
        keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        nexts = np.zeros(1 << bits, dtype=np.int32)
        shift = np.uint64(64 - bits)
        for p, to in state.items():
            if p:
                key = state[p[:-1]] << 21 | ord(p[-1])
                at = (key * mix & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                while keys[at] != np.iinfo(np.uint64).max:
                    at = (at + 1) % len(keys)
                keys[at], nexts[at] = key, to
        return Tree(keys, nexts, piece, score, shift)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next state of every row, -1 where the tree has none."""
        key = states.astype(np.uint64) << np.uint64(21) | chars
        at = (key * _MIX >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int64)
        todo = np.arange(len(key))
        none = np.iinfo(np.uint64).max
        while len(todo):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.nexts[at[hit]]
            on = ~hit & (found != none)
            todo, key, at = todo[on], key[on], (at[on] + 1) % len(self.keys)
        return out


@dataclass
class Paths:
    """Best segmentations of many words: ids word after word, where each word's end, scores, and losses of the second best."""

    ids: np.ndarray
    ends: np.ndarray
    """Led by a zero."""
    scores: np.ndarray
    losses: np.ndarray

    @staticmethod
    def of(found: list[tuple[tuple[int, ...], float, float]]) -> Paths:
        ids = np.array([i for f in found for i in f[0]], dtype=np.int32)
        return Paths(ids, ends_of(np.array([len(f[0]) for f in found], dtype=np.int64)), np.array([f[1] for f in found]), np.array([f[2] for f in found]))

    @staticmethod
    def joined(every: list[Paths]) -> Paths:
        sizes = np.concatenate([np.diff(p.ends) for p in every])
        ids, scores, losses = (np.concatenate([getattr(p, name) for p in every]) for name in ("ids", "scores", "losses"))
        return Paths(ids, ends_of(sizes), scores, losses)

    def take(self, rows: np.ndarray) -> Paths:
        sizes = self.ends[rows + 1] - self.ends[rows]
        return Paths(self.ids[stretches(self.ends[rows], sizes)], ends_of(sizes), self.scores[rows], self.losses[rows])

    def rows(self) -> list[tuple[tuple[int, ...], float, float]]:
        ids, ends = self.ids.tolist(), self.ends.tolist()
        return [
            (tuple(ids[a:b]), score, loss)
            for a, b, score, loss in zip(ends, ends[1:], self.scores.tolist(), self.losses.tolist(), strict=False)
        ]


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """Where stretches of these sizes end, led by a zero."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of many stretches, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total, last = (int(ends[-1]), int((starts + sizes).max())) if len(ends) else (0, 0)
    kind = np.int32 if max(total, last) < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


def segment(words: list[str], tree: Tree) -> tuple[Paths, np.ndarray]:
    """Segmentations of words of equal length, and for which they hold: those without a character that is no piece."""
    n, length = len(words), len(words[0])
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, length).T.astype(np.uint64)
    best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    start, came = np.zeros((length + 1, n), dtype=np.int16), np.full((length + 1, n), -1, dtype=np.int32)
    whole = np.ones(n, dtype=bool)
    for i in range(length):
        rows, states = np.arange(n), np.zeros(n, dtype=np.int64)
        for j in range(i + 1, length + 1):
            states = tree.step(states, chars[j - 1, rows])
            alive = states >= 0
            if not alive.all():
                rows, states = rows[alive], states[alive]
            if not len(rows):
                break
            piece = tree.piece[states]
            real = piece >= 0
            if j == i + 1:
                single = np.zeros(n, dtype=bool)
                single[rows[real]] = True
                whole &= single
            w, p, worth = rows[real], piece[real], tree.score[states[real]]
            score, below, top, next_ = best[i, w] + worth, second[i, w] + worth, best[j, w], second[j, w]
            better = score > top
            best[j, w] = np.where(better, score, top)
            second[j, w] = np.where(better, np.maximum(top, below), np.maximum(next_, score))
            b = w[better]
            start[j, b], came[j, b] = i, p[better]
        if j == i + 1 and not len(rows):
            whole[:] &= False  # no row has this character as a piece
    steps, at, every = [], np.full(n, length), np.arange(n)
    while at.any():
        steps.append(np.where(at > 0, came[at, every], -1))
        at = np.where(at > 0, start[at, every], 0)
    paths = np.array(steps[::-1]).T  # a row a word, with gaps in front
    real = paths >= 0
    losses = np.where(whole, best[length], 0.0) - second[length]
    return Paths(paths[real], ends_of(real.sum(axis=1)), best[length], losses), whole


def segment_together(words: Iterable[str], tree: Tree) -> tuple[list[str], Paths, list[str]]:
    """Words of any lengths and their segmentations, and those that are better done one by one."""
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    done, found, rest = [], [Paths.of([])], []
    for length, own in by_length.items():
        if 0 < length <= LONGEST and len(own) >= FEWEST:
            paths, good = segment(own, tree)
            if not good.all():
                rest += [own[i] for i in np.flatnonzero(~good).tolist()]
                rows = np.flatnonzero(good)
                own, paths = [own[i] for i in rows.tolist()], paths.take(rows)
            done += own
            found.append(paths)
        else:
            rest += own
    return done, Paths.joined(found), rest


def segment_all(words: Iterable[str], tree: Tree) -> dict[str, tuple[tuple[int, ...], float, float]]:
    """``segment_together`` word by word, as (ids, score, loss)."""
    done, paths, _ = segment_together(words, tree)
    return dict(zip(done, paths.rows(), strict=True))
