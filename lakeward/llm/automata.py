"""Weighted acyclic automata of word n-grams: build, union, cut by prefix range, compose.

Words are 64-bit codes.  An automaton accepts n-grams of up to three words;
a path's weight is the sum of the weights of the equal n-grams that went in.
States are prefixes, the arcs out of a state are sorted by code, and all
paths of three words end in one sink.  In memory an automaton is its paths
in order, as places in its own sorted alphabet of codes; as bytes it is its
levels: for each state how many paths go through it, and its arc's label.

n-grams of fewer words are filled with 0, which is no word's code and sorts
first, so a prefix stands before what it starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

N = 3
#: Alphabets of fewer words have n-grams of one 64-bit number.
PACKED = 1 << 21


class Automaton:
    """Paths ``ids`` (k, 3), sorted and distinct, over ``alphabet`` (sorted codes, the first is 0), and their weights."""

    def __init__(self, alphabet: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.alphabet, self.ids, self.weights = alphabet, ids, weights

    @classmethod
    def empty(cls) -> Automaton:
        return cls(np.zeros(1, np.uint64), np.zeros((0, N), np.int32), np.zeros(0, np.int64))

    @classmethod
    def build(cls, grams, weights, how=np.add) -> Automaton:
        """From n-grams of codes in any order; equal ones are summed (or their maximum taken)."""
        grams = np.asarray(grams, np.uint64).reshape(-1, N)
        alphabet, ids = np.unique(np.append(grams.ravel(), np.uint64(0)), return_inverse=True)
        return cls(alphabet, *_sums(ids[:-1].reshape(-1, N).astype(np.int32), np.asarray(weights, np.int64), len(alphabet), how))

    @classmethod
    def count(cls, words: np.ndarray, alphabet: np.ndarray, length: int, skip: int = 0, pairs: np.ndarray | None = None) -> Automaton:
        """Counts of all n-grams of one length in a sequence of places in ``alphabet`` (fewer than PACKED); 0 is a break.

        n-grams that end in the first ``skip`` (at most two) places are there,
        but count nothing.  With ``pairs`` (codes) only those of three words
        whose first two and last two words are among them.
        """
        w = np.asarray(words, np.int64)
        if length == 1:
            counts = np.bincount(w, minlength=len(alphabet))
            counts[0] = 0
            places = np.flatnonzero(counts)
            np.subtract.at(counts, w[:skip], 1)
            ids = np.zeros((len(places), N), np.int32)
            ids[:, 0] = places
            return cls(alphabet, ids, counts[places].astype(np.int64))
        # pair[i] is of the words i and i + 1.
        pair = (w[:-1] << 21) | w[1:]
        full = (w[:-1] > 0) & (w[1:] > 0)
        if length == 2:
            keys = pair[full] << 21
        else:
            if pairs is not None:
                sure = np.sort((np.searchsorted(alphabet, pairs[:, 0]) << 21) | np.searchsorted(alphabet, pairs[:, 1]))
                full &= np.append(sure, -1)[np.searchsorted(sure, pair)] == pair
            ends = full[:-1] & full[1:]
            keys = (pair[:-1][ends] << 21) | w[2:][ends]
        keys, counts = np.unique(keys, return_counts=True)
        if length == 2 and skip == 2 and len(full) and full[0]:
            counts[np.searchsorted(keys, pair[0] << 21)] -= 1
        return cls(alphabet, _unpack(keys), counts.astype(np.int64))

    @classmethod
    def union(cls, parts: list[Automaton], how=np.add) -> Automaton:
        """The automaton of all paths; weights of equal ones are summed (or their maximum taken)."""
        if not parts:
            return cls.empty()
        alphabet = np.unique(np.concatenate([p.alphabet for p in parts]))
        ids = np.concatenate([np.searchsorted(alphabet, p.alphabet).astype(np.int32)[p.ids] for p in parts])
        return cls(alphabet, *_sums(ids, np.concatenate([p.weights for p in parts]), len(alphabet), how))

    def __len__(self) -> int:
        return len(self.weights)

    @property
    def grams(self) -> np.ndarray:
        return self.alphabet[self.ids]

    def take(self, which) -> Automaton:
        """The automaton of some of the paths (a slice or a mask)."""
        return Automaton(self.alphabet, self.ids[which], self.weights[which])

    def cuts(self, splits: np.ndarray) -> np.ndarray:
        """Where the prefix ranges between sorted ``splits`` start: range r is from splits[r - 1] to before splits[r]."""
        return np.concatenate([[0], self._find(splits), [len(self)]])

    def compose(self, asked: np.ndarray) -> np.ndarray:
        """The weight that this automaton gives to each of the n-grams of codes, 0 where it accepts none."""
        out = np.zeros(len(asked), np.int64)
        if len(self) and len(asked):
            at = np.minimum(self._find(asked), len(self) - 1)
            same = (self.alphabet[self.ids[at]] == asked).all(axis=1)
            out[same] = self.weights[at[same]]
        return out

    def weights_of(self, other: Automaton) -> np.ndarray:
        """Composition with an automaton: the weight that this one gives to each path of the other, 0 where it accepts none."""
        if len(self.alphabet) >= PACKED - 1:
            return self.compose(other.grams)
        place = np.searchsorted(self.alphabet, other.alphabet)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == other.alphabet
        # A word unknown here stands where no path has one.
        place = np.where(known, place, PACKED - 1)
        own, asked = _pack(self.ids.astype(np.int64)), _pack(place[other.ids])
        at = np.searchsorted(own, asked)
        same = np.append(own, -1)[at] == asked
        return np.where(same, np.append(self.weights, 0)[at], 0)

    def _find(self, asked: np.ndarray) -> np.ndarray:
        """For each n-gram of codes the first path that is not before it: a binary search among the arcs, level by level."""
        place = np.searchsorted(self.alphabet, asked)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == asked
        # Paths stand at odd numbers, codes outside the alphabet at the even ones between.
        value = 2 * place + known
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(self), np.int64)
        for level in range(N):
            left = self._walk(level, value[:, level], low, high, False)
            low, high = left, self._walk(level, value[:, level], left, high, True)
        return low

    def _walk(self, level: int, value: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            label = 2 * self.ids[np.minimum(mid, len(self) - 1), level].astype(np.int64) + 1
            below = open_ & ((label <= value) if after else (label < value))
            low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low

    def to_bytes(self) -> bytes:
        used = np.zeros(len(self.alphabet), bool)
        used[self.ids.ravel()] = True
        alphabet, ids = self.alphabet[used], (np.cumsum(used) - 1)[self.ids]
        out = [np.array([len(self)]), np.diff(alphabet, prepend=np.uint64(0)), self.weights]
        new = np.zeros(len(self), bool)
        new[:1] = True
        for level in range(N):
            # A state of this level starts where its own label, or a state before it, changes.
            new[1:] |= ids[1:, level] != ids[:-1, level]
            starts = np.flatnonzero(new)
            out += [np.diff(np.append(starts, len(self))), ids[starts, level]]
        parts = [_small(a) for a in out]
        body = b"".join([bytes([a.dtype.itemsize]) + len(a).to_bytes(4, "little") for a in parts] + [a.tobytes() for a in parts])
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        count, arrays = 3 + 2 * N, []
        at = 5 * count
        for k in range(count):
            size, n = body[5 * k], int.from_bytes(body[5 * k + 1:5 * k + 5], "little")
            arrays.append(np.frombuffer(body, f"<u{size}", n, at))
            at += size * n
        alphabet = np.cumsum(arrays[1], dtype=np.uint64)
        ids = np.empty((int(arrays[0][0]), N), np.int32)
        for level in range(N):
            ids[:, level] = np.repeat(arrays[4 + 2 * level], arrays[3 + 2 * level].astype(np.int64))
        if not len(alphabet) or alphabet[0]:
            alphabet, ids = np.append(np.uint64(0), alphabet), ids + np.int32(1)
        return cls(alphabet, ids, arrays[2].astype(np.int64))


def _pack(w: np.ndarray) -> np.ndarray:
    return (w[:, 0] << 42) | (w[:, 1] << 21) | w[:, 2]


def _unpack(keys: np.ndarray) -> np.ndarray:
    low = PACKED - 1
    return np.stack([keys >> 42, (keys >> 21) & low, keys & low], axis=1).astype(np.int32)


def _sums(ids: np.ndarray, weights: np.ndarray, words: int, how) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order, with the sums (or maxima) of their weights."""
    if not len(ids):
        return ids, weights
    if words < PACKED - 1:
        keys = _pack(ids.astype(np.int64))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return _unpack(keys[starts]), how.reduceat(weights[order], starts)
    order = np.lexsort(ids.T[::-1])
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
    return ids[starts], how.reduceat(weights[order], starts)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max))
