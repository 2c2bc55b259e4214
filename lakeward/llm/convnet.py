"""A small convolutional text classifier in numpy: embeddings, several filter widths, max pooling, softmax.

An input is one or more fixed-length windows of positions, each with one or
more symbol ids whose embeddings add up (0 is padding, its embedding stays
zero).  Filters run over every position of every
window; a document's features are the maxima over all its windows, so any
length of text is one forward pass in bounded pieces.
"""

from __future__ import annotations

import numpy as np


class ConvNet:
    def __init__(self, n_symbols: int, n_classes: int, dim: int = 8, widths=(2, 3, 4), filters: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widest, self.dim = max(widths), dim
        m = filters * len(widths)
        self.mask = np.zeros((self.widest * dim, m), np.float32)
        for k, w in enumerate(widths):
            self.mask[:w * dim, k * filters:(k + 1) * filters] = 1
        self.p = {
            "emb": rng.normal(0, 0.5, (n_symbols, dim)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(m, np.float32),
            "out": rng.normal(0, 0.3, (m, n_classes)).astype(np.float32),
            "prior": np.zeros(n_classes, np.float32),
        }
        self.p["emb"][0] = 0

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows * positions, widest * dim): the embeddings under each filter position."""
        n, length = windows.shape[:2]
        e = np.zeros((n, length + self.widest - 1, self.dim), np.float32)
        e[:, :length] = self.p["emb"][windows[:, :, 0]]
        for k in range(1, windows.shape[2]):
            e[:, :length] += self.p["emb"][windows[:, :, k]]
        out = np.empty((n, length, self.widest * self.dim), np.float32)
        for j in range(self.widest):
            out[:, :, j * self.dim:(j + 1) * self.dim] = e[:, j:j + length]
        return out.reshape(n * length, -1)

    def pooled(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        """(windows, filters): each filter's maximum in each window."""
        n, length = windows.shape[:2]
        out = np.empty((n, self.mask.shape[1]), np.float32)
        for k in range(0, n, batch):
            part = windows[k:k + batch]
            out[k:k + batch] = (self.patches(part) @ self.p["conv"]).reshape(len(part), length, -1).max(axis=1)
        return out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, batch: int = 32,
            rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> ConvNet:
        """Adam on weighted cross-entropy.  ``docs``: per document its windows (at least one).

        Only the patch under each maximum gets a gradient.
        """
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, dim, m = 0, self.dim, self.mask.shape[1]
        length = docs[0].shape[1] if docs else 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), batch):
                pick = order[k:k + batch]
                windows = np.concatenate([docs[i] for i in pick])
                ends = np.cumsum([len(docs[i]) for i in pick])
                starts = ends - [len(docs[i]) for i in pick]
                x = self.patches(windows)
                z = x @ self.p["conv"]
                top = np.empty((len(pick), m), np.int64)
                for b, (s, e) in enumerate(zip(starts, ends, strict=True)):
                    top[b] = z[s * length:e * length].argmax(axis=0) + s * length
                best = z[top, np.arange(m)]
                h = np.maximum(best + self.p["bias"], 0)
                prob = h @ self.p["out"] + self.p["prior"]
                prob = np.exp(prob - prob.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                d = prob
                d[np.arange(len(pick)), labels[pick]] -= 1
                d *= (weights[pick] / weights[pick].sum())[:, None]
                d = d.astype(np.float32)
                dh = (d @ self.p["out"].T) * (h > 0)
                under = x[top]
                grad = {"out": h.T @ d, "prior": d.sum(axis=0), "bias": dh.sum(axis=0),
                        "conv": np.einsum("bm,bmk->km", dh, under) * self.mask, "emb": np.zeros_like(self.p["emb"])}
                flat = np.zeros((len(windows), length + self.widest - 1, windows.shape[2]), windows.dtype)
                flat[:, :length] = windows
                row, col = np.divmod(top, length)
                for j in range(self.widest):
                    share = dh[:, :, None] * self.p["conv"][j * dim:(j + 1) * dim].T[None]
                    for k in range(windows.shape[2]):
                        np.add.at(grad["emb"], flat[row, col + j, k], share)
                grad["emb"][0] = 0
                step += 1
                for name, g in grad.items():
                    if name in ("conv", "out"):
                        g = g + decay * self.p[name]
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    self.p[name] -= (rate * (m1[name] / (1 - 0.9 ** step))
                                     / (np.sqrt(m2[name] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
        return self


def cut(symbols: np.ndarray, length: int) -> np.ndarray:
    """One document's symbols, (positions, ids each), as windows of ``length`` without overlap.

    The last one is padded; there is at least one.
    """
    n = max(1, -(-len(symbols) // length))
    out = np.zeros((n * length, symbols.shape[1]), symbols.dtype)
    out[:len(symbols)] = symbols
    return out.reshape(n, length, -1)
