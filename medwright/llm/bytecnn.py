"""Byte-level convolution in numpy: filters over raw UTF-8, max-pooled over fixed-length blocks.

Documents are laid end to end, each padded with the byte 0xFF (which UTF-8 never holds) in front and behind to whole
blocks, so pooling is a reshape and filters never see two documents: a window that begins in the pad behind a document ends in the pad in front of the next. A filter of width w over one-hot bytes is a
sum of w table rows; two neighbouring bytes are taken at once from a table of 65,536 rows. Training
needs the position of each block's maximum only, so the backward pass is a weighted count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 256
_GAP = 8  # pad bytes before and behind each document, as many as the widest filter at least
_TILE = 64  # blocks convolved at a time


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes (and a spare block behind them), and the first block of each row (n + 1 numbers)."""
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-(sizes + 2 * _GAP) // BLOCK))])
    out = np.full((int(first[-1]) + 1) * BLOCK, 0xFF, np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK + _GAP - offsets[:-1], sizes)] = data
    return out, first


@dataclass
class Filters:
    """Weights by filter width: width -> (width, 256, filters)."""

    weights: dict[int, np.ndarray]

    @classmethod
    def random(cls, counts: dict[int, int], rng: np.random.Generator) -> Filters:
        return cls({w: rng.normal(0, 0.5 / np.sqrt(w), (w, 256, n)).astype(np.float32) for w, n in counts.items()})

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        out = {}
        for w, x in self.weights.items():
            out[w] = []
            for j in range(0, w, 2):
                second = x[j + 1] if j + 1 < w else np.zeros_like(x[j])
                out[w].append(np.ascontiguousarray((second[:, None, :] + x[j][None, :, :]).reshape(65536, -1)))
        return out


def pooled(tables: dict[int, list[np.ndarray]], laid: np.ndarray) -> np.ndarray:
    """Maximum of each filter in each block."""
    n = len(laid) // BLOCK - 1
    width = sum(t[0].shape[1] for t in tables.values())
    out = np.empty((n, width), np.float32)
    for i in range(0, n, _TILE):
        k = min(_TILE, n - i)
        piece = laid[i * BLOCK:(i + k) * BLOCK + _GAP + 1].astype(np.int32)
        code = piece[:-1] | piece[1:] << 8
        at = 0
        for pair in tables.values():
            f = pair[0].shape[1]
            r = pair[0].take(code[:k * BLOCK], axis=0)
            for j, t in enumerate(pair[1:], 1):
                r += t.take(code[2 * j:2 * j + k * BLOCK], axis=0)
            out[i:i + k, at:at + f] = r.reshape(k, BLOCK, f).max(axis=1)
            at += f
    return out


def pooled_at(filters: Filters, laid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pooled`` straight from the weights, with the position of each maximum, for training."""
    n = len(laid) // BLOCK - 1
    values, places = [], []
    for w, x in filters.weights.items():
        v = np.empty((n, x.shape[2]), np.float32)
        p = np.empty((n, x.shape[2]), np.int64)
        for i in range(0, n, _TILE):
            k = min(_TILE, n - i)
            piece = laid[i * BLOCK:(i + k) * BLOCK + _GAP]
            r = x[0].take(piece[:k * BLOCK], axis=0)
            for j in range(1, w):
                r += x[j].take(piece[j:j + k * BLOCK], axis=0)
            r = r.reshape(k, BLOCK, -1)
            top = r.argmax(axis=1)
            v[i:i + k] = np.take_along_axis(r, top[:, None, :], axis=1)[:, 0]
            p[i:i + k] = top + (np.arange(i, i + k) * BLOCK)[:, None]
        values.append(v)
        places.append(p)
    return np.concatenate(values, axis=1), np.concatenate(places, axis=1)


def filter_gradient(filters: Filters, laid: np.ndarray, places: np.ndarray, slope: np.ndarray) -> dict[int, np.ndarray]:
    """Gradient of the weights from that of the block maxima."""
    out, at = {}, 0
    for w, x in filters.weights.items():
        f = x.shape[2]
        p, g = places[:, at:at + f], slope[:, at:at + f]
        column = np.broadcast_to(np.arange(f), p.shape)
        grad = [np.bincount((laid[p + j].astype(np.int64) * f + column).ravel(), g.ravel(), 256 * f).reshape(256, f) for j in range(w)]
        out[w] = np.stack(grad).astype(np.float32)
        at += f
    return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, named: dict, gradients: dict) -> None:
        """Update the arrays of ``named`` in place."""
        self.t += 1
        for k, g in gradients.items():
            m, v = self.state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            named[k] -= (self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)).astype(named[k].dtype)


def minibatches(n: int, size: int, epochs: int, rng: np.random.Generator) -> Iterator[tuple[float, np.ndarray]]:
    """Share of the training that is done, and the rows of the next step."""
    steps, total = -(-n // size), epochs * -(-n // size)
    for e in range(epochs):
        order = rng.permutation(n)
        for s in range(steps):
            yield (e * steps + s) / total, order[s * size:(s + 1) * size]


def join_rows(datas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in datas])]).astype(np.int64)
    return (np.concatenate(datas) if datas else np.zeros(0, np.uint8)), offsets
