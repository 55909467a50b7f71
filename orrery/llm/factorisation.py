"""A factorisation machine over sparse rows: low-rank pairwise interactions by the sum-of-squares identity.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the row's features.
Rank zero is logistic regression. Fitting sees a bounded sample only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Rows(NamedTuple):
    """Sparse rows, each with one feature at least: place where each begins, feature numbers, values."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def pack(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    sizes = np.array([len(i) for i, _ in rows], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(rows) else sizes
    flat = lambda k, t: np.concatenate([r[k] for r in rows]).astype(t) if rows else np.empty(0, t)
    return Rows(begin.astype(np.int64), flat(0, np.int32), flat(1, np.float64))


def pack_bytes(index: list[bytes], value: list[bytes]) -> Rows:
    """The same from the bytes of 32-bit arrays, which take little of the driver's memory."""
    sizes = np.array([len(i) // 4 for i in index], np.int64)
    return Rows(np.cumsum(sizes) - sizes, np.frombuffer(b"".join(index), np.int32), np.frombuffer(b"".join(value), np.float32))


def sums(m: Machine, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for each row, and the sums of factors that its gradient needs."""
    if not len(x.begin):
        return np.empty(0), np.empty((0, m.factors.shape[1]))
    y = m.bias + np.add.reduceat(m.linear[x.index] * x.value, x.begin)
    f = m.factors[x.index] * x.value[:, None]
    s = np.add.reduceat(f, x.begin, axis=0)
    return y + 0.5 * (s**2 - np.add.reduceat(f**2, x.begin, axis=0)).sum(1), s


def sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -35, 35)))


def predict(m: Machine, x: Rows) -> np.ndarray:
    return sigmoid(sums(m, x)[0])


def fit(x: Rows, target: np.ndarray, features: int, rank: int, rounds: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; targets between 0 and 1."""
    rnd = np.random.default_rng(seed)
    share = min(max(target.mean() if len(target) else 0.5, 1e-3), 1 - 1e-3)
    bias, linear, factors = float(np.log(share / (1 - share))), np.zeros(features), rnd.normal(0, 0.02, (features, rank))
    seen_b, seen_w, seen_v = 1e-6, np.full(features, 1e-6), np.full((features, rank), 1e-6)
    ends = np.append(x.begin, len(x.index))
    for _ in range(rounds):
        for rows in np.array_split(rnd.permutation(len(target)), max(1, len(target) // batch)):
            if not len(rows):
                continue
            sizes = ends[rows + 1] - ends[rows]
            at = np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            part = Rows(np.concatenate([[0], np.cumsum(sizes)[:-1]]), x.index[at], x.value[at])
            y, s = sums(Machine(bias, linear, factors), part)
            g = (sigmoid(y) - target[rows]) / len(rows)
            each = np.repeat(g, sizes) * part.value
            used, where = np.unique(part.index, return_inverse=True)
            gw = np.bincount(where, each, len(used)) + decay * linear[used]
            seen_w[used] += gw**2
            linear[used] -= rate * gw / np.sqrt(seen_w[used])
            if rank:
                pull = each[:, None] * (np.repeat(s, sizes, axis=0) - factors[part.index] * part.value[:, None])
                gv = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(rank)], 1) + decay * factors[used]
                seen_v[used] += gv**2
                factors[used] -= rate * gv / np.sqrt(seen_v[used])
            seen_b += g.sum() ** 2
            bias -= rate * g.sum() / seen_b**0.5
    return Machine(bias, linear, factors)
