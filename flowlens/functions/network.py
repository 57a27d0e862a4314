"""The classifier's dense layers in numpy, for use inside Spark tasks.

``[Linear, LayerNorm, GELU, Dropout] * n, Linear``. Parameters travel as one
flat vector, so that a model is a row with an array column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

LAYER_NORM_EPS = 1e-5


def layer_shapes(dims: Sequence[int]) -> list[tuple[str, tuple[int, ...]]]:
    """Parameter names and shapes of a network with these layer widths, in flat order."""
    shapes: list[tuple[str, tuple[int, ...]]] = []
    for i, (fan_in, fan_out) in enumerate(zip(dims, dims[1:])):
        shapes += [(f"w{i}", (fan_out, fan_in)), (f"b{i}", (fan_out,))]
        if i < len(dims) - 2:
            shapes += [(f"g{i}", (fan_out,)), (f"s{i}", (fan_out,))]
    return shapes


def parameter_count(dims: Sequence[int]) -> int:
    return sum(int(np.prod(shape)) for _, shape in layer_shapes(dims))


def unpack(flat: np.ndarray, dims: Sequence[int]) -> dict[str, np.ndarray]:
    """Named views into the flat vector."""
    views, start = {}, 0
    for name, shape in layer_shapes(dims):
        size = int(np.prod(shape))
        views[name] = flat[start:start + size].reshape(shape)
        start += size
    return views


def initial_weights(dims: Sequence[int], seed: int) -> np.ndarray:
    """Uniform in ±1/sqrt(fan_in) for linear layers; unit scale, zero shift for the norms."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(parameter_count(dims))
    for name, view in unpack(flat, dims).items():
        if name[0] in "wb":
            bound = 1.0 / np.sqrt(dims[int(name[1:])])
            view[...] = rng.uniform(-bound, bound, view.shape)
        elif name[0] == "g":
            view[...] = 1.0
    return flat


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    return 2.0 * normal_cdf(x * math.sqrt(2.0)) - 1.0


def normal_cdf(u: np.ndarray) -> np.ndarray:
    """The normal distribution function, by the same formula; few temporary arrays."""
    # The published coefficients.
    p = 0.3275911
    coefficients = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
    a = np.abs(u)
    a *= math.sqrt(0.5)
    t = a * p
    t += 1.0
    np.reciprocal(t, out=t)
    tail = np.full_like(t, coefficients[0])
    for c in coefficients[1:]:
        tail *= t
        tail += c
    tail *= t
    np.multiply(a, a, out=a)
    np.negative(a, out=a)
    tail *= np.exp(a, out=a)
    tail *= 0.5
    return np.where(u >= 0.0, 1.0 - tail, tail)


def logits(
    flat: np.ndarray,
    dims: Sequence[int],
    x: np.ndarray,
    tape: list | None = None,
    dropout: float = 0.0,
    rng: np.random.Generator | None = None,
) -> np.ndarray:
    """Forward pass; with a ``tape`` it records what the backward pass needs.

    Computes in the precision of ``flat`` and ``x``.
    """
    p = unpack(flat, dims)
    last = len(dims) - 2
    for i in range(last + 1):
        z = x @ p[f"w{i}"].T
        z += p[f"b{i}"]
        if i == last:
            if tape is not None:
                tape.append((x,))
            return z
        z -= z.mean(axis=1, keepdims=True)
        scale = np.einsum("ij,ij->i", z, z)[:, None] / z.shape[1] + LAYER_NORM_EPS
        np.sqrt(scale, out=scale)
        np.reciprocal(scale, out=scale)
        z *= scale
        normed = z if tape is None else z.copy()
        u = z
        u *= p[f"g{i}"]
        u += p[f"s{i}"]
        phi = normal_cdf(u)
        out = u * phi
        mask = None
        if dropout > 0.0 and rng is not None:
            mask = (rng.random(out.shape, dtype=np.float32) >= dropout).astype(out.dtype)
            mask /= 1.0 - dropout
            out *= mask
        if tape is not None:
            tape.append((x, normed, scale, u, phi, mask))
        x = out
    return x


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(
    flat: np.ndarray,
    dims: Sequence[int],
    x: np.ndarray,
    y: np.ndarray,
    dropout: float = 0.0,
    rng: np.random.Generator | None = None,
) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a mini-batch and its gradient in the flat vector."""
    tape: list = []
    probs = softmax_rows(logits(flat, dims, x, tape, dropout, rng))
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(probs[rows, y], 1e-300)).mean())
    p = unpack(flat, dims)
    gradient = np.zeros_like(flat)
    g = unpack(gradient, dims)
    delta = probs
    delta[rows, y] -= 1.0
    delta /= len(y)
    for i in range(len(dims) - 2, -1, -1):
        if i < len(dims) - 2:
            _, normed, scale, u, phi, mask = tape[i]
            if mask is not None:
                delta = delta * mask
            density = np.exp(-0.5 * u * u) / math.sqrt(2.0 * math.pi)
            delta = delta * (phi + u * density)
            g[f"g{i}"][...] = (delta * normed).sum(axis=0)
            g[f"s{i}"][...] = delta.sum(axis=0)
            d = delta * p[f"g{i}"]
            delta = scale * (
                d - d.mean(axis=1, keepdims=True)
                - normed * (d * normed).mean(axis=1, keepdims=True)
            )
        g[f"w{i}"][...] = delta.T @ tape[i][0]
        g[f"b{i}"][...] = delta.sum(axis=0)
        delta = delta @ p[f"w{i}"]
    return loss, gradient


# Rows whose gradient is computed at once; a larger mini-batch is the sum of such blocks.
BLOCK = 4096

# The usual moments of AdamW.
BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8


def row_order(keys: np.ndarray, seed: int) -> np.ndarray:
    """Spark's ``xxhash64(seed, key)`` of whole numbers: where a row stands in an epoch."""
    # The published primes of the hash.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray, k: int) -> np.ndarray:
        return (v << np.uint64(k)) | (v >> np.uint64(64 - k))

    def hashed(value: np.ndarray, start: np.ndarray) -> np.ndarray:
        h = start + p5 + np.uint64(8)
        h = turned(h ^ (turned(value * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        begin = hashed(np.array([seed], np.int64).view(np.uint64), np.array([42], np.uint64))
        return hashed(np.ascontiguousarray(keys, np.int64).view(np.uint64), begin).view(np.int64)


def epoch_seed(seed: int, epoch: int) -> int:
    """The seed of an epoch's row order and dropout."""
    return int(np.random.SeedSequence((seed, epoch)).generate_state(1, np.uint64)[0] >> np.uint64(1))


def epoch_places(keys: np.ndarray, seed: int) -> np.ndarray:
    """Row indices in the order of an epoch: by hash, then by key."""
    return np.lexsort((keys, row_order(keys, seed)))


def gradient_sum(
    weights: np.ndarray, dims: Sequence[int], x: np.ndarray, y: np.ndarray, dropout: float = 0.0,
    seed: int = 0, batch: int = 0, first_block: int = 0, block: int = BLOCK,
) -> tuple[float, np.ndarray]:
    """Sums of losses and gradients of (a part of) a mini-batch, block by block.

    Dropout depends on the numbers of batch and block only, so that blocks may be computed anywhere.
    """
    total, gradient = 0.0, np.zeros_like(weights)
    for i, at in enumerate(range(0, len(y), block)):
        rng = np.random.default_rng((seed, batch, first_block + i)) if dropout > 0.0 else None
        part = slice(at, at + block)
        loss, mean = loss_and_gradient(weights, dims, x[part], y[part], dropout, rng)
        rows = len(y[part])
        total += loss * rows
        gradient += mean * rows
    return total, gradient


def first_state(weights: np.ndarray, optimizer: str = "sgd") -> np.ndarray:
    """What training carries from step to step: the weights, for AdamW also moments and step count."""
    if optimizer == "sgd":
        return weights.copy()
    return np.concatenate([weights, np.zeros(2 * len(weights) + 1)])


def apply_step(
    state: np.ndarray, gradient: np.ndarray, rate: float, optimizer: str = "sgd",
    decay: float = 0.01, mu: float = 0.0, anchor: np.ndarray | None = None,
) -> float:
    """One step in place by the mean gradient of a mini-batch; returns the loss of the pull.

    ``mu`` pulls the weights to ``anchor`` by ``mu/2 * |w - anchor|^2``.
    """
    n = len(gradient)
    w, pulled = state[:n], 0.0
    if mu > 0.0:
        pull = w - anchor
        pulled = 0.5 * mu * float(pull @ pull)
        gradient = gradient + mu * pull
    if optimizer == "sgd":
        w -= rate * gradient
        return pulled
    first, second = state[n:2 * n], state[2 * n:3 * n]
    state[3 * n] += 1.0
    steps = state[3 * n]
    w *= 1.0 - rate * decay
    first *= BETAS[0]
    first += (1.0 - BETAS[0]) * gradient
    second *= BETAS[1]
    second += (1.0 - BETAS[1]) * gradient**2
    root = np.sqrt(second / (1.0 - BETAS[1]**steps)) + ADAM_EPS
    w -= rate / (1.0 - BETAS[0]**steps) * first / root
    return pulled


def train_rows(
    state: np.ndarray, dims: Sequence[int], x: np.ndarray, y: np.ndarray, rate: float, batch: int,
    seed: int, first_batch: int = 0, dropout: float = 0.0, mu: float = 0.0,
    anchor: np.ndarray | None = None, optimizer: str = "sgd", decay: float = 0.01, block: int = BLOCK,
) -> float:
    """Mini-batches of rows that stand in the order of their epoch; the state changes in place.

    ``first_batch`` is the number of the first one in the epoch. Returns the sum of row losses.
    """
    n, total = parameter_count(dims), 0.0
    for number, at in enumerate(range(0, len(y), batch), first_batch):
        part = slice(at, at + batch)
        rows = len(y[part])
        loss, gradient = gradient_sum(
            state[:n].astype(x.dtype), dims, x[part], y[part], dropout, seed, number, 0, block)
        pulled = apply_step(
            state, gradient.astype(np.float64) / rows, rate, optimizer, decay, mu, anchor)
        total += loss + pulled * rows
    return total


def train_epochs(
    start: np.ndarray,
    dims: Sequence[int],
    x: np.ndarray,
    y: np.ndarray,
    epochs: int,
    rate: float,
    batch: int,
    seed: int,
    dropout: float = 0.0,
    mu: float = 0.0,
    anchor: np.ndarray | None = None,
    keys: np.ndarray | None = None,
    first_epoch: int = 0,
    optimizer: str = "sgd",
    decay: float = 0.01,
    block: int = BLOCK,
) -> tuple[np.ndarray, float]:
    """Epochs of mini-batches over rows held in memory; returns the state and the sum of row losses.

    Rows are ordered anew for each epoch by a hash of ``keys`` (default: their numbers), never by
    how they are stored. ``start`` is a state; ``anchor`` (default: its weights) and ``mu`` are
    those of ``apply_step``, whose pull is part of the loss. The gradient has the precision of
    ``x``, the state double precision.
    """
    state = start.copy()
    anchor = start[:parameter_count(dims)] if anchor is None else anchor
    keys = np.arange(len(y)) if keys is None else keys
    total = 0.0
    for epoch in range(first_epoch, first_epoch + epochs):
        own = epoch_seed(seed, epoch)
        order = epoch_places(keys, own)
        total += train_rows(
            state, dims, x[order], y[order], rate, batch, own, 0, dropout, mu, anchor, optimizer,
            decay, block)
    return state, total
