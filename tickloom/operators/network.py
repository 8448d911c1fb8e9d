"""A small feed-forward network, trained for each group of rows in a task of its own.

A group's training rows are bounded by the feature itself (the newest 5,000 of a pool), so a grouped map holds them: groups are
trained beside one another, and within a group batches follow one another in a seeded order. Numbers are kept in
32 bits and summed in 64, gradients of a batch row by row in 32, so that equal seeds give equal losses."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np

_F = np.float32
#: The optimizer's, and the generator's increment, shifts and bits.
B1, B2, EPS = 0.9, 0.999, 1e-8
VERSION = 1


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Numbers ``first`` (from 1) and following of a seed's sequence: the generator only counts, so any of them at once."""
    mask = np.uint64(0xFFFFFFFF)
    step = np.arange(first, first + count, dtype=np.uint64)
    t = (np.uint64((seed & 0xFFFFFFFF) or 1) + step * np.uint64(0x6D2B79F5)) & mask
    t = ((t ^ (t >> np.uint64(15))) * (t | np.uint64(1))) & mask
    more = ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask
    t ^= (t + more) & mask
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


@dataclass
class Draws:
    """A seed's sequence and how much of it is used up."""

    seed: int
    used: int = 0

    def take(self, count: int) -> np.ndarray:
        self.used += count
        return draws(self.seed, self.used - count + 1, count)

    def normals(self, count: int) -> np.ndarray:
        """Normal numbers, two from each pair of draws; a draw of 0 in the first place is drawn again."""
        out: list[np.ndarray] = []
        pairs = -(-count // 2)
        while pairs:
            x = self.take(2 * pairs)
            zero = np.flatnonzero(x[0::2] < 1e-12)
            whole = int(zero[0]) if len(zero) else pairs
            u, v = x[0 : 2 * whole : 2], x[1 : 2 * whole : 2]
            size = np.sqrt(-2.0 * np.log(u))
            out.append(np.stack([size * np.cos(2 * math.pi * v), size * np.sin(2 * math.pi * v)], axis=1).reshape(-1))
            self.used -= 2 * (pairs - whole) - (1 if whole < pairs else 0)
            pairs -= whole
        return np.concatenate(out)[:count] if out else np.zeros(0)

    def shuffled(self, n: int) -> np.ndarray:
        """0 to n - 1 in a drawn order: from the last place down, each changes with one at or before it."""
        order = list(range(n))
        for i, x in zip(range(n - 1, 0, -1), self.take(max(0, n - 1)), strict=True):
            j = int(x * (i + 1))
            order[i], order[j] = order[j], order[i]
        return np.array(order, dtype=np.int64)


def _act(name: str, z: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(z, 0.0)
    if name == "tanh":
        return np.tanh(z)
    return 1.0 / (1.0 + np.exp(-z)) if name == "sigmoid" else z


def _slope(name: str, a: np.ndarray) -> np.ndarray:
    if name == "relu":
        return (a > 0).astype(np.float64)
    if name == "tanh":
        return 1.0 - a * a
    return a * (1.0 - a) if name == "sigmoid" else np.ones_like(a)


def losses(name: str, guess: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss of each row, summed over outputs."""
    if name == "bce":
        p = np.clip(guess, 1e-7, 1 - 1e-7)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(axis=1)
    return (0.5 * (guess - y) ** 2).sum(axis=1)


@dataclass
class Network:
    """layers: (inputs, outputs, activation) in a row; loss 'mse' or 'bce'; optimizer 'adam' or 'sgd'."""

    layers: list[tuple[int, int, str]]
    loss: str = "bce"
    optimizer: str = "adam"
    rate: float = 0.01
    l2: float = 0.0
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    step: int = 0

    def __post_init__(self) -> None:
        if not self.layers or any(i <= 0 or o <= 0 for i, o, _ in self.layers) or any(a[1] != b[0] for a, b in zip(self.layers, self.layers[1:])):  # noqa: B905
            raise ValueError("layers do not fit one another")
        if any(act not in ("relu", "sigmoid", "tanh", "linear") for _, _, act in self.layers):
            raise ValueError("unknown activation")
        self.draws = Draws((self.seed & 0xFFFFFFFF) or 1)
        if not self.weights:
            spread = self.draws.normals(sum(i * o for i, o, _ in self.layers))
            at = 0
            for i, o, act in self.layers:
                scale = math.sqrt((2 if act == "relu" else 1) / i)
                self.weights.append((spread[at : at + i * o] * scale).astype(_F).reshape(i, o))
                self.biases.append(np.zeros(o, dtype=_F))
                at += i * o
        self._moments = [[np.zeros_like(x) for x in group] for group in (self.weights, self.weights, self.biases, self.biases)]

    @property
    def parameters(self) -> int:
        return sum(w.size + b.size for w, b in zip(self.weights, self.biases, strict=True))

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        found = [x.astype(_F)]
        for (_, _, act), w, b in zip(self.layers, self.weights, self.biases, strict=True):
            z = b.astype(np.float64) + found[-1].astype(np.float64) @ w.astype(np.float64)
            found.append(_act(act, z).astype(_F))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.activations(x)[-1]

    def _gradients(self, acts: list[np.ndarray], y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each layer, weights' and biases' gradients summed over the batch, row after row in 32 bits."""
        delta = (acts[-1].astype(np.float64) - y).astype(_F)
        found = []
        for k in range(len(self.layers) - 1, -1, -1):
            act = self.layers[k][2]
            plain = k == len(self.layers) - 1 and (self.loss, act) in (("bce", "sigmoid"), ("mse", "linear"))
            if not plain:
                delta = (delta.astype(np.float64) * _slope(act, acts[k + 1].astype(np.float64))).astype(_F)
            each = (acts[k].astype(np.float64)[:, :, None] * delta.astype(np.float64)[:, None, :]).astype(_F)
            found.append((np.add.reduce(each, axis=0, dtype=_F), np.add.reduce(delta, axis=0, dtype=_F)))
            delta = (delta.astype(np.float64) @ self.weights[k].astype(np.float64).T).astype(_F)
        return found[::-1]

    def _update(self, gradients: list[tuple[np.ndarray, np.ndarray]], rows: int) -> None:
        self.step += 1
        c1, c2 = 1 - B1**self.step, 1 - B2**self.step
        for k, (gw, gb) in enumerate(gradients):
            for values, g, decay, m, v in ((self.weights, gw, self.l2, 0, 1), (self.biases, gb, 0.0, 2, 3)):
                now = values[k].astype(np.float64)
                g = g.astype(np.float64) * (1 / rows) + decay * now
                if self.optimizer == "sgd":
                    values[k] = (now - self.rate * g).astype(_F)
                    continue
                first = (B1 * self._moments[m][k].astype(np.float64) + (1 - B1) * g).astype(_F)
                second = (B2 * self._moments[v][k].astype(np.float64) + (1 - B2) * g * g).astype(_F)
                self._moments[m][k], self._moments[v][k] = first, second
                values[k] = (now - self.rate * (first.astype(np.float64) / c1) / (np.sqrt(second.astype(np.float64) / c2) + EPS)).astype(_F)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 32, held_out: float = 0.0) -> tuple[list[float], list[float]]:
        """Mean losses of each epoch: over the rows as they were met, and over the last ``held_out`` share after it."""
        if not len(x):
            return [], []
        x, y = x.astype(_F), y.astype(_F).reshape(len(x), -1)
        left = int(len(x) * max(0.0, min(0.9, held_out)))
        n, history, after = len(x) - left, [], []
        for _ in range(epochs):
            order, total = self.draws.shuffled(n), 0.0
            for begin in range(0, n, batch):
                rows = order[begin : begin + batch]
                acts = self.activations(x[rows])
                total += float(losses(self.loss, acts[-1].astype(np.float64), y[rows].astype(np.float64)).sum())
                self._update(self._gradients(acts, y[rows].astype(np.float64)), len(rows))
            history.append(total / n if n else math.nan)
            if left:
                after.append(float(losses(self.loss, self.predict(x[n:]).astype(np.float64), y[n:].astype(np.float64)).mean()))
        return history, after

    def saved(self) -> str:
        """The network as JSON; ``loaded`` gives it back with the same predictions."""
        return json.dumps({
            "version": VERSION, "layers": self.layers, "loss": self.loss, "optimizer": self.optimizer, "rate": self.rate, "l2": self.l2, "seed": self.seed, "step": self.step,
            "weights": [w.reshape(-1).tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases],
        })


def loaded(text: str) -> Network:
    kept = json.loads(text)
    if kept["version"] != VERSION:
        raise ValueError(f"a network of version {kept['version']}")
    layers = [(i, o, act) for i, o, act in kept["layers"]]
    weights = [np.array(w, dtype=_F).reshape(i, o) for w, (i, o, _) in zip(kept["weights"], layers, strict=True)]
    return Network(layers, kept["loss"], kept["optimizer"], kept["rate"], kept["l2"], kept["seed"], weights, [np.array(b, dtype=_F) for b in kept["biases"]], kept["step"])
