"""The network against one written out number by number."""

import math

import numpy as np
import pytest

from tickloom.operators import network

f = np.float32


class Plain:
    """One weight after the other."""

    def __init__(self, layers, loss, rate, l2, seed):
        self.layers, self.loss, self.rate, self.l2, self.state, self.spare, self.step = layers, loss, rate, l2, seed or 1, None, 0
        self.w = [[[f(self.normal() * math.sqrt((2 if act == "relu" else 1) / i)) for _ in range(o)] for _ in range(i)] for i, o, act in layers]
        self.b = [[f(0)] * o for _, o, _ in layers]
        zeros = lambda x: [[f(0)] * len(r) if isinstance(r, list) else f(0) for r in x]
        self.m = [[zeros(x) for x in g] for g in (self.w, self.w, self.b, self.b)]

    def rand(self):
        mask = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & mask
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & mask)) & mask
        return ((t ^ (t >> 14)) & mask) / 4294967296

    def normal(self):
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        u = 0.0
        while u < 1e-12:
            u = self.rand()
        v = self.rand()
        self.spare = math.sqrt(-2 * math.log(u)) * math.sin(2 * math.pi * v)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)

    def forward(self, x):
        acts = [[f(v) for v in x]]
        for (i, o, act), w, b in zip(self.layers, self.w, self.b, strict=True):
            row = []
            for j in range(o):
                z = float(b[j])
                for k in range(i):
                    z += float(acts[-1][k]) * float(w[k][j])
                row.append(f(max(z, 0) if act == "relu" else math.tanh(z) if act == "tanh" else 1 / (1 + math.exp(-z)) if act == "sigmoid" else z))
            acts.append(row)
        return acts

    def lose(self, guess, y):
        if self.loss == "mse":
            return sum(0.5 * (float(g) - v) ** 2 for g, v in zip(guess, y, strict=True))
        return sum(-(v * math.log(min(1 - 1e-7, max(1e-7, float(g)))) + (1 - v) * math.log(1 - min(1 - 1e-7, max(1e-7, float(g))))) for g, v in zip(guess, y, strict=True))

    def fit(self, xs, ys, epochs, batch, held):
        left = int(len(xs) * held)
        n, history, after = len(xs) - left, [], []
        for _ in range(epochs):
            order = list(range(n))
            for i in range(n - 1, 0, -1):
                j = math.floor(self.rand() * (i + 1))
                order[i], order[j] = order[j], order[i]
            total = 0.0
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                gw = [[[f(0)] * o for _ in range(i)] for i, o, _ in self.layers]
                gb = [[f(0)] * o for _, o, _ in self.layers]
                for r in rows:
                    acts = self.forward(xs[r])
                    total += self.lose(acts[-1], ys[r])
                    delta = [f(float(a) - y) for a, y in zip(acts[-1], ys[r], strict=True)]
                    for k in range(len(self.layers) - 1, -1, -1):
                        act = self.layers[k][2]
                        if not (k == len(self.layers) - 1 and (self.loss, act) in (("bce", "sigmoid"), ("mse", "linear"))):
                            slope = {"relu": lambda a: 1.0 if a > 0 else 0.0, "tanh": lambda a: 1 - a * a, "sigmoid": lambda a: a * (1 - a), "linear": lambda a: 1.0}[act]
                            delta = [f(float(d) * slope(float(a))) for d, a in zip(delta, acts[k + 1], strict=True)]
                        for j, d in enumerate(delta):
                            gb[k][j] = f(gb[k][j] + d)
                        for i, p in enumerate(acts[k]):
                            for j, d in enumerate(delta):
                                gw[k][i][j] = f(gw[k][i][j] + f(float(p) * float(d)))
                        delta = [f(sum(float(self.w[k][i][j]) * float(d) for j, d in enumerate(delta))) for i in range(self.layers[k][0])]
                self.update(gw, gb, len(rows))
            history.append(total / n)
            if left:
                after.append(sum(self.lose(self.forward(xs[r])[-1], ys[r]) for r in range(n, len(xs))) / left)
        return history, after

    def update(self, gw, gb, n):
        self.step += 1
        c1, c2 = 1 - 0.9**self.step, 1 - 0.999**self.step

        def moved(w, g, l2, m, v):
            g = float(g) * (1 / n) + l2 * float(w)
            m, v = f(0.9 * float(m) + (1 - 0.9) * g), f(0.999 * float(v) + (1 - 0.999) * g * g)
            return f(float(w) - self.rate * (float(m) / c1) / (math.sqrt(float(v) / c2) + 1e-8)), m, v

        for k, (i, o, _) in enumerate(self.layers):
            for r in range(i):
                for j in range(o):
                    self.w[k][r][j], self.m[0][k][r][j], self.m[1][k][r][j] = moved(self.w[k][r][j], gw[k][r][j], self.l2, self.m[0][k][r][j], self.m[1][k][r][j])
            for j in range(o):
                self.b[k][j], self.m[2][k][j], self.m[3][k][j] = moved(self.b[k][j], gb[k][j], 0.0, self.m[2][k][j], self.m[3][k][j])


@pytest.mark.parametrize(("last", "loss"), [("tanh", "mse"), ("sigmoid", "bce"), ("linear", "mse")])
def test_equals_numbers_one_by_one(last, loss):
    draw = np.random.default_rng(1)
    xs = draw.normal(size=(90, 5)).astype(f)
    ys = (xs[:, :1] * 0.5 - xs[:, 1:2] > 0).astype(float)
    layers = [(5, 6, "relu"), (6, 3, "tanh"), (3, 1, last)]
    plain = Plain(layers, loss, 0.01, 1e-4, 42)
    net = network.Network(layers, loss, "adam", 0.01, 1e-4, 42)
    want, got = plain.fit(xs.tolist(), ys.tolist(), 4, 16, 0.2), net.fit(xs, ys, 4, 16, 0.2)
    assert np.allclose(want[0], got[0], rtol=1e-6) and np.allclose(want[1], got[1], rtol=1e-6)
    assert np.allclose([plain.forward(x)[-1][0] for x in xs.tolist()], net.predict(xs)[:, 0], atol=1e-6)
    again = network.loaded(net.saved())
    assert (again.predict(xs) == net.predict(xs)).all() and again.parameters == net.parameters == 5 * 6 + 6 + 6 * 3 + 3 + 3 + 1


def test_draws_and_orders_equal_the_stepped_generator():
    for seed in (1, 42, 0xFFFFFFFF):
        plain = Plain([(1, 1, "linear")], "mse", 0, 0, seed)
        plain.state, plain.spare = seed, None
        own = network.Draws(seed)
        assert np.allclose([plain.normal() for _ in range(40)], own.normals(40), rtol=1e-12)
        order = list(range(30))
        for i in range(29, 0, -1):
            j = math.floor(plain.rand() * (i + 1))
            order[i], order[j] = order[j], order[i]
        assert own.shuffled(30).tolist() == order


def test_layers_that_do_not_fit():
    with pytest.raises(ValueError):
        network.Network([(3, 2, "relu"), (3, 1, "tanh")])
    with pytest.raises(ValueError):
        network.Network([(3, 2, "cosine")])
    assert network.Network([(3, 1, "tanh")]).fit(np.zeros((0, 3)), np.zeros(0)) == ([], [])
