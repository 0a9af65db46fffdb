"""A bidirectional gated recurrent network over bytes, in numpy.

Arrays are laid out features first, so that gates are contiguous rows. Gates use
``sigmoid(2 v) = (1 + tanh(v)) / 2``; the factor 2 is left to the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Direction:
    """One direction: ``table`` (3h, 256) of inputs to the gates by byte, ``rec`` (3h, h)."""

    table: np.ndarray
    rec: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> Direction:
        return cls(rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32), rng.normal(0, hidden**-0.5 / 2, (3 * hidden, hidden)).astype(np.float32))

    @property
    def hidden(self) -> int:
        return self.rec.shape[1]

    def run(self, x: np.ndarray, out: np.ndarray, weight: np.ndarray) -> None:
        """Add ``weight`` @ state to ``out[t]`` for each step of ``x`` (steps, batch)."""
        k, n = self.hidden, x.shape[1]
        h = np.zeros((k, n), np.float32)
        g, a = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        part = np.empty((weight.shape[0], n), np.float32)
        for t in range(len(x)):
            np.take(self.table, x[t], axis=1, out=g, mode="clip")
            np.matmul(self.rec, h, out=a)
            gates = g[: 2 * k]
            gates += a[: 2 * k]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new, r, z = g[2 * k :], g[:k], g[k : 2 * k]
            r *= a[2 * k :]
            new += r
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            out[t] += np.matmul(weight, h, out=part)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The states (steps + 1, h, batch) and what the backward pass needs."""
        k = self.hidden
        states, kept = [np.zeros((k, x.shape[1]), np.float32)], []
        for row in x:
            h = states[-1]
            g, a = self.table[:, row], self.rec @ h
            gates = (np.tanh(g[: 2 * k] + a[: 2 * k]) + 1) / 2
            r, z = gates[:k], gates[k:]
            new = np.tanh(g[2 * k :] + r * a[2 * k :])
            kept.append((r, z, new, a[2 * k :]))
            states.append(new + z * (h - new))
        return np.stack(states), kept

    def backward(self, x: np.ndarray, states: np.ndarray, kept: list[tuple], d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``table`` and ``rec`` by backpropagation through time; ``d_out`` is (steps, h, batch)."""
        d_rec = np.zeros_like(self.rec)
        d_in = np.empty((len(x), x.shape[1], 3 * self.hidden), np.float32)
        dh = np.zeros_like(states[0])
        for t in range(len(x) - 1, -1, -1):
            (r, z, new, a_new), before = kept[t], states[t]
            dh = dh + d_out[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (before - new) * 2 * z * (1 - z)
            d_r = d_new * a_new * 2 * r * (1 - r)
            d_in[t] = np.concatenate([d_r, d_z, d_new]).T
            d_a = np.concatenate([d_r, d_z, d_new * r])
            d_rec += d_a @ before.T
            dh = dh * z + self.rec.T @ d_a
        d_table = np.zeros((256, d_in.shape[2]), np.float32)
        np.add.at(d_table, x.reshape(-1), d_in.reshape(-1, d_in.shape[2]))
        return d_table.T, d_rec


class ByteTagger:
    """Labels every byte of a segment; weights of both directions and of the output."""

    def __init__(self, classes: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.left, self.right = Direction.fresh(hidden, rng), Direction.fresh(hidden, rng)
        self.weight = rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((classes, 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.left.table, self.left.rec, self.right.table, self.right.rec, self.weight, self.bias]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, classes, batch) of the segments ``x`` (steps, batch)."""
        k = self.left.hidden
        out = np.empty((x.shape[0], len(self.bias), x.shape[1]), np.float32)
        out[:] = self.bias
        self.left.run(x, out, self.weight[:, :k])
        self.right.run(x[::-1], out[::-1], self.weight[:, k:])
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients; ``y`` (batch) is the label of all positions, ``weight`` (steps, batch) theirs."""
        k = self.left.hidden
        hl, kl = self.left.forward(x)
        hr, kr = self.right.forward(x[::-1])
        both = np.concatenate([hl[1:], hr[:0:-1]], axis=1)
        logits = self.weight @ both + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        total = weight.sum()
        at = np.arange(len(y))
        loss = -(np.log(p[:, y, at] + 1e-9) * weight).sum() / total
        d = p
        d[:, y, at] -= 1
        d *= (weight / total)[:, None, :]
        d_both = self.weight.T @ d
        d_weight = np.einsum("tcb,thb->ch", d, both, optimize=True)
        lt, lr = self.left.backward(x, hl, kl, d_both[:, :k])
        rt, rr = self.right.backward(x[::-1], hr, kr, d_both[::-1, k:])
        return float(loss), [lt, lr, rt, rr, d_weight, d.sum(axis=(0, 2))[:, None]]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 0) -> None:
        """About ``steps`` steps of Adam over shuffled batches of the columns of ``x``; the rate falls linearly."""
        rng = np.random.default_rng(seed)
        ps = self.parameters()
        m, v = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        batch = min(batch, -(-len(y) // 4))
        each = -(-len(y) // batch)
        epochs = -(-steps // each)
        steps = epochs * each
        turn = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                own = order[i : i + batch]
                _, gs = self.gradients(x[:, own], y[own], weight[:, own])
                turn += 1
                now = rate * (1 - (turn - 1) / steps)
                for j, (p, g) in enumerate(zip(ps, gs)):
                    g = np.clip(g, -1, 1)
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    p -= (now * (m[j] / (1 - 0.9**turn)) / (np.sqrt(v[j] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
