"""Gated recurrent units in numpy: many sequences side by side, and backpropagation through time.

A symbol's row of ``table`` holds its input to the three gates (update, reset, candidate), biases
included; ``hidden`` maps the last state to them. Gates are piecewise linear, 1/2 + x/4 between 0 and 1.
Training arrays are (time, sequence, unit); the step for reading has one row per unit.
"""

from __future__ import annotations

import numpy as np


def start(rng: np.random.Generator, symbols: int, units: int) -> dict[str, np.ndarray]:
    table = rng.normal(0, 0.3, (symbols, 3 * units))
    table[:, :units] += 1.0  # update gates begin by keeping the state
    return {"table": table.astype(np.float32), "hidden": rng.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)}


def _gate(x: np.ndarray) -> np.ndarray:
    x *= 0.25
    x += 0.5
    np.maximum(x, 0, out=x)
    return np.minimum(x, 1, out=x)


class Reader:
    """A network laid out for reading: states are (unit, sequence)."""

    def __init__(self, p: dict):
        self.table, self.hidden = np.ascontiguousarray(p["table"].T), np.ascontiguousarray(p["hidden"].T)
        self.units = len(p["hidden"])

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state."""
        u = self.units
        a = self.table.take(symbols, axis=1)
        g = self.hidden @ h
        zr = a[: 2 * u]
        zr += g[: 2 * u]
        _gate(zr)
        n = zr[u:]
        n *= g[2 * u :]
        n += a[2 * u :]
        np.tanh(n, out=n)
        out = h - n
        out *= zr[:u]
        out += n
        return out


def run(p: dict, symbols: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """All states of a window, and what backpropagation needs; where ``keep`` is 0 the state starts anew."""
    u = h.shape[-1]
    states, kept = np.empty((len(symbols), *h.shape), np.float32), []
    for t, s in enumerate(symbols):
        if keep is not None:
            h = h * keep[t][:, None]
        a, g = p["table"][s], h @ p["hidden"]
        zr = _gate(a[:, : 2 * u] + g[:, : 2 * u])
        z, r, gn = zr[:, :u], zr[:, u:], g[:, 2 * u :]
        n = np.tanh(a[:, 2 * u :] + r * gn)
        kept.append((h, z, r, n, gn))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def back(p: dict, symbols: np.ndarray, kept: list, d_states: np.ndarray, keep: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of a loss with the given gradients at the states; the state before the window is fixed."""
    u = d_states.shape[-1]
    d_hidden = np.zeros_like(p["hidden"])
    d_inputs = np.empty((*symbols.shape, 3 * u), np.float32)
    carried = np.zeros_like(d_states[0])
    slope = d_states.dtype.type(0.25)
    for t in range(len(symbols) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        d = d_states[t] + carried
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * (slope * ((z > 0) & (z < 1)))
        dr = dn * gn * (slope * ((r > 0) & (r < 1)))
        d_inputs[t] = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        d_hidden += h.T @ dg
        carried = d * z + dg @ p["hidden"].T
        if keep is not None:
            carried = carried * keep[t][:, None]
    return {"table": rows_summed(symbols.ravel(), d_inputs.reshape(-1, 3 * u), len(p["table"])), "hidden": d_hidden}


def rows_summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    if len(heads):
        out[ordered[heads]] = np.add.reduceat(rows[order], heads, axis=0)
    return out


class Adam:
    """Adaptive steps for a dictionary of parameters; gradients are clipped by their norm."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, clip: float = 1.0):
        self.p, self.rate, self.clip, self.t = p, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            up = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
            self.p[k] -= ((rate or self.rate) * up).astype(np.float32)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, in place."""
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x
