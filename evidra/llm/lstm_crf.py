"""A bidirectional LSTM over characters with a linear-chain CRF, in numpy: training by gradients, decoding by Viterbi.

Arrays are (time, lane, ...), lanes being windows side by side. ``live`` is 0 on padding, where states start anew
and the chain's scores do not change.
"""

from __future__ import annotations

import numpy as np

from evidra.llm.gru import rows_summed

OFF = np.float32(-1e4)


def start(rng: np.random.Generator, symbols: int, units: int, tags: int, follows: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters; ``follows[i, j]`` says whether tag j may come after tag i."""
    p: dict[str, np.ndarray] = {}
    for way in "ab":
        table = rng.normal(0, 0.3, (symbols, 4 * units))
        table[:, units : 2 * units] += 1.0  # forget gates begin by keeping the state
        p[f"table_{way}"] = table.astype(np.float32)
        p[f"hidden_{way}"] = rng.normal(0, units**-0.5, (units, 4 * units)).astype(np.float32)
    p["out"] = rng.normal(0, 0.1, (2 * units, tags)).astype(np.float32)
    p["bias"] = np.zeros(tags, np.float32)
    p["moves"] = np.where(follows, 0, OFF).astype(np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(table: np.ndarray, hidden: np.ndarray, symbols: np.ndarray, live: np.ndarray, keep: bool):
    u = len(hidden)
    steps, lanes = symbols.shape
    h = np.zeros((lanes, u), np.float32)
    c = np.zeros_like(h)
    states, kept = np.empty((steps, lanes, u), np.float32), []
    for t in range(steps):
        on = live[t][:, None]
        a = table[symbols[t]] + h @ hidden
        gates = _sigmoid(a[:, : 3 * u])
        i, f, o, g = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :], np.tanh(a[:, 3 * u :])
        new = (f * c + i * g) * on
        e = np.tanh(new)
        if keep:
            kept.append((h, c, i, f, o, g, e, on))
        h, c = o * e * on, new
        states[t] = h
    return states, kept


def _back(hidden: np.ndarray, symbols: np.ndarray, kept: list, d_states: np.ndarray, n: int):
    u = len(hidden)
    d_hidden = np.zeros_like(hidden)
    d_inputs = np.empty((*symbols.shape, 4 * u), np.float32)
    dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    for t in range(len(symbols) - 1, -1, -1):
        h, c, i, f, o, g, e, on = kept[t]
        d = (d_states[t] + dh) * on
        d_new = (d * o * (1 - e * e) + dc) * on
        da = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d * e * o * (1 - o), d_new * i * (1 - g * g)], 1)
        d_inputs[t] = da
        d_hidden += h.T @ da
        dh, dc = da @ hidden.T, d_new * f
    return rows_summed(symbols.ravel(), d_inputs.reshape(-1, 4 * u), n), d_hidden


def emissions(p: dict, symbols: np.ndarray, live: np.ndarray, keep: bool = False):
    ahead, kept_a = _run(p["table_a"], p["hidden_a"], symbols, live, keep)
    behind, kept_b = _run(p["table_b"], p["hidden_b"], symbols[::-1], live[::-1], keep)
    both = np.concatenate([ahead, behind[::-1]], 2)
    return both @ p["out"] + p["bias"], both, kept_a, kept_b


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gradients(p: dict, symbols: np.ndarray, live: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative log-likelihood of a character's tag, and its gradients.

    Every lane's first position is live, and live positions are adjacent.
    """
    em, both, kept_a, kept_b = emissions(p, symbols, live, True)
    steps, lanes, k = em.shape
    moves = p["moves"]
    alpha = np.empty_like(em)
    alpha[0] = em[0]
    for t in range(1, steps):
        new = em[t] + _log_sum(alpha[t - 1][:, :, None] + moves, 1)
        alpha[t] = np.where(live[t][:, None] > 0, new, alpha[t - 1])
    total = _log_sum(alpha[-1], 1)
    beta = np.zeros_like(em)
    d_moves = np.zeros_like(moves)
    gold = np.zeros(lanes)
    lane = np.arange(lanes)
    for t in range(steps - 1, 0, -1):
        on = live[t]
        ahead = moves + (em[t] + beta[t])[:, None, :]
        pair = np.exp(alpha[t - 1][:, :, None] + ahead - total[:, None, None]) * on[:, None, None]
        d_moves += pair.sum(0)
        np.subtract.at(d_moves, (tags[t - 1][on > 0], tags[t][on > 0]), 1)
        gold += moves[tags[t - 1], tags[t]] * on
        beta[t - 1] = np.where(on[:, None] > 0, _log_sum(ahead, 2), beta[t])
    d_em = np.exp(alpha + beta - total[None, :, None])
    d_em[np.arange(steps)[:, None], lane[None, :], tags] -= 1
    n = live.sum()
    d_em *= (live / n)[:, :, None]
    gold += (np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] * live).sum(0)
    flat = d_em.reshape(-1, k).astype(np.float32)
    d_both = (flat @ p["out"].T).reshape(both.shape)
    u = p["hidden_a"].shape[0]
    table_a, hidden_a = _back(p["hidden_a"], symbols, kept_a, d_both[:, :, :u], len(p["table_a"]))
    table_b, hidden_b = _back(p["hidden_b"], symbols[::-1], kept_b, d_both[::-1, :, u:], len(p["table_b"]))
    grads = {
        "table_a": table_a, "hidden_a": hidden_a, "table_b": table_b, "hidden_b": hidden_b, "out": both.reshape(-1, 2 * u).T @ flat,
        "bias": flat.sum(0), "moves": np.where(moves <= OFF / 2, 0, d_moves / n).astype(np.float32),
    }
    return float((total - gold).sum() / n), grads


def decoded(p: dict, symbols: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best tags of every position, and how much more each scores there than tag 0 after tag 0."""
    em = emissions(p, symbols, live)[0]
    steps, lanes, _ = em.shape
    best, back = em[0], np.zeros(em.shape, np.int8)
    for t in range(1, steps):
        through = best[:, :, None] + p["moves"]
        back[t] = through.argmax(1)
        best = np.where(live[t][:, None] > 0, through.max(1) + em[t], best)
    tags = np.zeros((steps, lanes), np.int64)
    at = best.argmax(1)
    lane = np.arange(lanes)
    for t in range(steps - 1, -1, -1):
        tags[t] = np.where(live[t] > 0, at, 0)
        at = np.where(live[t] > 0, back[t][lane, at], at)
    gain = np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]
    gain[1:] += p["moves"][tags[:-1], tags[1:]] - p["moves"][0, 0]
    return tags, gain
