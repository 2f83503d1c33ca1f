"""Gated recurrent layers in numpy: forward and backward passes, and an optimiser.

Arrays run (step, row, feature).  Gates: reset r, update z, candidate c with
``c = tanh(x_c + r * (h U_c + b_c))`` and ``h' = z * h + (1 - z) * c``.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Next state from projected inputs ``x`` (row, 3 * size)."""
    n = h.shape[1]
    g = h @ u
    g += b
    gate = sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
    g[:, 2 * n :] *= gate[:, :n]
    g[:, 2 * n :] += x[:, 2 * n :]
    c = np.tanh(g[:, 2 * n :])
    return c + gate[:, n:] * (h - c)


def forward(x: np.ndarray, h: np.ndarray, u: np.ndarray, b: np.ndarray, resets: list[np.ndarray] | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """States after each step, and what :func:`backward` needs.

    With ``resets``, the rows named for a step begin it with the state ``start``.
    """
    n, steps = h.shape[1], len(x)
    states = np.empty((steps + 1, *h.shape), F32)
    gates = np.empty((steps, h.shape[0], 3 * n), F32)
    inner = np.empty((steps, *h.shape), F32)
    states[0] = h
    for t in range(steps):
        if resets is not None and len(resets[t]):
            states[t][resets[t]] = start
        g = states[t] @ u
        g += b
        gates[t, :, : 2 * n] = sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
        inner[t] = g[:, 2 * n :]
        gates[t, :, 2 * n :] = np.tanh(x[t, :, 2 * n :] + gates[t, :, :n] * inner[t])
        states[t + 1] = gates[t, :, 2 * n :] + gates[t, :, n : 2 * n] * (states[t] - gates[t, :, 2 * n :])
    return states[1:], (states, gates, inner)


def backward(grad: np.ndarray, kept: tuple, u: np.ndarray, resets: list[np.ndarray] | None = None, d_start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of projected inputs, recurrent weights, bias and first state, from those of the states.

    With ``resets``, what reaches a reset state is added to ``d_start`` and goes back no further.
    """
    states, gates, inner = kept
    steps, _, n = inner.shape
    dx = np.empty_like(gates)
    dg = np.empty_like(gates)
    dh = np.zeros_like(states[0])
    r, z, c = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :]
    of_c = (1 - z) * (1 - c * c)
    of_z = (states[:-1] - c) * z * (1 - z)
    of_r = of_c * inner * r * (1 - r)
    of_inner = of_c * r
    back = np.ascontiguousarray(u.T)
    for t in range(steps - 1, -1, -1):
        dh = dh + grad[t]
        np.multiply(dh, of_r[t], out=dg[t, :, :n])
        np.multiply(dh, of_z[t], out=dg[t, :, n : 2 * n])
        np.multiply(dh, of_inner[t], out=dg[t, :, 2 * n :])
        np.multiply(dh, of_c[t], out=dx[t, :, 2 * n :])
        dh *= z[t]
        dh += dg[t] @ back
        if resets is not None and len(resets[t]):
            d_start += dh[resets[t]].sum(0)
            dh[resets[t]] = 0
    dx[:, :, : 2 * n] = dg[:, :, : 2 * n]
    flat = dg.reshape(-1, 3 * n)
    return dx, states[:-1].reshape(-1, n).T @ flat, flat.sum(0), dh


class Adam:
    """Adam over a dictionary of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())))
        scale = F32(min(1.0, clip / max(norm, 1e-12)))
        self.t += 1
        rate = F32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            weights[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def scatter_rows(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``rows`` by ``index``, as a table of ``size`` rows."""
    order = np.argsort(index, kind="stable")
    at, start = np.unique(index[order], return_index=True)
    out = np.zeros((size, rows.shape[1]), F32)
    if len(at):
        out[at] = np.add.reduceat(rows[order], start)
    return out
