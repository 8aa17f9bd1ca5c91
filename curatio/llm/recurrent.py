"""Gated recurrent layers in numpy, with backpropagation through time.

A layer reads a sequence of precomputed gate inputs ``x`` of shape
(steps, rows, 3 * hidden) and returns its states (steps, rows, hidden).
Columns of the gates: update, reset, candidate.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_forward(x: np.ndarray, u: np.ndarray, keep: bool = False):
    """States; with ``keep`` also what the backward pass needs."""
    steps, rows, width = x.shape
    n = width // 3
    h = np.zeros((rows, n), x.dtype)
    states = np.empty((steps, rows, n), x.dtype)
    saved = []
    for t in range(steps):
        a = h @ u
        gates = sigmoid(x[t, :, :2 * n] + a[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n:] + r * a[:, 2 * n:])
        if keep:
            saved.append((h, z, r, c, a[:, 2 * n:]))
        h = c + z * (h - c)
        states[t] = h
    return (states, saved) if keep else states


def gru_backward(d_states: np.ndarray, u: np.ndarray, saved: list):
    """Gradients of the gate inputs and of the recurrent weights."""
    steps, rows, n = d_states.shape
    d_x = np.empty((steps, rows, 3 * n), d_states.dtype)
    d_u = np.zeros_like(u)
    d_h = np.zeros((rows, n), d_states.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, a = saved[t]
        d_h = d_h + d_states[t]
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (h - c) * z * (1 - z)
        d_r = d_c * a * r * (1 - r)
        d_a = np.concatenate((d_z, d_r, d_c * r), axis=1)
        d_x[t] = np.concatenate((d_z, d_r, d_c), axis=1)
        d_u += h.T @ d_a
        d_h = d_h * z + d_a @ u.T
    return d_x, d_u


class Adam:
    """Parameter updates with running moments, and clipped gradients."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 1.0):
        self.params, self.rate, self.clip, self.step = params, rate, clip, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            m = self.first[k] / (1 - 0.9 ** self.step)
            v = self.second[k] / (1 - 0.99 ** self.step)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
