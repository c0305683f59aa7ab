"""A small bidirectional LSTM in numpy: every block's label from the whole sequence, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(dims: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for d in "fb":
        out[f"x{d}"] = rng.normal(0, (1 / dims) ** 0.5, (dims, 4 * hidden))
        out[f"h{d}"] = rng.normal(0, (1 / hidden) ** 0.5, (hidden, 4 * hidden))
        out[f"c{d}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # forget gates start open
    out["out"] = rng.normal(0, (1 / hidden) ** 0.5, 2 * hidden)
    out["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in out.items()}


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[steps, sequences, dims] and the mask [steps, sequences]."""
    steps = max(map(len, sequences))
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k] = s
        mask[: len(s), k] = 1
    return x, mask


def _run(w: dict[str, np.ndarray], d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction; where the mask is 0 the state stays zero, so reversed padding does no harm."""
    steps, n, _ = x.shape
    hidden = w[f"h{d}"].shape[0]
    z = x @ w[f"x{d}"] + w[f"c{d}"]
    h = np.zeros((n, hidden), np.float32)
    c = np.zeros_like(h)
    hs = np.zeros((steps, n, hidden), np.float32)
    kept = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = z[t] + h @ w[f"h{d}"]
        s = _sigmoid(g[:, : 3 * hidden])
        f, i, o, u = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(g[:, 3 * hidden :])
        m = mask[t][:, None]
        c_new = (f * c + i * u) * m
        tc = np.tanh(c_new)
        h_new = o * tc * m
        if keep:
            kept.append((t, f, i, o, u, c, h, tc, m))
        h, c = h_new, c_new
        hs[t] = h
    return hs, kept


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Probability of each step, [steps, sequences]."""
    hf, kf = _run(w, "f", x, mask, keep)
    hb, kb = _run(w, "b", x, mask, keep)
    both = np.concatenate([hf, hb], axis=2)
    return _sigmoid(both @ w["out"] + w["bias"]), both, (kf, kb)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the unmasked steps and its gradients."""
    p, both, kept = forward(w, x, mask, keep=True)
    total = max(1.0, float(mask.sum()))
    loss = -float(((y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)) * mask).sum()) / total
    dz = ((p - y) * mask / total).astype(np.float32)
    g = {"out": (both * dz[..., None]).sum((0, 1)), "bias": np.array([dz.sum()], np.float32)}
    dboth = dz[..., None] * w["out"]
    hidden = w["hf"].shape[0]
    for d, steps, dh_all in (("f", kept[0], dboth[..., :hidden]), ("b", kept[1], dboth[..., hidden:])):
        gates = np.zeros((*x.shape[:2], 4 * hidden), np.float32)
        g[f"h{d}"] = np.zeros_like(w[f"h{d}"])
        dh = np.zeros((x.shape[1], hidden), np.float32)
        dc = np.zeros_like(dh)
        for t, f, i, o, u, c, h, tc, m in reversed(steps):
            dh = (dh + dh_all[t]) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            gate = np.concatenate([dc * c * f * (1 - f), dc * u * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            gates[t] = gate
            g[f"h{d}"] += h.T @ gate
            dh = gate @ w[f"h{d}"].T
            dc = dc * f
        g[f"x{d}"] = np.tensordot(x, gates, ([0, 1], [0, 1]))
        g[f"c{d}"] = gates.sum((0, 1))
    return loss, g


def train(sequences: list[np.ndarray], labels: list[np.ndarray], hidden: int = 16, epochs: int = 18, batch: int = 48, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted by Adam; the same input gives the same weights."""
    w = new_weights(sequences[0].shape[1], hidden, seed)
    rng = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(sequences))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            x, mask = pad([sequences[r] for r in rows])
            y, _ = pad([labels[r][:, None] for r in rows])
            _, g = gradients(w, x, mask, y[..., 0])
            step += 1
            now = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return w


def predict(w: dict[str, np.ndarray], sequences: list[np.ndarray], batch: int = 256, most_steps: int = 1 << 16) -> list[np.ndarray]:
    """Probabilities per sequence; sequences of like lengths run together, at most ``most_steps`` padded steps at a time."""
    out = [np.zeros(0, np.float32)] * len(sequences)
    order = sorted((k for k, s in enumerate(sequences) if len(s)), key=lambda k: len(sequences[k]))
    while order:
        longest = len(sequences[order[-1]])
        n = max(1, min(batch, most_steps // longest, len(order)))
        rows, order = order[-n:], order[:-n]
        x, mask = pad([sequences[k] for k in rows])
        p, _, _ = forward(w, x, mask)
        for j, k in enumerate(rows):
            out[k] = p[: len(sequences[k]), j]
    return out
