"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are frequent words, each in a class of its own kind's neighbours by frequency, and spelling
classes that stand for all other words. The state predicts the class, and for frequent words the
word in its class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOAT = np.float32
SHAPES = ("inputs", "state", "state_bias", "class_weight", "class_bias", "word_weight", "word_bias")


@dataclass(frozen=True)
class Sizes:
    """``heads`` frequent symbols in classes of ``width``, then ``tails`` spelling classes."""

    heads: int
    tails: int
    hidden: int = 32
    width: int = 48

    @property
    def head_classes(self) -> int:
        return -(-self.heads // self.width)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h, symbols = self.hidden, self.heads + self.tails
        classes = self.head_classes + self.tails
        return {"inputs": (symbols, 3 * h), "state": (h, 3 * h), "state_bias": (3 * h,),
                "class_weight": (h, classes), "class_bias": (classes,),
                "word_weight": (h, self.heads), "word_bias": (self.heads,)}


def start(sizes: Sizes, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the frequencies ``counts`` of the symbols."""
    rnd = np.random.default_rng(seed)
    out = {k: (rnd.standard_normal(s) * 0.08).astype(FLOAT) for k, s in sizes.shapes().items()}
    smooth = np.log(counts + 0.5)
    out["state_bias"][:] = 0
    out["word_bias"][:] = smooth[:sizes.heads]
    by_class = [np.log((counts[i:i + sizes.width] + 0.5).sum())
                for i in range(0, sizes.heads, sizes.width)]
    out["class_bias"][:] = np.concatenate([by_class, smooth[sizes.heads:]])
    out["class_bias"] -= out["class_bias"].max()
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(vector: np.ndarray, sizes: Sizes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in sizes.shapes().items():
        n = int(np.prod(shape))
        out[k] = np.ascontiguousarray(vector[at:at + n].reshape(shape), FLOAT)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + FLOAT(0.5)


def states(w: dict[str, np.ndarray], symbols: np.ndarray, keep: np.ndarray, h: np.ndarray,
           trace: list | None = None) -> np.ndarray:
    """States after each row of ``symbols`` (steps, lanes), from state ``h`` on; a lane's state is
    multiplied by ``keep`` (steps, lanes) before the step, so 0 begins a new text."""
    n = h.shape[1]
    out = np.empty((*symbols.shape, n), FLOAT)
    table, state, bias = w["inputs"], w["state"], w["state_bias"]
    for t in range(len(symbols)):
        h = h * keep[t][:, None]
        x = table[symbols[t]]
        x += bias
        u = h @ state
        gates = _sigmoid(x[:, :2 * n] + u[:, :2 * n])
        r, z = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n:] + r * u[:, 2 * n:])
        after = new + z * (h - new)
        if trace is not None:
            trace.append((h, u[:, 2 * n:], r, z, new))
        out[t] = h = after
    return out


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The softmax of each row, in place of it, and its log at one place."""
    x -= x.max(1, keepdims=True)
    mine = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x.sum(1, keepdims=True)
    x /= total
    return x, mine - np.log(total[:, 0])


def class_of(symbols: np.ndarray, sizes: Sizes) -> np.ndarray:
    return np.where(symbols < sizes.heads, symbols // sizes.width,
                    symbols - sizes.heads + sizes.head_classes)


def _by_class(target: np.ndarray, cls: np.ndarray, sizes: Sizes):
    """(rows, first word, words, place in class) for each class of frequent words that occurs."""
    head = np.flatnonzero(target < sizes.heads)
    order = head[np.argsort(cls[head], kind="stable")]
    cuts = np.searchsorted(cls[order], np.arange(sizes.head_classes + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        rows, first = order[cuts[c]:cuts[c + 1]], c * sizes.width
        yield rows, first, min(first + sizes.width, sizes.heads), target[rows] - first


def log_probs(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray,
              sizes: Sizes) -> np.ndarray:
    """Natural log of the probability of each target symbol after state ``h`` (rows, hidden)."""
    cls = class_of(target, sizes)
    out = _at_target(h @ w["class_weight"] + w["class_bias"], cls)
    for rows, a, b, place in _by_class(target, cls, sizes):
        out[rows] += _at_target(h[rows] @ w["word_weight"][:, a:b] + w["word_bias"][a:b], place)
    return out


def _at_target(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row."""
    x -= x.max(1, keepdims=True)
    mine = x[np.arange(len(x)), target].astype(np.float64)
    np.exp(x, out=x)
    return mine - np.log(x.sum(1))


def gradients(w: dict[str, np.ndarray], symbols: np.ndarray, target: np.ndarray, live: np.ndarray,
              h: np.ndarray, sizes: Sizes,
              keep: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over the ``live`` targets of a stretch (steps, lanes), the state
    after it, and the summed loss. Back-propagation ends where the stretch begins, and where
    ``keep`` is 0, at the beginning of a text."""
    steps, lanes = symbols.shape
    n, trace = sizes.hidden, []
    keep = np.ones(symbols.shape, FLOAT) if keep is None else keep.astype(FLOAT)
    out = states(w, symbols, keep, h, trace)
    flat_h, t, on = out.reshape(-1, n), target.ravel(), live.ravel()
    cls = class_of(t, sizes)
    count = max(1, int(on.sum()))
    scale = (on / count).astype(FLOAT)[:, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}

    d, logs = _softmax(flat_h @ w["class_weight"] + w["class_bias"], cls)
    loss = -float((logs * on).sum())
    d[np.arange(len(t)), cls] -= 1
    d *= scale
    g["class_weight"] += flat_h.T @ d
    g["class_bias"] += d.sum(0)
    dh = d @ w["class_weight"].T
    for rows, a, b, place in _by_class(np.where(on, t, sizes.heads), cls, sizes):
        hr = flat_h[rows]
        e, logs = _softmax(hr @ w["word_weight"][:, a:b] + w["word_bias"][a:b], place)
        loss -= float(logs.sum())
        e[np.arange(len(rows)), place] -= 1
        e *= scale[rows]
        g["word_weight"][:, a:b] += hr.T @ e
        g["word_bias"][a:b] += e.sum(0)
        dh[rows] += e @ w["word_weight"][:, a:b].T

    dh = dh.reshape(steps, lanes, n)
    back = np.zeros((lanes, n), FLOAT)
    dx = np.empty((steps, lanes, 3 * n), FLOAT)
    for s in range(steps - 1, -1, -1):
        before, un, r, z, new = trace[s]
        dhs = dh[s] + back
        dnew = dhs * (1 - z) * (1 - new * new)
        dz = dhs * (before - new) * z * (1 - z)
        dr = dnew * un * r * (1 - r)
        dx[s, :, :n], dx[s, :, n:2 * n], dx[s, :, 2 * n:] = dr, dz, dnew
        du = np.concatenate([dr, dz, dnew * r], axis=1)
        g["state"] += before.T @ du
        back = (dhs * z + du @ w["state"].T) * keep[s][:, None]
    rows = dx.reshape(-1, 3 * n)
    g["state_bias"] += rows.sum(0)
    order = np.argsort(symbols.ravel(), kind="stable")
    ids = symbols.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g["inputs"][ids[first]] = np.add.reduceat(rows[order], first, axis=0)
    return g, out[-1], loss


class Adagrad:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate = weights, FLOAT(rate)
        self.seen = {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def step(self, gradient: dict[str, np.ndarray], limit: float = 1.0) -> None:
        size = float(np.sqrt(sum(float((v * v).sum()) for v in gradient.values())))
        scale = FLOAT(min(1.0, limit / max(size, 1e-12)))
        for k, v in gradient.items():
            v *= scale
            self.seen[k] += v * v
            self.weights[k] -= self.rate * v / np.sqrt(self.seen[k])
