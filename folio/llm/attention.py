"""A causal self-attention model in numpy: one head over a window, one hidden layer, a softmax in three steps; trained by Adam.

Sequences of token ids are laid out one after another, each after STRIDE pads; windows of 2 * STRIDE inputs begin every STRIDE, and
a window scores the second half of its inputs only, so each input is scored once, with STRIDE to 2 * STRIDE - 1 inputs before it.
A token has a code of LEVELS digits; its probability is the product of those of its digits, each one after the digits before it, and
all come from the same attended state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PAD, LEVELS = 0, 3
#: Weights updated together, few enough to stay in a core's cache.
PART = 1 << 14
#: Gradients are taken so many times larger, or their squares would leave the range in which a processor is fast.
TIMES = float(1 << 20)
_LARGE = np.float32(-1e9)


@dataclass
class Attention:
    """Tokens are 1 to n. w: embeddings, attention maps and a bias of each place in a window towards each, hidden maps, each level's outputs (prefixes x (width + bias) x digits)."""

    stride: int
    w: dict[str, np.ndarray]
    prefix: np.ndarray  # level x token: number of the digits before
    digit: np.ndarray  # level x token

    @classmethod
    def new(cls, counts: np.ndarray, width: int, hidden: int, stride: int, seed: int = 5) -> Attention:
        """counts: of each token (place 0, the pad, is not one). Codes go by frequency; biases begin as the counts' logarithms."""
        rng = np.random.default_rng(seed)
        r = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
        n, base = len(counts) - 1, 2
        while base**LEVELS < n:
            base += 1
        order = np.argsort(-counts[1:], kind="stable") + 1
        place = np.zeros(n + 1, np.int64)
        place[order] = np.arange(n)
        at = [place // base ** (LEVELS - 1 - k) for k in range(LEVELS)]
        d, mass = width**-0.5, counts[1:] + 0.3
        w = {
            "emb": r(0.5, n + 1, width), "pos": -0.3 * np.abs(np.arange(stride)[:, None] + stride - np.arange(2 * stride)[None, :]).astype(np.float32), "wq": r(d, width, width), "wk": r(d, width, width), "wv": r(d, width, width), "wo": r(0.5 * d, width, width),
            "w1": r(d, width, hidden), "b1": np.zeros(hidden, np.float32), "w2": r(0.3 * hidden**-0.5, hidden, width),
        }
        for k in range(LEVELS):
            share = np.bincount(at[k][1:], mass, base ** (k + 1)).reshape(-1, base)
            with np.errstate(divide="ignore", invalid="ignore"):
                bias = np.where(share > 0, np.log(share / share.sum(1, keepdims=True)), -30)  # no token has such a code
            w[f"out{k}"] = np.concatenate([r(0.05, base**k, width, base), bias[:, None, :].astype(np.float32)], 1)
        return cls(stride, w, np.stack([a // base for a in at]), np.stack([a % base for a in at]))

    def copy(self) -> Attention:
        return Attention(self.stride, {k: v.copy() for k, v in self.w.items()}, self.prefix, self.digit)

    def mask(self) -> np.ndarray:
        s = self.stride
        return np.where(np.arange(2 * s)[None, :] <= np.arange(s)[:, None] + s, 0, _LARGE).astype(np.float32)


def flat(m: Attention) -> np.ndarray:
    """All weights in one vector."""
    return np.concatenate([v.ravel() for v in m.w.values()])


def filled(m: Attention, weights: np.ndarray) -> Attention:
    """m's copy with the weights of a vector."""
    out, at = m.copy(), 0
    for k, v in out.w.items():
        out.w[k] = weights[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])


def _in_order(x: np.ndarray, most: int) -> np.ndarray:
    return np.argsort(x.astype(np.uint16) if most < 1 << 16 else x, kind="stable")


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x -= x.max(axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis, keepdims=True)
    return x


def views(m: Attention, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of a vector of all weights, in m's shapes."""
    ends = np.cumsum([v.size for v in m.w.values()])
    return {k: weights[e - v.size : e].reshape(v.shape) for (k, v), e in zip(m.w.items(), ends, strict=True)}


def _gradient(m: Attention, win: np.ndarray, want: np.ndarray, g: dict[str, np.ndarray] | None = None, times: float = 1.0) -> tuple[dict[str, np.ndarray], float]:
    """Of times the mean negative log-probability of the targets (want: windows x stride, -1 where none); written to g, which is all zeros, if given.

    What depends on an input alone is worked out once for each distinct token of the batch; targets go in the order of their codes, so those
    that share a prefix are one product with its outputs.
    """
    s, w = m.stride, m.w
    g = {k: np.zeros_like(v) for k, v in w.items()} if g is None else g
    d, scale = w["emb"].shape[1], np.float32(w["emb"].shape[1] ** -0.5)
    two = lambda t: t.reshape(-1, t.shape[-1])
    ids = win.ravel()
    by_token = _in_order(ids, len(w["emb"]))
    token_cuts = _cuts(ids[by_token])
    tokens = ids[by_token[token_cuts[:-1]]]
    place = np.empty(len(ids), np.int64)
    place[by_token] = np.repeat(np.arange(len(tokens)), np.diff(token_cuts))
    place = place.reshape(win.shape)
    mixed = w["wv"] @ w["wo"]  # values are mapped to the output side at once
    maps = np.concatenate([w["wq"] * scale, w["wk"], mixed], 1)
    e = w["emb"][tokens]
    asks, gives = (t.take(p, 0) for t, p in zip(np.split(np.concatenate([e, e @ maps], 1), 2, 1), (place[:, s:], place), strict=True))
    q, k, v = asks[..., d:], gives[..., :d], gives[..., d:]
    a = q @ k.transpose(0, 2, 1)
    a += w["pos"] + m.mask()
    pad = win == PAD
    if len(some := np.flatnonzero(pad.any(1))):
        a[some] = np.where(pad[some][:, None, :], _LARGE, a[some])
    _softmax(a, -1)
    h = a @ v
    h += asks[..., :d]
    h2 = two(h)
    u = h2 @ w["w1"]
    u += w["b1"]
    np.maximum(u, 0, out=u)
    top = u @ w["w2"]
    top += h2

    at = np.flatnonzero(want.ravel() >= 0)
    y = want.ravel()[at]
    base = w["out0"].shape[2]
    by_code = _in_order(m.prefix[-1][y] * base + m.digit[-1][y], base**LEVELS)
    at, y, n = at[by_code], y[by_code], len(y)
    state = np.ones((d + 1, n), np.float32)  # a target a column, here and in p
    state[:d] = top[at].T
    p, groups = np.empty((LEVELS, base, n), np.float32), []
    for level in range(LEVELS):
        prefix = m.prefix[level][y]
        cuts = _cuts(prefix).tolist() if n else [0]
        groups.append(list(zip(cuts[:-1], cuts[1:], prefix[cuts[:-1]].tolist(), strict=True)))
        out, held = w[f"out{level}"].transpose(0, 2, 1), p[level]
        for i, j, c in groups[-1]:
            np.matmul(out[c], state[:, i:j], out=held[:, i:j])
    _softmax(p, 1)
    hit = (np.arange(LEVELS)[:, None] * base + m.digit[:, y]) * n + np.arange(n)
    flat_p = p.reshape(-1)
    loss = -float(np.log(flat_p[hit] + 1e-30).sum())
    flat_p[hit] -= 1
    p *= np.float32(times / max(1, n))
    dstate, part = np.zeros((d, n), np.float32), np.empty((d, n), np.float32)
    for level in range(LEVELS):
        out, held, into = w[f"out{level}"][:, :-1], p[level], g[f"out{level}"]
        for i, j, c in groups[level]:
            own = held[:, i:j]
            np.matmul(state[:, i:j], own.T, out=into[c])
            np.matmul(out[c], own, out=part[:, i:j])
        dstate += part

    dtop = np.zeros_like(top)
    dtop[at] = dstate.T
    np.matmul(u.T, dtop, out=g["w2"])
    du = dtop @ w["w2"].T
    du *= u > 0
    np.matmul(h2.T, du, out=g["w1"])
    np.matmul(np.ones(len(du), np.float32), du, out=g["b1"])
    dtop += du @ w["w1"].T
    dh = dtop.reshape(h.shape)
    da = dh @ v.transpose(0, 2, 1)
    da -= ((da * a) @ np.ones(2 * s, np.float32))[..., None]
    da *= a
    np.sum(da, 0, out=g["pos"])
    dasks, dgives = np.empty_like(asks), np.empty_like(gives)
    dasks[..., :d] = dh
    np.matmul(da, k, out=dasks[..., d:])
    np.matmul(da.transpose(0, 2, 1), q, out=dgives[..., :d])
    np.matmul(a.transpose(0, 2, 1), dh, out=dgives[..., d:])
    by_new = by_token[by_token % (2 * s) >= s]
    new_cuts = _cuts(ids[by_new])
    some = place.ravel()[by_new[new_cuts[:-1]]]
    de, dmaps = np.zeros_like(e), np.zeros((len(e), 3 * d), np.float32)
    asked = np.add.reduceat(two(dasks)[(by_new // (2 * s)) * s + by_new % (2 * s) - s], new_cuts[:-1])
    de[some], dmaps[some, :d] = asked[:, :d], asked[:, d:]
    dmaps[:, d:] = np.add.reduceat(two(dgives)[by_token], token_cuts[:-1])
    de += dmaps @ maps.T
    g["emb"][tokens] = de
    dw = e.T @ dmaps
    g["wq"][:], g["wk"][:] = dw[:, :d] * scale, dw[:, d : 2 * d]
    g["wv"][:], g["wo"][:] = dw[:, 2 * d :] @ w["wo"].T, w["wv"].T @ dw[:, 2 * d :]
    return g, loss / max(1, n)


def train(m: Attention, batches: Iterator[tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 1e-2, warm: int = 50) -> None:
    """batches: (windows, targets), at most steps of them; the rate rises over warm steps and falls towards a twentieth."""
    weights = flat(m)
    m.w = views(m, weights)
    grad, first, second, room = (np.zeros_like(weights) for _ in range(4))
    g = views(m, grad)
    parts = [tuple(x[i : i + PART] for x in (weights, grad, first, second, room)) for i in range(0, len(weights), PART)]
    for step, (win, want) in enumerate(batches, 1):
        if step > steps:
            break
        grad.fill(0)
        _gradient(m, win, want, g, TIMES)
        now = rate * min(1, step / warm) * (1 - 0.95 * step / steps) / (1 - 0.9**step)
        fix = (1 - 0.99**step) ** -0.5
        # first holds ten times the gradient's mean, second a hundred times its square's
        least, now = np.float32(1e-7 * TIMES / fix), np.float32(now / fix)
        for w, x, a, b, t in parts:
            a *= np.float32(0.9)
            a += x
            np.multiply(x, x, out=t)
            b *= np.float32(0.99)
            b += t
            np.sqrt(b, out=t)
            t += least
            np.divide(a, t, out=t)
            t *= now
            w -= t


def fit(m: Attention, win: np.ndarray, want: np.ndarray, picks: Iterator[np.ndarray], steps: int, rate: float) -> None:
    """Trains m on windows by their places. Weights that only tokens of no window have are left as they are: steps go over the others alone."""
    used = np.zeros(len(m.w["emb"]), bool)
    used[PAD] = True
    used[win] = True
    used[want[want >= 0]] = True
    tokens = np.flatnonzero(used)
    number = np.cumsum(used) - 1
    prefixes = [np.unique(m.prefix[k][tokens]) for k in range(LEVELS)]
    w = m.w | {"emb": m.w["emb"][tokens]} | {f"out{k}": m.w[f"out{k}"][x] for k, x in enumerate(prefixes)}
    own = Attention(m.stride, w, np.stack([np.searchsorted(x, m.prefix[k][tokens]) for k, x in enumerate(prefixes)]), m.digit[:, tokens])
    win, want = number[win], np.where(want >= 0, number[want], -1)
    train(own, ((win[p], want[p]) for p in picks), steps, rate)
    for k, v in own.w.items():
        m.w[k][tokens if k == "emb" else prefixes[int(k[-1])] if k.startswith("out") else slice(None)] = v


def layout(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, int]:
    """Where each sequence's first input lies, and the whole length; pads lie before each and after it up to a multiple of stride."""
    room = stride + -(-lengths // stride) * stride
    ends = np.cumsum(room)
    return ends - room + stride, int(ends[-1]) if len(ends) else 0


def windows_of(inputs: np.ndarray, stride: int) -> np.ndarray:
    """inputs: a flat layout of whole strides -> windows x 2 * stride (a view)."""
    n = len(inputs) // stride - 1
    return np.lib.stride_tricks.as_strided(inputs, (max(0, n), 2 * stride), (inputs.strides[0] * stride, inputs.strides[0]))


def lay(seqs: np.ndarray, lengths: np.ndarray, targets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seqs, targets: all sequences' inputs and targets end to end -> flat inputs (PAD), flat targets (-1), and their places."""
    begin, n = layout(lengths, stride)
    at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    x, y = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    x[at], y[at] = seqs, targets
    return x, y, at


def examples(m: Attention, seqs: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that have targets, and these."""
    x, y, _ = lay(seqs, lengths, targets, m.stride)
    win, want = windows_of(x, m.stride), y[m.stride :].reshape(-1, m.stride)
    live = (want >= 0).any(1)
    return win[live], want[live]


class Scorer:
    """Log-probabilities by a model. What depends on an input alone (its query, key, value, the last mapped to the output side) is looked up."""

    def __init__(self, m: Attention, batch: int = 128, block: int = 1 << 15) -> None:
        self.m, self.batch, self.block = m, batch, block
        w = m.w
        self.emb, self.eq, self.ek, self.ev = w["emb"], w["emb"] @ w["wq"] * np.float32(w["wq"].shape[1] ** -0.5), w["emb"] @ w["wk"], w["emb"] @ (w["wv"] @ w["wo"])
        self.bias = w["pos"] + m.mask()
        self.hidden = np.concatenate([w["w1"], w["b1"][None, :]])
        base = w["out0"].shape[2]
        self.code = m.prefix[-1] * base + m.digit[-1]
        self.ones = np.ones(max(base, 2 * m.stride), np.float32)

    def __call__(self, seqs: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target, in the order given."""
        s = self.m.stride
        x, y, at = lay(seqs, lengths, targets, s)
        win, want, out = windows_of(x, s), y[s:].reshape(-1, s), np.zeros(len(x), np.float32)
        live = np.flatnonzero((want >= 0).any(1))
        held = max(1, self.block // s)
        for a in range(0, len(live), held):
            part = live[a : a + held]
            top = np.ones((len(part) * s, self.emb.shape[1] + 1), np.float32)
            for b in range(0, len(part), self.batch):
                self._state(win[part[b : b + self.batch]], top[b * s : (b + self.batch) * s])
            out[(part[:, None] + 1) * s + np.arange(s)] = self._output(top, np.maximum(want[part].ravel(), 1)).reshape(len(part), s)
        return out[at]

    def _state(self, p: np.ndarray, state: np.ndarray) -> None:
        """Fills the attended states (and a 1 for the bias) of windows p."""
        s, d = self.m.stride, self.emb.shape[1]
        new = np.ascontiguousarray(p[:, s:])
        a = self.eq.take(new, 0) @ self.ek.take(p, 0).transpose(0, 2, 1)
        np.clip(a, -60, 60, out=a)
        a += self.bias
        pad = p == PAD
        if len(some := np.flatnonzero(pad.any(1))):
            a[some] += pad[some][:, None, :] * _LARGE
        np.exp(a, out=a)
        h = a @ self.ev.take(p, 0)
        h /= (a @ self.ones[: 2 * s])[:, :, None]
        h += self.emb.take(new, 0)
        state[:, :d] = h.reshape(-1, d)
        u = state @ self.hidden
        np.maximum(u, 0, out=u)
        state[:, :d] += u @ self.m.w["w2"]

    def _output(self, state: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In the order of the targets' codes, those that share a prefix lie together."""
        m, n = self.m, len(y)
        code = self.code[y]
        order = np.argsort(code.astype(np.uint16) if len(self.code) < 1 << 16 else code, kind="stable")
        state, code = state[order], code[order]
        base, total = m.w["out0"].shape[2], np.zeros(n, np.float32)
        logits = np.empty((n, base), np.float32)
        for level in range(LEVELS):
            weights, digits = m.w[f"out{level}"], code // base ** (LEVELS - 1 - level)
            prefix = digits // base
            cuts = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                np.matmul(state[a:b], weights[prefix[a]], out=logits[a:b])
            np.clip(logits, -80, 80, out=logits)
            total += logits.ravel().take(np.arange(n) * base + digits % base)
            np.exp(logits, out=logits)
            total -= np.log(logits @ self.ones[:base])
        out = np.empty(n, np.float32)
        out[order] = total
        return out
