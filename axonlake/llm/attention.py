"""A small causal self-attention model in numpy: training with hand-written gradients, batched masked scoring."""

from __future__ import annotations

import numpy as np

#: Context window and the step between windows when scoring: each window scores what the one before did not.
CONTEXT, STEP = 32, 28
#: Ids of a class; an id's class is id // MEMBERS.
MEMBERS = 32
#: Windows whose attention is worked out at a time when scoring: their tables stay in a core's cache.
AT_ONCE = 64
_LOWER = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax over the last axis; z is overwritten. Maxima are taken off only where exponents could leave the range."""
    if z.max(initial=0) > 60 or z.min(initial=0) < -60:
        z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[-1], z.dtype))[..., None]
    return z


def _added(ids: np.ndarray, rows: np.ndarray, tokens: int) -> np.ndarray:
    """Sums of the rows of each id."""
    order = np.argsort(ids.astype(np.int16 if tokens < 2**15 else np.int32), kind="stable")  # 16 bits are sorted by digits
    of = ids.take(order)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    out = np.zeros((tokens, rows.shape[1]), rows.dtype)
    out[of[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


def _by_class(following: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings the ids of a class together, without padding (-1), and where each class begins and ends."""
    group = (following // MEMBERS).astype(np.int16)
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group.take(order), np.arange(classes + 1))
    return order[edge[0] :], edge - edge[0]


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh by one exponential; x is overwritten."""
    x *= 2
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


class Attention:
    """Log-probabilities of the next id: one masked attention head with a residual path reads up to CONTEXT ids and moves the
    log-odds that counts of pairs of ids give, first those of the next id's class and then those of the id in its class.
    `pairs` has a row of log-probabilities of all ids after each id. Without training the model says what the counts say."""

    def __init__(self, pairs: np.ndarray, width: int = 16, seed: int = 0):
        rng, tokens = np.random.default_rng(seed), len(pairs)
        shape = {"emb": (tokens, width), "pos": (CONTEXT, width), "qkv": (width, 3 * width), "mix": (width, width), "out": (width, tokens // MEMBERS), "within": (tokens, width)}
        scale = {"pos": 0.1, "out": 0.0, "within": 0.0}
        self.w = {k: (rng.normal(0, 1, v) * scale.get(k, width**-0.5)).astype(np.float32) for k, v in shape.items()}
        table = pairs.astype(np.float32).reshape(tokens, -1, MEMBERS)
        top = table.max(axis=2)
        self.classes = top + np.log(np.exp(table - top[:, :, None]).sum(axis=2))
        #: a row for each pair of an id and a class
        self.pairs = table.reshape(-1, MEMBERS)

    def forward(self, ids: np.ndarray):
        """What the head says after each place of the windows (rows of ids), and what the gradients need."""
        w, d = self.w, self.w["emb"].shape[1]
        n, length = ids.shape
        x = w["emb"][ids] + w["pos"][:length]
        q, k, v = (y.reshape(n, length, d) for y in np.split(x.reshape(-1, d) @ w["qkv"], 3, axis=1))
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(d**-0.5)
        lower = _LOWER[:length, :length].astype(a.dtype, copy=False)
        if a.max(initial=0) > 60 or a.min(initial=0) < -60:
            a[:, lower == 0] = -np.inf
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= lower
        a /= (a @ np.ones(length, a.dtype))[..., None]
        c = a @ v
        h = x + _tanh(c.reshape(-1, d) @ w["mix"]).reshape(n, length, d)
        return h, (x, q, k, v, a, c)

    def log_prob_all(self, ids: np.ndarray) -> np.ndarray:
        """Log-probabilities of every id after each place: the plain form of Scorer.log_prob."""
        h, _ = self.forward(ids)
        own = np.log(_softmax(self.classes[ids] + h @ self.w["out"]))
        counts = self.pairs.reshape(len(self.classes), -1, MEMBERS)[ids]
        within = np.log(_softmax(counts + (h @ self.w["within"].T).reshape(counts.shape)))
        return (own[..., None] + within).reshape(*ids.shape, -1)

    def gradients(self, ids: np.ndarray, following: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the places of the windows that have a next id (-1: padding at a window's end) and its gradients."""
        w, d = self.w, self.w["emb"].shape[1]
        h, (x, q, k, v, a, c) = self.forward(ids)
        n, length = ids.shape
        classes = self.classes.shape[1]
        flat, all_ids = following.reshape(-1), ids.reshape(-1)
        at, edge = _by_class(flat, classes)
        y, prev, hf, size = flat.take(at), all_ids.take(at), h.reshape(-1, d).take(at, axis=0), max(len(at), 1)
        group, rows = y // MEMBERS, np.arange(len(at))
        runs = [(slice(lo, hi), slice(g * MEMBERS, (g + 1) * MEMBERS)) for g, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if lo < hi]
        g1, g2 = hf @ w["out"], self.pairs.take(prev * classes + group, axis=0).astype(hf.dtype, copy=False)
        g1 += self.classes.take(prev, axis=0)
        for own, members in runs:
            g2[own] += hf[own] @ w["within"][members].T
        g1, g2 = _softmax(g1), _softmax(g2)
        class_at, member_at = rows * classes + group, rows * MEMBERS + y % MEMBERS
        loss = -float(np.log(g1.reshape(-1).take(class_at) * g2.reshape(-1).take(member_at) + 1e-30).sum()) / size
        g1.reshape(-1)[class_at] -= 1
        g2.reshape(-1)[member_at] -= 1
        out = {"out": hf.T @ g1, "within": np.zeros_like(w["within"])}
        dh, top = np.zeros((n * length, d), h.dtype), g1 @ w["out"].T
        for own, members in runs:
            out["within"][members] = g2[own].T @ hf[own]
            top[own] += g2[own] @ w["within"][members]
        dh[at] = top
        t = (h - x).reshape(-1, d)
        dt = dh * (1 - t * t)
        out["mix"] = c.reshape(-1, d).T @ dt
        dc = (dt @ w["mix"].T).reshape(n, length, d)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= np.einsum("nld,nld->nl", dc, c)[..., None]
        ds *= a
        ds *= np.float32(d**-0.5)
        dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc
        both = np.concatenate([dq, dk, dv], axis=2).reshape(-1, 3 * d)
        out["qkv"] = x.reshape(-1, d).T @ both
        dx = both @ w["qkv"].T
        dx += dh
        out["pos"] = np.zeros_like(w["pos"])
        out["pos"][:length] = dx.reshape(n, length, d).sum(axis=0)
        out["emb"] = _added(all_ids, dx, len(w["emb"]))
        for g in out.values():
            g /= size
        return loss, out

    def train(self, ids: np.ndarray, following: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Attention:
        """Adam over random batches of windows; the rate falls to nothing."""
        rng, adam = np.random.default_rng(seed), Adam(self)
        for t in range(1, steps + 1 if len(ids) else 1):
            pick = rng.integers(0, len(ids), min(batch, len(ids)))
            adam.step(ids[pick], following[pick], rate * (1 - t / steps))
        return self


class Adam:
    """Moves a model's weights along running means of its gradients, batch by batch."""

    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))

    def step(self, ids: np.ndarray, following: np.ndarray, rate: float) -> None:
        self.t += 1
        for k, g in self.model.gradients(ids, following)[1].items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.98 * self.s[k] + 0.02 * g * g
            self.model.w[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.98**self.t)) + 1e-8)).astype(np.float32)


class Scorer:
    """Log-probabilities of given ids by a trained model, as log_prob_all gives them, in few passes over contiguous tables: inputs,
    queries, keys and values of an id and of a place are added up, a column of ones beside the values sums the weights, and only the class of the given id is opened."""

    def __init__(self, model: Attention):
        w, d = model.w, model.w["emb"].shape[1]
        self.mix, self.out, self.within = w["mix"], w["out"], np.ascontiguousarray(w["within"].reshape(-1, MEMBERS, d).transpose(0, 2, 1))
        self.pairs, self.classes, self.one = model.pairs, model.classes, np.ones(MEMBERS, np.float32)
        qkv = w["qkv"].copy()
        qkv[:, :d] *= np.float32(d**-0.5)
        #: for each id and for each place: query, key, value, the one of the sum, input
        self.of_id, self.of_place = (np.concatenate([w[k] @ qkv, np.full((len(w[k]), 1), one, np.float32), w[k]], axis=1) for k, one in (("emb", 1), ("pos", 0)))
        largest = lambda own: sum(float(np.sqrt((x[:, own] ** 2).sum(axis=1).max())) for x in (self.of_id, self.of_place))
        #: whether exponents of attention stay in range whatever the ids
        self.safe = largest(slice(0, d)) * largest(slice(d, 2 * d)) < 60

    def _weights(self, q: np.ndarray, k: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Attention, not yet divided by its sum, of the places lo to hi on those before hi; none on later ones."""
        a, own = q[:, lo:hi] @ k[:, :hi].transpose(0, 2, 1), _LOWER[: hi - lo, : hi - lo]
        if not self.safe:
            a[:, :, lo:][:, own == 0] = -np.inf
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a[:, :, lo:] *= own
        return a

    def _heads(self, ids: np.ndarray, skip: int) -> np.ndarray:
        """What the head says after each place of the windows from the place `skip` on."""
        (n, length), d = ids.shape, len(self.mix)
        h, half = np.empty((n, length - skip, d), np.float32), (skip + length) // 2
        for first in range(0, n, AT_ONCE):
            own = ids[first : first + AT_ONCE]
            x = self.of_id.take(own.reshape(-1), axis=0).reshape(*own.shape, -1)
            x += self.of_place[:length]
            q, k, v = x[:, :, :d], x[:, :, d : 2 * d], x[:, :, 2 * d : 3 * d + 1]
            # in two halves: what comes after the first is not looked at by its places
            c = np.concatenate([self._weights(q, k, lo, hi) @ v[:, :hi] for lo, hi in ((skip, half), (half, length)) if lo < hi], axis=1)
            t = _tanh((c[:, :, :d] / c[:, :, d:]).reshape(-1, d) @ self.mix)
            np.add(t.reshape(len(own), -1, d), x[:, skip:, 3 * d + 1 :], out=h[first : first + AT_ONCE])
        return h

    def log_prob(self, ids: np.ndarray, following: np.ndarray, skip: int = 0) -> np.ndarray:
        """Log-probability of the given id (-1: none; 0 is given) after each place of the windows (rows of ids) from the place `skip` on."""
        h, nxt = self._heads(ids, skip), following[:, skip:].reshape(-1)
        shape, classes = h.shape[:2], self.classes.shape[1]
        order, edge = _by_class(nxt, classes)
        h, prev, nxt = h.reshape(-1, h.shape[2]).take(order, axis=0), ids[:, skip:].reshape(-1).take(order), nxt.take(order)
        group = nxt // MEMBERS
        z = h @ self.out
        z += self.classes.take(prev, axis=0)
        got = _own(z, group, np.ones(classes, np.float32))
        z = self.pairs.take(prev * classes + group, axis=0)
        for g, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if lo < hi:
                z[lo:hi] += h[lo:hi] @ self.within[g]
        got += _own(z, nxt - group * MEMBERS, self.one)
        out = np.zeros(shape[0] * shape[1], np.float32)
        out[order] = got
        return out.reshape(shape)


def _own(z: np.ndarray, which: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one place; z is overwritten. Maxima are taken off only where exponents could leave the range."""
    own = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + which)
    if z.max(initial=0) > 60 or own.min(initial=0) < -60:
        top = z.max(axis=1)
        z -= top[:, None]
        own = own - top
    np.exp(z, out=z)
    return own - np.log(z @ one)
