"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of many windows at once."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Tags each character of windows of class numbers x[batch, time]. Both directions run in one loop, as a batch of two."""

    def __init__(self, n_classes: int, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.h, self.k = hidden, n_tags
        self.p = {
            "e": g(n_classes, embed) * 2, "wx": g(2, embed, 4 * hidden), "wh": g(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "wo": g(2 * hidden, n_tags), "bo": np.zeros(n_tags, np.float32), "tr": np.zeros((n_tags, n_tags), np.float32), "st": np.zeros(n_tags, np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0  # forget gates start open

    def _forward(self, x: np.ndarray):
        p, h = self.p, self.h
        n, t = x.shape
        e = p["e"][x.T]  # time, batch, embed
        both = np.stack([e, e[::-1]])
        pre = both.reshape(2, t * n, -1) @ p["wx"] + p["b"]
        pre = pre.reshape(2, t, n, 4 * h)
        hs = np.zeros((2, t + 1, n, h), np.float32)
        c = np.zeros((2, n, h), np.float32)
        kept = []
        for k in range(t):
            g = pre[:, k] + hs[:, k] @ p["wh"]
            s = _sigmoid(g[..., : 3 * h])
            i, f, o = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
            z = np.tanh(g[..., 3 * h :])
            was = c
            c = f * was + i * z
            tc = np.tanh(c)
            hs[:, k + 1] = o * tc
            kept.append((i, f, o, z, was, tc))
        top = np.concatenate([hs[0, 1:], hs[1, :0:-1]], axis=-1)  # time, batch, 2h
        return top @ p["wo"] + p["bo"], top, hs, both, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """[time, batch, tag]. What the classes put into the gates is computed once and looked up a step at a time, so that nothing but the result grows with time."""
        p, h = self.p, self.h
        n, t = x.shape
        inputs = p["e"] @ p["wx"] + p["b"]  # direction, class, gate
        out = np.empty((t, n, self.k), np.float32)
        out[:] = p["bo"]
        hs, c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for k in range(t):
            g = hs @ p["wh"]
            g[0] += inputs[0][x[:, k]]
            g[1] += inputs[1][x[:, t - 1 - k]]
            s = _sigmoid(g[..., : 3 * h])
            c = s[..., h : 2 * h] * c + s[..., :h] * np.tanh(g[..., 3 * h :])
            hs = s[..., 2 * h :] * np.tanh(c)
            out[k] += hs[0] @ p["wo"][:h]
            out[t - 1 - k] += hs[1] @ p["wo"][h:]
        return out

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags[batch, time] for emissions[time, batch, tag]."""
        t, n, k = em.shape
        score = em[0] + self.p["st"]
        back = np.zeros((t, n, k), np.int8)
        tr = self.p["tr"].T[None]  # to, from
        for j in range(1, t):
            s = score[:, None, :] + tr
            back[j] = s.argmax(axis=2)
            score = s.max(axis=2) + em[j]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        every = np.arange(n)
        for j in range(t - 1, 0, -1):
            tags[:, j - 1] = back[j, every, tags[:, j]]
        return tags

    def _crf(self, em: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood and gradients for the emissions, transitions and starts."""
        t, n, k = em.shape
        em = em.astype(np.float64)
        tr, st = self.p["tr"].astype(np.float64), self.p["st"].astype(np.float64)
        # forward and backward sums as probabilities, scaled at each step
        top = em.max(axis=2, keepdims=True)
        ex, move = np.exp(em - top), np.exp(tr)
        a, b, c = np.zeros((t, n, k)), np.ones((t, n, k)), np.zeros((t, n, 1))
        for j in range(t):
            x = ex[j] * (np.exp(st) if j == 0 else a[j - 1] @ move)
            c[j] = x.sum(axis=1, keepdims=True)
            a[j] = x / c[j]
        for j in range(t - 2, -1, -1):
            b[j] = (ex[j + 1] * b[j + 1] / c[j + 1]) @ move.T
        z = np.log(c).sum(axis=(0, 2)) + top.sum(axis=(0, 2))
        d = a * b
        d_tr = move * (a[:-1].reshape(-1, k).T @ (ex[1:] * b[1:] / c[1:]).reshape(-1, k))
        steps, every = np.arange(t)[:, None], np.arange(n)[None]
        gold = em[steps, every, y.T].sum(axis=0) + st[y[:, 0]] + tr[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_st = d[0].sum(axis=0)
        d[steps, every, y.T] -= 1
        np.add.at(d_tr, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.add.at(d_st, y[:, 0], -1)
        return float((z - gold).mean()), (d / n).astype(np.float32), (d_tr / n).astype(np.float32), (d_st / n).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray):
        p, h = self.p, self.h
        em, top, hs, both, kept = self._forward(x)
        loss, d_em, d_tr, d_st = self._crf(em, y)
        t, n, _ = em.shape
        g = {"tr": d_tr, "st": d_st, "wo": top.reshape(t * n, -1).T @ d_em.reshape(t * n, -1), "bo": d_em.sum(axis=(0, 1))}
        d_top = d_em @ p["wo"].T
        d_hs = np.stack([d_top[..., :h], d_top[::-1, :, h:]])
        d_pre = np.zeros((2, t, n, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        wh_t = p["wh"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            i, f, o, z, was, tc = kept[k]
            dh = dh + d_hs[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            d = d_pre[:, k]
            d[..., :h] = dc * z * i * (1 - i)
            d[..., h : 2 * h] = dc * was * f * (1 - f)
            d[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
            d[..., 3 * h :] = dc * i * (1 - z * z)
            dh = d @ wh_t
            dc = dc * f
        flat = d_pre.reshape(2, t * n, 4 * h)
        g["wh"] = hs[:, :-1].reshape(2, t * n, h).transpose(0, 2, 1) @ flat
        g["wx"] = both.reshape(2, t * n, -1).transpose(0, 2, 1) @ flat
        g["b"] = flat.sum(axis=1, keepdims=True)
        d_both = (flat @ p["wx"].transpose(0, 2, 1)).reshape(2, t, n, -1)
        d_e = d_both[0] + d_both[1][::-1]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x.T.ravel(), d_e.reshape(t * n, -1))
        return loss, g

    def train(self, batches, rate: float = 0.02) -> float:
        """Adam over batches of (x, y), the rate falling to a tenth; the last loss."""
        batches = list(batches)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        loss = 0.0
        for step, (x, y) in enumerate(batches, 1):
            loss, g = self.gradients(x, y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * (1 - 0.9 * step / len(batches)) * min(1.0, 50.0 / (norm + 1e-9))
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return loss
