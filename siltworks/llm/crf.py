"""Linear-chain conditional random fields over hashed token features, in numpy.

Emission scores are sums of hashed feature weights, so a distinct word is scored once and looked up
after that; forward-backward runs over batches of sequences of similar length at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np

from siltworks.llm.prose import Vocabulary


def feature_ids(names: Sequence[str | int], bits: int) -> list[int]:
    """Table rows of features: names are hashed, numbers are hashes already."""
    m = (1 << bits) - 1
    return [(n if isinstance(n, int) else zlib.crc32(n.encode("utf-8", "surrogatepass"))) & m for n in names]


def mix(a, b, salt: int):
    """A hash of two 32-bit hashes, the same for numbers and for unsigned 32-bit arrays."""
    if isinstance(a, np.ndarray):
        x = a * np.uint32(0x9E3779B1)
        x += b * np.uint32(0x85EBCA77)
        x += np.uint32(salt * 0xC2B2AE3D & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        return x
    x = (a * 0x9E3779B1 + b * 0x85EBCA77 + (salt * 0xC2B2AE3D & 0xFFFFFFFF)) & 0xFFFFFFFF
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    return x ^ (x >> 12)


def forward_backward(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of a padded batch ``em[B, T, K]``, scaled forward-backward.

    Returns the marginals ``[B, T, K]``, the summed pairwise marginals ``[K, K]`` and the
    log-partition ``[B]``; steps past a sequence's length hold zeros.
    """
    B, T, K = em.shape
    shift = em.max(axis=2, keepdims=True)
    e = np.exp(em - shift)
    A = np.exp(trans)
    alpha = np.empty((B, T, K))
    scale = np.ones((B, T))
    a = np.exp(start)[None, :] * e[:, 0]
    s = a.sum(1)
    alpha[:, 0] = a / s[:, None]
    scale[:, 0] = s
    for t in range(1, T):
        a = (alpha[:, t - 1] @ A) * e[:, t]
        s = a.sum(1)
        alpha[:, t] = a / s[:, None]
        scale[:, t] = s
    mask = np.arange(T)[None, :] < lengths[:, None]
    beta = np.ones((B, K))
    marg = np.zeros((B, T, K))
    pair = np.zeros((K, K))
    for t in range(T - 1, -1, -1):
        live = mask[:, t]
        marg[:, t] = np.where(live[:, None], alpha[:, t] * beta, 0.0)
        if t:
            v = np.where(live[:, None], e[:, t] * beta / scale[:, t][:, None], 0.0)
            pair += A * (alpha[:, t - 1].T @ v)
            beta = np.where(live[:, None], v @ A.T, 1.0)
    z = np.where(mask, np.log(scale) + shift[:, :, 0], 0.0).sum(1)
    return marg, pair, z


def posterior(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of sequences of descending length, time first: ``em[T, B, K]`` to ``[T, B, K]``.

    The sequences still running at a step are the first rows, so steps past an end cost nothing.
    """
    T, B, K = em.shape
    live = np.searchsorted(-lengths, -np.arange(T), side="left")
    e = np.exp(em - em.max(axis=2, keepdims=True))
    A = np.exp(trans).astype(em.dtype)
    alpha = np.zeros((T, B, K), dtype=em.dtype)
    scale = np.ones((T, B, 1), dtype=em.dtype)
    one = np.ones((K, 1), dtype=em.dtype)
    a = np.exp(start).astype(em.dtype) * e[0]
    scale[0] = a @ one
    alpha[0] = a / scale[0]
    for t in range(1, T):
        n = live[t]
        a = alpha[t - 1, :n] @ A
        a *= e[t, :n]
        s = a @ one
        scale[t, :n] = s
        np.divide(a, s, out=alpha[t, :n])
    e /= scale
    AT = np.ascontiguousarray(A.T)
    beta = np.ones((B, K), dtype=em.dtype)
    for t in range(T - 1, 0, -1):
        n = live[t]
        alpha[t, :n] *= beta[:n]
        beta[:n] = (e[t, :n] * beta[:n]) @ AT
    alpha[0] *= beta
    return alpha


class Crf:
    """Labels, hashed emission weights, transitions and start scores."""

    def __init__(self, labels: Sequence[str], features: Callable[[str], list[str]], bits: int = 15):
        self.labels = list(labels)
        self.features = features
        self.bits = bits
        k = len(self.labels)
        self.w = np.zeros((1 << bits, k), dtype=np.float32)
        self.trans = np.zeros((k, k))
        self.start = np.zeros(k)
        self._forget()

    def _forget(self) -> None:
        self.table = np.zeros((1024, len(self.labels)), dtype=np.float32)
        self.known = np.zeros(1024, dtype=bool)
        self.of: tuple[int, int] | None = None  # the vocabulary whose numbers the table follows

    def emissions(self, ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Scores of numbered words; a word met first is scored and kept."""
        if self.of != (id(vocabulary), vocabulary.generation):
            self._forget()
            self.of = (id(vocabulary), vocabulary.generation)
        n = len(vocabulary.words)
        if n > len(self.known):
            more = max(n, 2 * len(self.known)) - len(self.known)
            self.table = np.concatenate([self.table, np.zeros((more, len(self.labels)), dtype=np.float32)])
            self.known = np.concatenate([self.known, np.zeros(more, dtype=bool)])
        new = np.unique(ids[~self.known[ids]])
        if len(new):
            rows = [feature_ids(self.features(vocabulary.words[j]), self.bits) for j in new]
            size = np.array([len(r) for r in rows])
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            self.table[new] = np.add.reduceat(self.w[[f for r in rows for f in r]], at, axis=0)
            self.known[new] = True
        return self.table[ids]

    def marginals(self, flat: np.ndarray, size: np.ndarray, vocabulary: Vocabulary, cells: int = 150_000) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of all words of sequences of word numbers, given end to end with the
        sequences' sizes (whole sequences, whatever their length), and the words' letters, 0 for numbers."""
        at = np.concatenate([[0], np.cumsum(size)])
        score = self.emissions(flat, vocabulary)
        out = np.zeros((len(flat), len(self.labels)), dtype=np.float32)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        a = 0
        while a < len(order):
            T = int(size[order[a]])
            b = min(len(order), a + max(1, cells // T))
            b = a + int((size[order[a:b]] * 3 >= T).sum())
            group = order[a:b]
            n = size[group]
            t = np.arange(T)[:, None]
            inside = t < n[None, :]
            place = np.where(inside, at[group][None, :] + t, 0)
            m = posterior(score[place], n, self.trans, self.start)
            out[place[inside]] = m[inside]
            a = b
        return out, np.where(vocabulary.flags[flat] & vocabulary.NUMBER, 0, vocabulary.size[flat])

    def fit(self, seqs: Sequence[Sequence[str]], tags: Sequence[Sequence[int]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-6, batch: int = 64, seed: int = 7) -> "Crf":
        """Maximise the conditional likelihood with Adagrad over batches of sequences."""
        k = len(self.labels)
        vocab: dict[str, int] = {}
        feats: list[np.ndarray] = []
        ids = []
        for s in seqs:
            row = []
            for w in s:
                j = vocab.get(w)
                if j is None:
                    j = vocab[w] = len(feats)
                    feats.append(np.array(feature_ids(self.features(w), self.bits)))
                row.append(j)
            ids.append(np.array(row))
        ptr = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
        flat = np.concatenate(feats) if feats else np.zeros(0, int)
        owner = np.repeat(np.arange(len(feats)), np.diff(ptr))
        w = np.zeros((1 << self.bits, k))
        gw = np.full((1 << self.bits, k), 1e-2)
        gt, gs = np.full((k, k), 1e-2), np.full(k, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            order = order[np.argsort([len(ids[i]) // 20 for i in order], kind="stable")]
            starts = rng.permutation(np.arange(0, len(order), batch))
            for a in starts:
                group = [i for i in order[a : a + batch] if len(ids[i])]
                if not group:
                    continue
                lengths = np.array([len(ids[i]) for i in group])
                T = int(lengths.max())
                tok = np.zeros((len(group), T), dtype=int)
                gold = np.zeros((len(group), T), dtype=int)
                for r, i in enumerate(group):
                    tok[r, : lengths[r]] = ids[i]
                    gold[r, : lengths[r]] = tags[i]
                mask = np.arange(T)[None, :] < lengths[:, None]
                used = np.unique(tok[mask])
                sel = np.isin(owner, used) if len(used) < 0.5 * len(feats) else slice(None)
                f, o = flat[sel], owner[sel]
                score = np.zeros((len(feats), k))
                for c in range(k):
                    score[:, c] = np.bincount(o, weights=w[f, c], minlength=len(feats))
                em = score[tok]
                marg, pair, _ = forward_backward(em, lengths, self.trans, self.start)
                target = np.zeros_like(marg)
                np.put_along_axis(target, gold[:, :, None], 1.0, axis=2)
                diff = np.where(mask[:, :, None], target - marg, 0.0)
                n = max(1, int(mask.sum()))
                per_token = np.zeros((len(feats), k))
                for c in range(k):
                    per_token[:, c] = np.bincount(tok.ravel(), weights=diff[:, :, c].ravel(), minlength=len(feats))
                g = np.zeros_like(w)
                for c in range(k):
                    g[:, c] = np.bincount(f, weights=per_token[o, c], minlength=len(w))
                g = g / n * 50 - l2 * w
                gw += g * g
                w += rate * g / np.sqrt(gw)
                obs = np.zeros((k, k))
                both = mask[:, 1:]
                np.add.at(obs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
                d = (obs - pair) / n * 50
                gt += d * d
                self.trans += rate * d / np.sqrt(gt)
                ds = (np.bincount(gold[:, 0], minlength=k) - marg[:, 0].sum(0)) / len(group)
                gs += ds * ds
                self.start += rate * ds / np.sqrt(gs)
        self.w = w.astype(np.float32)
        self._forget()
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "known", "of")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()
