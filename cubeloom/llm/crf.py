"""Linear-chain conditional random fields over words, in numpy.

A sequence's score is the sum of its words' label potentials and of the transitions between neighbours. Potentials
depend on the word alone (a weight for each of its features and label), so they are worked out once for each distinct word;
context enters by the transitions, which forward-backward carries over the whole text in both directions.

Forward and backward messages of all texts of a batch run side by side. With few labels, the words of the batch are laid out as many
rows of equal length, each row's product of transition matrices is formed in lockstep, a short pass joins the rows, and a second
lockstep pass gives every word's exact message; a text's start resets the chain. With many labels those products cost more than
they save, and each text is a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

LANES, FEW_LABELS = 512, 8


def _messages(potential: np.ndarray, transition: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Normalised forward messages: alpha[t] = (alpha[t-1] @ transition) * potential[t], or potential[t] where a text begins.

    potential (n, s) and transition (s, s) are positive, not logarithms.
    """
    return (_in_lanes if potential.shape[1] <= FEW_LABELS else _by_text)(potential, transition, fresh)


def _by_text(potential: np.ndarray, transition: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, len(potential)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    out, now = np.empty_like(potential), potential[start]
    for t in range(int(length[0]) if len(length) else 0):
        going = int(np.searchsorted(-length, -t))  # texts of more than t words
        at = start[:going] + t
        if t:
            now = (now[:going] @ transition) * potential[at]
        now = now / now.sum(axis=1, keepdims=True)
        out[at] = now
    return out


def _in_lanes(potential: np.ndarray, transition: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    n, s = potential.shape
    lanes = max(1, min(LANES, n // 32))
    length = -(-n // lanes)
    pad = lanes * length - n
    p = np.concatenate((potential, np.ones((pad, s)))).reshape(lanes, length, s).transpose(1, 0, 2).copy()
    f = np.concatenate((fresh, np.ones(pad, bool))).reshape(lanes, length).T.copy()
    # The map of a lane from the message before it to its last one: a matrix, or a constant once a text began inside.
    carry = np.broadcast_to(np.eye(s), (lanes, s, s)).copy()
    for t in range(length):
        carry = carry @ transition
        carry *= p[t][:, None, :]
        if f[t].any():
            carry[f[t]] = p[t][f[t]][:, None, :]
        carry /= carry.sum(axis=(1, 2), keepdims=True)
    start = np.full((lanes, s), 1.0 / s)
    for i in range(1, lanes):
        m = start[i - 1] @ carry[i - 1]
        start[i] = m / m.sum()
    out = np.empty((length, lanes, s))
    now = start
    for t in range(length):
        now = now @ transition
        if f[t].any():
            now[f[t]] = 1.0
        now = now * p[t]
        now /= now.sum(axis=1, keepdims=True)
        out[t] = now
    return out.transpose(1, 0, 2).reshape(-1, s)[:n]


def marginals(potential: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, s): each word's probability of each label. potential and transition are positive; lengths: words of each text."""
    if not len(potential):
        return np.zeros_like(potential)
    lengths = lengths[lengths > 0]
    fresh = np.zeros(len(potential), bool)
    fresh[np.cumsum(lengths) - lengths] = True
    last = np.zeros(len(potential), bool)
    last[np.cumsum(lengths) - 1] = True
    alpha = _messages(potential, transition, fresh)
    # beta[t] * potential[t], from the right: the same recursion over the reversed words
    right = _messages(potential[::-1], transition.T.copy(), last[::-1])[::-1]
    both = alpha * right / potential
    return both / both.sum(axis=1, keepdims=True)


class Chain:
    """Weights for hashed word features by label, and transitions."""

    def __init__(self, n_labels: int, bits: int = 16) -> None:
        self.n_labels, self.bits = n_labels, bits
        self.weight = np.zeros((1 << bits, n_labels))
        self.transition = np.zeros((n_labels, n_labels))

    def potentials(self, features: list[list[int]]) -> np.ndarray:
        """(words, labels): the logarithms, for the feature numbers of each distinct word."""
        if not features:
            return np.zeros((0, self.n_labels))
        n = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter(chain.from_iterable(features), np.int64, int(n.sum()))
        return np.add.reduceat(self.weight[flat], np.cumsum(n) - n, axis=0)

    def fit(self, words: np.ndarray, features: list[list[int]], lengths: np.ndarray, labels: np.ndarray, steps: int, rate: float, decay: float) -> float:
        """Maximises the conditional likelihood of labels by full-batch Adam steps; words: each word's place in features."""
        flat, of = np.fromiter(chain.from_iterable(features), np.int64), np.repeat(np.arange(len(features)), [len(f) for f in features])
        used, flat = np.unique(flat, return_inverse=True)
        w, tr = self.weight[used], self.transition
        n, s = len(words), self.n_labels
        first = np.zeros(n, bool)
        some = lengths[lengths > 0]
        first[np.cumsum(some) - some] = True
        inner = np.flatnonzero(~first)
        onehot = np.zeros((n, s))
        onehot[np.arange(n), labels] = 1.0
        seen = np.zeros((s, s))
        np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
        wanted = np.stack([np.bincount(words, weights=onehot[:, j], minlength=len(features)) for j in range(s)], axis=1)
        loss = 0.0
        for step in range(1, steps + 1):
            logit = np.zeros((len(features), s))
            for j in range(s):
                logit[:, j] = np.bincount(of, weights=w[flat, j], minlength=len(features))
            p = np.exp(logit - logit.max(axis=1, keepdims=True))[words] + 1e-30
            t = np.exp(tr)
            last = np.roll(first, -1)
            alpha = _messages(p, t, first)
            right = _messages(p[::-1], t.T.copy(), last[::-1])[::-1]
            m = alpha * right / p
            m /= m.sum(axis=1, keepdims=True)
            left, here = alpha[inner - 1], right[inner]
            pair = t * ((left / ((left @ t) * here).sum(axis=1, keepdims=True)).T @ here)  # expected transitions
            loss = -float(np.log(m[np.arange(n), labels] + 1e-300).mean())
            expected = np.stack([np.bincount(words, weights=m[:, j], minlength=len(features)) for j in range(s)], axis=1)
            by_word = (wanted - expected)[of]
            gw = np.stack([np.bincount(flat, weights=by_word[:, j], minlength=len(used)) for j in range(s)], axis=1) / n - decay * w
            gt = (seen - pair) / n - decay * tr
            for g, x, a, b in ((gw, w, 0, 1), (gt, tr, 2, 3)):
                moments[a] = 0.9 * moments[a] + 0.1 * g
                moments[b] = 0.999 * moments[b] + 0.001 * g * g
                x += rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.999**step)) + 1e-9)
        self.weight[used] = w
        self.transition = tr
        return loss


class Tagger:
    """A fitted chain applied to texts; the potentials of words are remembered in tables of bounded size.

    bare gives the form of a word that its features depend on, so words that differ in marks or case are worked out once.
    """

    LIMIT = 200_000

    def __init__(self, chain: Chain, features: Callable[[str], list[int]], bare: Callable[[str], str]) -> None:
        self.chain, self.features, self.bare = chain, features, bare
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.form: dict[str, int] = {}
        self.table = np.zeros((0, self.chain.n_labels))

    def _learn(self, words: set[str]) -> None:
        if len(self.number) > self.LIMIT:
            self._forget()
        new = list(words.difference(self.number))
        if not new:
            return
        bare = list(map(self.bare, new))
        forms = list(set(bare).difference(self.form))
        logit = self.chain.potentials([self.features(f) for f in forms])
        logit = np.maximum(logit - logit.max(axis=1, keepdims=True), -60.0)
        self.form.update(zip(forms, range(len(self.form), len(self.form) + len(forms)), strict=True))
        self.table = np.concatenate((self.table, np.exp(logit)))
        self.number.update(zip(new, map(self.form.__getitem__, bare), strict=True))

    def tag(self, texts: list[list[str]]) -> np.ndarray:
        """(all words, labels): marginals of the words of all texts, one text after the other."""
        lengths = np.array([len(t) for t in texts], np.int64)
        self._learn(set().union(*texts))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        return marginals(self.table[flat], np.exp(self.chain.transition), lengths)
