"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and split into words.  A word's input is a word vector beside the
mean of vectors of its character n-grams, so unseen forms of known stems are told too.  Windows of a fixed
number of words, each overlapping the next by half, run through a gated recurrent unit in both
directions; attention pools the states, and a linear layer gives the window's logit.  A text's
logit is the largest of its windows'.

Labels are of texts, not windows: training takes, again and again, the window that scores
highest in each text, those of clean texts as hard negatives, and windows of repeated clean words.  The first choice goes by log
odds of words and n-grams, with which one input dimension starts.  At the end the logits of texts are calibrated
to probabilities by logistic regression.

The network is fitted on the driver from a bounded sample (``Limits``); its size is fixed,
so is what is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import aside

WINDOW = 32
STRIDE = 16
WORD_BUCKETS = 1 << 15
GRAM_BUCKETS = 1 << 16
GRAMS = (3, 4)
WORD_DIM = 6
GRAM_DIM = 10
HIDDEN = 8
ATTENTION = 8
#: Words whose projections a worker keeps (about 350 bytes each); beyond it the store starts anew.
KNOWN_WORDS = 300_000
#: Log odds are halved for what so many texts hold.
RARE = 5.0
#: Steps of training at least, however few texts there are.
LEAST_STEPS = 400
#: Windows that run through the network at once, and words gathered before they do.
WINDOW_BATCH = 2048
TEXT_BATCH_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    """The bounded sample of labelled texts, by hash of doc_id: at most so many of each label, and so many characters in all
    (the first text is taken whatever its length)."""

    toxic: int = 1500
    clean: int = 5000
    chars: int = 40_000_000
    epochs: int = 8
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all its n-grams, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    text = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(text) - n + 1), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : len(text) - n + 1 + k]
        inside = room[: len(h)] >= n
        found.append(_mix(h[inside], 16))
        owners.append(owner[: len(h)][inside])
    # every word has 3 bytes at least with its borders, so at least one n-gram
    order = np.argsort(np.concatenate(owners), kind="stable")
    grams, own = np.concatenate(found)[order], np.concatenate(owners)[order]
    starts = np.searchsorted(own, np.arange(len(words)))
    # the word as a whole: a polynomial in its bytes
    power = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    terms = (text + np.uint64(1)) * power[room - 1]
    return _mix(np.add.reduceat(terms, ends - sizes), 15), grams, starts


def vocabulary_inputs(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_inputs`` of many words, part by part so that little is held at once; 32-bit numbers."""
    buckets, grams, starts, base = [], [], [], 0
    for at in range(0, len(words), step):
        b, g, s = word_inputs(words[at : at + step])
        buckets.append(b.astype(np.int32))
        grams.append(g.astype(np.int32))
        starts.append((s + base).astype(np.int32))
        base += len(g)
    return np.concatenate(buckets), np.concatenate(grams), np.concatenate(starts)


def split(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; together they cover all, one even where there is no word."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.words = (0.1 * r.standard_normal((WORD_BUCKETS, WORD_DIM))).astype(np.float32)
        self.grams = (0.1 * r.standard_normal((GRAM_BUCKETS, GRAM_DIM))).astype(np.float32)
        self.p = {}
        for side in "fb":
            self.p["W" + side] = scale(d, 3 * h)
            self.p["U" + side] = scale(h, 3 * h)
            self.p["B" + side] = np.zeros(3 * h, np.float32)
        self.p |= {"A": scale(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": scale(ATTENTION), "w": scale(2 * h), "c": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def embed(self, word: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Inputs of words from their buckets."""
        out = np.empty((len(word), WORD_DIM + GRAM_DIM), np.float32)
        out[:, :WORD_DIM] = self.words[word]
        n = np.diff(np.append(starts, len(grams)))
        out[:, WORD_DIM:] = np.add.reduceat(self.grams[grams], starts, axis=0) / n[:, None]
        return out

    def inputs(self, words: list[str]) -> np.ndarray:
        parts = [self.embed(*word_inputs(words[at : at + 20_000])) for at in range(0, len(words), 20_000)]
        return np.concatenate(parts) if parts else np.empty((0, WORD_DIM + GRAM_DIM), np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What words bring to the gates of the two directions."""
        return tuple((x @ self.p["W" + side] + self.p["B" + side]).astype(np.float32) for side in "fb")

    def _run(self, gates: tuple, at: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States (T, n, H) of one direction; ``at``: rows of ``gates`` (n, T)."""
        h, u = HIDDEN, self.p["U" + side]
        own = gates["fb".index(side)]
        n, t_all = at.shape
        state = np.zeros((n, h), np.float32)
        out = np.empty((t_all, n, h), np.float32)
        trace = []
        full = bool(mask.all())
        for t in range(t_all) if side == "f" else range(t_all - 1, -1, -1):
            g = own[at[:, t]]
            # logistic function through tanh
            zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * h] + state @ u[:, : 2 * h])) + 0.5
            z, r = zr[:, :h], zr[:, h:]
            m = np.tanh(g[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = m + z * (state - m)
            if not full:
                new = np.where(mask[:, t : t + 1], new, state)
            if keep:
                trace.append((t, state, z, r, m))
            state = new
            out[t] = state
        return out, trace

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        u = np.tanh(states @ self.p["A"] + self.p["a"])  # (T, n, A)
        e = np.where(mask.T, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0) * mask.any(axis=1)
        context = np.einsum("tn,tnh->nh", weight, states)
        return u, weight, context

    def logits(self, gates: tuple, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float32)
        for s in range(0, len(at), WINDOW_BATCH):
            a, m = at[s : s + WINDOW_BATCH], mask[s : s + WINDOW_BATCH]
            states = np.concatenate([self._run(gates, a, m, side, False)[0] for side in "fb"], axis=2)
            out[s : s + WINDOW_BATCH] = self._pool(states, m)[2] @ self.p["w"] + self.p["c"]
        return out

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Of the weighted logistic loss of windows; x: inputs of the words that ``at`` names."""
        p, h = self.p, HIDDEN
        gates = self.project(x)
        runs = {side: self._run(gates, at, mask, side, True) for side in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        u, alpha, context = self._pool(states, mask)
        logit = context @ p["w"] + p["c"]
        prob = 1 / (1 + np.exp(-logit))
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["c"] = context.T @ d, np.array([d.sum()], np.float32)
        d_context = d[:, None] * p["w"]
        d_states = alpha[:, :, None] * d_context[None]
        d_alpha = np.einsum("tnh,nh->tn", states, d_context)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_e, u)
        d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("tnh,tna->ha", states, d_u)
        g["a"] = d_u.sum(axis=(0, 1))
        d_states = d_states + d_u @ p["A"].T
        d_gates = [np.zeros_like(x) for x in gates]
        for k, side in enumerate("fb"):
            uu = p["U" + side]
            carry = np.zeros((len(at), h), np.float32)
            for t, before, z, r, m in reversed(runs[side][1]):
                dh = carry + d_states[t, :, k * h : (k + 1) * h]
                on = mask[:, t : t + 1]
                live = dh * on
                dm = live * (1 - z) * (1 - m * m)
                dz = live * (before - m) * z * (1 - z)
                d_rs = dm @ uu[:, 2 * h :].T
                dr = d_rs * before * r * (1 - r)
                d_zr = np.hstack([dz, dr])
                g["U" + side][:, : 2 * h] += before.T @ d_zr
                g["U" + side][:, 2 * h :] += (r * before).T @ dm
                carry = dh * ~on + live * z + d_zr @ uu[:, : 2 * h].T + d_rs * r
                np.add.at(d_gates[k], at[:, t], np.hstack([d_zr, dm]))
        for own, side in zip(d_gates, "fb", strict=True):
            g["W" + side], g["B" + side] = x.T @ own, own.sum(axis=0)
        d_x = d_gates[0] @ p["Wf"].T + d_gates[1] @ p["Wb"].T
        return g, d_x, float(np.mean(weight * np.logaddexp(0, np.where(y > 0, -logit, logit))))


class Scorer:
    """Scores texts with a fitted network; keeps the projections of words it has seen."""

    def __init__(self, net: Network, known_words: int = KNOWN_WORDS):
        self.net, self.known_words = net, known_words
        self._reset()

    def _reset(self) -> None:
        # row 0 stands for places beyond a text's end; the mask leaves it out
        self.known: dict[str, int] = {}
        self.rows = 1
        self.gates = tuple(np.zeros((4096, 3 * HIDDEN), np.float32) for _ in "fb")

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if self.rows + len(new) > self.known_words and self.known:
            self._reset()
            new = list(words)
        need = self.rows + len(new)
        if need > len(self.gates[0]):
            grown = tuple(np.zeros((max(need, 2 * len(x)), x.shape[1]), np.float32) for x in self.gates)
            for x, y in zip(grown, self.gates, strict=True):
                x[: self.rows] = y[: self.rows]
            self.gates = grown
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for x, y in zip(self.gates, self.net.project(self.net.inputs(part)), strict=True):
                x[self.rows + at : self.rows + at + len(part)] = y
        self.known.update(zip(new, range(self.rows, need), strict=True))
        self.rows = need

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        words = [split(t) for t in texts]
        self._learn(set().union(*words))
        known = self.known
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        starts, firsts, sizes, base = [], [], [], 0
        for ws in words:
            own = windows(len(ws))
            starts += [base + s for s in own]
            sizes += [min(WINDOW, len(ws))] * len(own)
            firsts.append(len(own))
            base += len(ws)
        at = np.array(starts)[:, None] + np.arange(WINDOW)
        mask = np.arange(WINDOW) < np.array(sizes)[:, None]
        rows = np.where(mask, np.append(flat, np.zeros(WINDOW, np.int64))[np.minimum(at, len(flat) + WINDOW - 1)], 0)
        return np.split(self.net.logits(self.gates, rows, mask), np.cumsum(firsts)[:-1])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return np.array([x.max() for x in self.window_logits(texts)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; 0 for a text without words."""
        found = 1 / (1 + np.exp(-np.clip(self.net.slope * self.logits(texts) + self.net.shift, -30, 30)))
        return np.where([bool(t) and not t.isspace() for t in texts], found, 0.0)


def _log_odds(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 for texts that hold a word, or an n-gram, by bucket; from each text's label and buckets."""
    n, seen = np.zeros(2), (np.zeros((2, WORD_BUCKETS), np.float32), np.zeros((2, GRAM_BUCKETS), np.float32))
    for label, words, grams in found:
        n[label] += 1
        seen[0][label, words] += 1
        seen[1][label, grams] += 1
    out = []
    for s in seen:
        odds = np.log((s[1] + 0.5) / (n[1] + 1)) - np.log((s[0] + 0.5) / (n[0] + 1))
        # what few texts hold tells little
        out.append((odds * s.sum(axis=0) / (s.sum(axis=0) + RARE)).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str | None], labels: list[int], limits: Limits = Limits()) -> Network:
    """Fit a network; with one label only, it scores everything alike at that label's side."""
    net = Network(limits.seed)
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        net.p["w"][:] = 0
        net.shift = 4.0 if labels and labels[0] else -4.0
        net.slope = 0.0
        return net
    random = np.random.default_rng(limits.seed)
    number: dict[str, int] = {}
    # words are numbered as they come, so no text's list of words is kept
    rows = [np.array([number.setdefault(w, len(number)) for w in split(t)], dtype=np.int32) for t in texts]
    vocabulary = list(number)
    del number
    word, grams, starts = vocabulary_inputs(vocabulary or ["?"])
    del vocabulary
    counts = np.diff(np.append(starts, len(grams)))
    def spans_of(own: np.ndarray) -> np.ndarray:
        n = counts[own]
        return np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def pick(own: np.ndarray) -> np.ndarray:
        n = counts[own]
        return net.embed(word[own], grams[spans_of(own)], np.cumsum(n) - n)

    def buckets(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(r)
        if not len(own):
            return own, own
        return np.unique(word[own]), np.unique(grams[spans_of(own)])

    word_odds, gram_odds = _log_odds((int(label), *buckets(r)) for r, label in zip(rows, y, strict=True))
    net.words[:, 0] = 0.25 * np.clip(word_odds, -4, 4)
    net.grams[:, 0] = 0.25 * np.clip(gram_odds, -4, 4)

    places = [(i, s) for i, r in enumerate(rows) for s in windows(len(r))]
    of_text = np.array([i for i, _ in places])
    begin = np.array([s for _, s in places])
    flat = np.append(np.concatenate(rows), np.zeros(WINDOW, np.int32))
    sizes = np.array([len(r) for r in rows])
    base = np.cumsum(sizes) - sizes
    at_all = flat[(base[of_text] + begin).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)]
    mask_all = np.arange(WINDOW) < np.minimum(WINDOW, sizes[of_text])[:, None]

    def block_by_block(of) -> np.ndarray:
        """A number for each window: what ``of`` makes of a block's own words and its places in them."""
        out = np.empty(len(at_all), np.float32)
        for s in range(0, len(at_all), 4 * WINDOW_BATCH):
            part = slice(s, s + 4 * WINDOW_BATCH)
            own, local = np.unique(at_all[part], return_inverse=True)
            out[part] = of(own, local.reshape(-1, WINDOW), mask_all[part])
        return out

    def by_odds(own: np.ndarray, local: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n = counts[own]
        mean = np.add.reduceat(np.clip(gram_odds, -4, 4)[grams[spans_of(own)]], np.cumsum(n) - n) / n
        return np.where(mask, (mean + np.clip(word_odds, -4, 4)[word[own]])[local], -9).max(axis=1)

    def by_network(own: np.ndarray, local: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return net.logits(net.project(pick(own)), local, mask)

    strength = block_by_block(by_odds)

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares = [np.full(len(net.words), 1e-3, np.float32), np.full(len(net.grams), 1e-3, np.float32)]
    step = 0
    first = np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1]))
    clean_words = np.unique(np.concatenate([r for r, label in zip(rows, y, strict=True) if not label]))
    if not len(clean_words):
        clean_words = np.array([0])
    epoch = -1
    while epoch + 1 < limits.epochs or step < LEAST_STEPS:
        epoch += 1
        if epoch:
            strength = block_by_block(by_network)
        order = np.lexsort((-strength, of_text))
        top = order[first]
        second = order[np.minimum(first + 1, np.append(first[1:], len(order)) - 1)]
        clean = y[of_text[second]] == 0
        other = random.permutation(np.flatnonzero(y[of_text] == 0))[: len(first)]
        chosen = np.unique(np.concatenate([top, second[clean], other]))
        # windows of one to three clean words repeated: rare in a sample, and far from all other windows
        made = random.choice(clean_words, (len(chosen) // 4 + 1, 3))
        runs = np.arange(WINDOW) * random.integers(1, 4, (len(made), 1)) // WINDOW
        at_now = np.concatenate([at_all[chosen], np.take_along_axis(made, runs, axis=1)])
        mask_now = np.concatenate([mask_all[chosen], np.ones((len(made), WINDOW), bool)])
        target = np.append(y[of_text[chosen]], np.zeros(len(made))).astype(np.float32)
        mixed = random.permutation(len(target))
        at_now, mask_now, target = at_now[mixed], mask_now[mixed], target[mixed]
        share = target.mean()
        weight = np.where(target > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
        for s in range(0, len(target), 128):
            part = slice(s, s + 128)
            own, local = np.unique(at_now[part], return_inverse=True)
            x = pick(own)
            g, d_x, _ = net.gradients(x, local.reshape(-1, WINDOW), mask_now[part], target[part], weight[part])
            step += 1
            for k, v in net.p.items():
                m, q = moments[k]
                m += 0.1 * (g[k] - m)
                q += 0.01 * (g[k] * g[k] - q)
                v -= 8e-3 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
            # rows of the two tables that the batch met, by adagrad
            spans = spans_of(own)
            back = np.repeat(np.arange(len(own)), counts[own])
            for table, square, rows_, d in (
                (net.words, squares[0], word[own], d_x[:, :WORD_DIM]),
                (net.grams, squares[1], grams[spans], (d_x[:, WORD_DIM:] / counts[own][:, None])[back]),
            ):
                hit, where = np.unique(rows_, return_inverse=True)
                total = np.zeros((len(hit), d.shape[1]), np.float32)
                np.add.at(total, where, d)
                square[hit] += (total * total).sum(axis=1)
                table[hit] -= 0.05 * total / np.sqrt(square[hit])[:, None]
    strength = block_by_block(by_network)
    net.slope, net.shift = calibrate(np.maximum.reduceat(strength, first).astype(np.float64), y)
    return net


def calibrate(logit: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a logistic regression over the sample's texts, by Newton steps."""
    b = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    weight = np.full(len(y), 1 / len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * (b - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(h, g)
        b = b - move
        if np.abs(move).max() < 1e-9:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Network:
    """A network from a bounded sample of labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit("toxicity")), "doc_id"]
    picked = None
    for label, most in ((1, limits.toxic), (0, limits.clean)):
        part = known.filter(F.col("toxic") == label).orderBy(*order).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most limits.toxic + limits.clean rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows, chars = [], 0
    for r in texts.orderBy(*order, "toxic", "text").limit(limits.toxic + limits.clean).toLocalIterator():
        chars += len(r.text or "")
        if rows and chars > limits.chars:
            break
        rows.append(r)
    return train([r.text for r in rows], [r.toxic for r in rows], limits)


_SCORER: list = [None, None]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1): a column is added, all others stay."""
    send = docs.sparkSession.sparkContext.broadcast(net)
    mark = uuid.uuid4().hex
    kept = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker serves many tasks: words seen in one are known in the next
        if _SCORER[0] != mark:
            _SCORER[:] = [mark, Scorer(send.value)]
        scorer = _SCORER[1]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, at = np.empty(len(texts)), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 6 * TEXT_BATCH_WORDS):
                    size += len(texts[to] or "")
                    to += 1
                out[at:to] = scorer.scores(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    plain = docs.select(*kept)
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Takes ``doc_id`` and ``text`` of ``docs``, ``doc_id`` and ``toxic`` of ``labels`` (further columns are
    not looked at).  Labels other than 0 and 1, and rows without an id, teach nothing; of an id
    with two labels both count.  Null text counts as empty; a text without words scores 0; a long one is read whole, in windows.  Repeated rows get the same score.  Without labels of both kinds every score is the
    same, on the side of the one there is (0 without any).  An empty table gives no rows.
    """
    net = fit(docs, labels, limits)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns (one named ``score`` too).

    Null and empty texts score 0 and stay, so do all of equal rows or none; long texts are read whole; an empty table gives no rows.
    """
    net = fit(docs, labels, limits)
    plain, others = aside(docs, ("text",))
    kept = score(plain, net).filter(F.col("score") < 0.5)
    return kept.select(*[others.get(c, F.col("text")).alias(c) for c in docs.columns])
