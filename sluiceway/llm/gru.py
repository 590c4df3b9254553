"""A gated recurrent language model in numpy with a class-factored output.

The next word's probability is that of its class times that of the word within its class; both
are softmaxes of the hidden state, so a word costs about two square roots of the vocabulary.
Words outside the vocabulary are one more class. Documents are laid end to end in parallel
streams; a state is carried from window to window and cleared where a document begins.
Gradients go back to the beginning of a window (truncated backpropagation) and are applied by
Adagrad.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

CLASS = 64  # words of a class
HIDDEN = 24
BUCKETS = 256  # inputs that words outside the vocabulary share, by hash
STREAMS = 512
STEPS = 16
RATE = 0.1


class Model:
    """Parameters by name, all views of one vector."""

    def __init__(self, vocabulary: int, hidden: int = HIDDEN, vector: np.ndarray | None = None):
        self.vocabulary, self.hidden = vocabulary, hidden
        self.classes = -(-vocabulary // CLASS)
        shapes = {
            "inputs": (vocabulary + BUCKETS, 3 * hidden),
            "state": (hidden, 3 * hidden),
            "of_class": (hidden, self.classes + 1),
            "class_bias": (self.classes + 1,),
            "of_word": (self.classes, hidden, CLASS),
            "word_bias": (self.classes, CLASS),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.vector = np.zeros(size, np.float32) if vector is None else vector.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.vector[at : at + n].reshape(shape))
            at += n

    @classmethod
    def first(cls, counts: np.ndarray, others: int, hidden: int = HIDDEN) -> Model:
        """A model that knows the words' frequencies only; ``others`` are outside the vocabulary."""
        model = cls(len(counts), hidden)
        random = np.random.default_rng(7)
        for name in ("inputs", "state"):
            held = getattr(model, name)
            held[...] = random.normal(0, 0.3, held.shape)
        padded = np.full(model.classes * CLASS, -1.0)
        padded[: len(counts)] = counts
        padded = padded.reshape(model.classes, CLASS) + 1
        totals = padded.sum(axis=1)
        model.class_bias[...] = np.log(np.append(totals, others + 1) / (totals.sum() + others + 1))
        with np.errstate(divide="ignore"):
            model.word_bias[...] = np.maximum(np.log(padded / totals[:, None]), -1e4)
        return model


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exponentials of the logits fit a float as they are, whatever the state, which is within -1 and 1."""
    reach = np.abs(weights).sum(axis=-2)
    return float((bias + reach).max(initial=0)) < 80 and float((bias - reach).max(axis=-1).min(initial=0)) > -80


def _softmax(x: np.ndarray, at: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each row's probability of its column ``at``; x becomes exponentials, and their sums follow."""
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    own = np.take(x.reshape(-1), np.arange(0, x.size, x.shape[1]) + at)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return own - np.log(total), total


def _gradient(x: np.ndarray, total: np.ndarray, at: np.ndarray, share: np.float32) -> np.ndarray:
    """Of ``share`` of the negative logarithm, by the row before the softmax, from what ``_softmax`` has made; in place."""
    x *= (share / total)[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= share
    return x


def _group_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of groups of rows that begin at ``first``; as reduceat, which is slow on many small groups."""
    out, n = np.take(rows, first, axis=0), np.diff(np.append(first, len(rows)))
    for g in np.flatnonzero(n > 8).tolist():
        np.add.reduce(rows[first[g] : first[g] + n[g]], axis=0, out=out[g])
    some = np.flatnonzero(n <= 8)
    for k in range(1, 8):
        some = some[n[some] > k]
        out[some] += np.take(rows, first[some] + k, axis=0)
    return out


class _Streams:
    """Documents dealt to streams of like length, the longest stream first."""

    def __init__(self, sizes: np.ndarray, streams: int):
        starts = np.cumsum(sizes) - sizes
        heap = [(0, s) for s in range(min(streams, len(sizes)))]
        self.held: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, s = heapq.heappop(heap)
            self.held[s].append(d)
            heapq.heappush(heap, (load + int(sizes[d]), s))
        load = [int(sizes[x].sum()) for x in self.held]
        self.held = [self.held[s] for s in np.argsort(-np.array(load), kind="stable")]
        self.length = np.sort(np.array(load, np.int64))[::-1]
        self.first = np.cumsum(self.length) - self.length
        order = np.array([d for x in self.held for d in x], np.int64)
        n, ends = sizes[order], np.cumsum(sizes[order])
        self.token = np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        self.doc = np.repeat(order, n)
        self.begins = np.zeros(len(self.token), bool)
        self.begins[ends - n] = True


def run(
    model: Model,
    tokens: np.ndarray,
    sizes: np.ndarray,
    *,
    start: int,
    learn: Callable[[dict[str, object]], None] | None = None,
    streams: int = STREAMS,
    steps: int = STEPS,
) -> np.ndarray:
    """Natural log-probability of each document; with ``learn``, gradients are given to it.

    ``tokens`` are the documents' words in order, each of ``sizes`` (at least 1) words: numbers
    below ``vocabulary`` are words, others, up to BUCKETS more, stand for words outside it.
    """
    laid = _Streams(sizes, streams)
    target = tokens[laid.token]
    before = np.empty_like(target)
    before[1:] = target[:-1]
    before[laid.begins] = start
    total = np.zeros(len(sizes))
    state = np.zeros((len(laid.length), model.hidden), np.float32)
    outputs, t, longest = None if learn else _outputs(model), 0, int(laid.length.max(initial=0))
    while t < longest:
        active = int(np.searchsorted(-laid.length, -t))
        # Without gradients it does not matter where windows end, so those of few streams are longer.
        now = steps if learn else min(max(steps, streams * steps // active), longest - t)
        at = laid.first[:active, None] + t + np.arange(now)
        inside = t + np.arange(now) < laid.length[:active, None]
        at = np.where(inside, at, 0)
        logs, state[:active] = _window(model, before[at], target[at], laid.begins[at], inside, state[:active], learn, outputs)
        total += np.bincount(laid.doc[at[inside]], logs, len(sizes))
        t += now
    return total


def _outputs(model: Model) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """The weights of classes and of words, with the bias as those of an input that is 1, and whether they are bounded."""
    of_class = np.concatenate([model.of_class, model.class_bias[None]])
    of_word = np.concatenate([model.of_word, model.word_bias[:, None]], axis=1)
    return of_class, of_word, _bounded(model.of_class, model.class_bias), _bounded(model.of_word, model.word_bias)


def _window(model, before, target, begins, inside, state, learn, outputs=None):
    """One window of all active streams: the words' log-probabilities, and the last state.

    What does not need the step before is done for all steps, and all classes, at once.
    """
    n, steps = before.shape
    h, size = state, model.hidden
    hidden = np.empty((steps, n, size), np.float32)
    # A sigmoid of x is half of 1 + tanh(x / 2).
    half = np.repeat(np.array([0.5, 1], np.float32), (2 * size, size))
    before = np.ascontiguousarray(before.T)
    inputs = np.take(model.inputs, before, axis=0)
    inputs *= half
    by_state = model.state * half
    going = (~begins.T)[:, :, None].astype(np.float32)
    if learn:
        olds, us, news = (np.empty_like(hidden) for _ in range(3))
    for k in range(steps):
        old = h * going[k]
        u = old @ by_state
        gate, wide = inputs[k], 2 * size
        first = gate[:, wide:].copy()
        gate += u
        np.tanh(gate, out=gate)
        gate += np.float32(1)
        gate *= np.float32(0.5)
        new = u[:, wide:] * gate[:, size:wide]
        new += first
        np.tanh(new, out=new)
        if learn:
            olds[k], us[k], news[k] = old, u[:, wide:], new
        old -= new
        old *= gate[:, :size]
        h = np.add(old, new, out=hidden[k])
    h = h.copy()
    flat, whole = inside.T, bool(inside.all())
    seen, words = (hidden.reshape(-1, size), target.T.reshape(-1)) if whole else (hidden[flat], target.T[flat])
    group = np.where(words < model.vocabulary, words // CLASS, model.classes).astype(np.int16)  # sorted by radix
    order = np.argsort(group, kind="stable")
    words, group = words[order], group[order]
    ordered = np.ones((len(words), size + 1), np.float32)
    ordered[:, :size] = np.take(seen, order, axis=0)
    seen = ordered
    edges = [0, *np.cumsum(np.bincount(group, minlength=model.classes)[: model.classes]).tolist()]
    of_class, of_word, class_bounded, word_bounded = outputs or _outputs(model)
    by_class = seen @ of_class
    found, total = _softmax(by_class, group, class_bounded)
    logs = found.astype(float)
    some = [(c, slice(low, high)) for c, (low, high) in enumerate(zip(edges, edges[1:])) if low < high]
    place = words[: edges[-1]] % CLASS
    inner = np.empty((edges[-1], CLASS), np.float32)
    for c, rows in some:
        np.matmul(seen[rows], of_word[c], out=inner[rows])
    found, inner_total = _softmax(inner, place, word_bounded)
    logs[: edges[-1]] += found
    if learn and len(words):
        share = np.float32(1 / len(words))
        d_class = _gradient(by_class, total, group, share)
        d_sorted = d_class @ model.of_class.T
        by_weight = seen.T @ d_class
        grads: dict[str, object] = {"of_class": by_weight[:size], "class_bias": by_weight[size]}
        by_weight, d_inner = np.zeros_like(of_word), np.empty((edges[-1], size), np.float32)
        _gradient(inner, inner_total, place, share)
        for c, rows in some:
            np.matmul(inner[rows], model.of_word[c].T, out=d_inner[rows])
            np.matmul(seen[rows].T, inner[rows], out=by_weight[c])
        grads["of_word"], grads["word_bias"] = by_weight[:, :size], by_weight[:, size]
        d_sorted[: edges[-1]] += d_inner
        d_seen = np.empty_like(d_sorted)
        d_seen[order] = d_sorted
        if whole:
            d_hidden = d_seen.reshape(steps, n, size)
        else:
            d_hidden = np.zeros((steps, n, size), np.float32)
            d_hidden[flat] = d_seen
        z, r = inputs[:, :, :size], inputs[:, :, size : 2 * size]
        d_gates, d_news = np.empty((steps, n, 3 * size), np.float32), np.empty_like(d_hidden)
        later = np.zeros((n, size), np.float32)
        for k in range(steps - 1, -1, -1):
            d, gates = np.add(d_hidden[k], later), d_gates[k]
            by_z = d * z[k]
            d_new = np.multiply(d - by_z, 1 - news[k] * news[k], out=d_news[k])
            by_r = d_new * r[k]
            np.multiply((olds[k] - news[k]) * (1 - z[k]), by_z, out=gates[:, :size])
            np.multiply(us[k] * (1 - r[k]), by_r, out=gates[:, size : 2 * size])
            gates[:, 2 * size :] = by_r
            later = gates @ model.state.T
            later += by_z
            later *= going[k]
        grads["state"] = olds.reshape(-1, size).T @ d_gates.reshape(-1, 3 * size)
        d_gates[:, :, 2 * size :] = d_news
        at = np.flatnonzero(flat)
        used = before.reshape(-1)[at].astype(np.int16 if len(model.inputs) < 1 << 15 else np.int64)
        turn = np.argsort(used, kind="stable")
        used, d_inputs = used[turn], np.take(d_gates.reshape(-1, 3 * size), at[turn], axis=0)
        first = np.flatnonzero(np.diff(used, prepend=-1))
        grads["inputs"] = used[first], _group_sums(d_inputs, first)
        learn(grads)
    by_step = np.empty(len(words))
    by_step[order] = logs
    by_stream = np.zeros((steps, n))
    by_stream[flat] = by_step
    return by_stream.T[inside], h  # a stream that ended within the window is not read again


class Adagrad:
    """Steps scaled by the gradients seen so far."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, rate
        self.seen = Model(model.vocabulary, model.hidden)
        self.seen.vector[...] = 1e-8

    def __call__(self, grads: dict[str, object]) -> None:
        for name, g in grads.items():
            held, seen = getattr(self.model, name), getattr(self.seen, name)
            if isinstance(g, tuple):
                rows, g = g
                now = np.take(seen, rows, axis=0)
                now += g * g
                seen[rows] = now
                held[rows] -= self._step(g, np.sqrt(now, out=now))
            else:
                root = g * g
                seen += root
                held -= self._step(g, np.sqrt(seen, out=root))

    def _step(self, g: np.ndarray, root: np.ndarray) -> np.ndarray:
        """In place of the root."""
        np.divide(g, root, out=root)
        root *= root.dtype.type(self.rate)
        return root
