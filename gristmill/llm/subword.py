"""Supervised subword embeddings: hashed n-gram vectors, averaged, with a linear softmax, trained by SGD in numpy.

A text is its whitespace-delimited words, pairs of neighbouring words, and the character n-grams
of each word, its borders being characters too; each is hashed to a bucket with a vector. The average of a
text's vectors goes through a linear layer and a softmax. Training runs on the driver, over a bounded sample.
As averaging and the layer are both linear, the trained model folds to one score
a bucket and class: a text's logits are the mean of its buckets' scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Features:
    """Which n-grams a text is made of, and in how many buckets they go. With ``repeats`` all pairs of equal words are one n-gram, whichever the word."""

    char_sizes: tuple[int, ...] = (3,)
    word_pairs: bool = True
    repeats: bool = False
    buckets: int = 1 << 17

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all features, end of each text's features); null is like the empty text, which has none."""
        joined = f" {' '.join(t or '' for t in texts)} "
        sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)  # of the characters, one after each text's last
        starts = ends - sizes
        if not sizes.any():
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        shift = np.uint64(64 - (self.buckets.bit_length() - 1))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        letters ^= letters >> np.uint64(32)
        letters *= np.uint64(0x94D049BB133111EB)
        parts = []
        space = (points < 33) & _SPACE[np.minimum(points, 32)]
        # words, by differences of a running polynomial
        edge = np.flatnonzero(np.diff(space.astype(np.int8)))
        head, tail = edge[::2] + 1, edge[1::2] + 1
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _powers(_BASE, len(points)))))
        word = (running[tail] - running[head]) * _powers(_INVERSE, len(points))[head]
        word ^= word >> np.uint64(31)
        first, last = np.searchsorted(head, starts), np.searchsorted(head, ends)
        parts.append((word * np.uint64(0xBF58476D1CE4E5B9)) >> shift)
        spans = [(first, last)]
        if self.word_pairs:
            pair = word[:-1] * np.uint64(0x94D049BB133111EB) + word[1:]
            if self.repeats:
                pair[word[:-1] == word[1:]] = 1
            parts.append((pair * np.uint64(0xD6E8FEB86659FD93)) >> shift)
            spans.append((first, np.maximum(last - 1, first)))
        spaces = np.concatenate(([0], np.cumsum(space)))
        for k, size in enumerate(self.char_sizes):
            n = max(len(points) - size + 1, 0)
            # within a word and the white space at its borders
            at = np.flatnonzero(spaces[size - 1 : size - 1 + n] == spaces[1 : 1 + n])
            gram = np.zeros(len(at), np.uint64)
            for i in range(size):
                gram *= np.uint64(0x2545F4914F6CDD1D)
                gram += letters[at + i]
            gram ^= gram >> np.uint64(29)
            parts.append((gram * np.uint64(0x9FB21C651E98DF25 + 2 * k)) >> shift)
            begin = np.searchsorted(at, starts - 1)
            spans.append((begin, np.where(ends > starts, np.maximum(np.searchsorted(at, ends - size + 2), begin), begin)))
        counts = np.array([b - a for a, b in spans])
        ends_of = np.cumsum(counts.sum(axis=0))
        out = np.empty(int(ends_of[-1]), np.int64)
        at = ends_of - counts.sum(axis=0)
        for part, (a, b) in zip(parts, spans, strict=True):
            n = b - a
            total = int(n.sum())
            within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at, n) + within] = part[np.repeat(a, n) + within].astype(np.int64)
            at = at + n
        return out, ends_of


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """A folded classifier: ``scores`` by bucket and class, and the calibration of its logits."""

    features: Features
    classes: list
    scores: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        bucket, ends = self.features.of(texts)
        return self.folded(bucket, ends)

    def folded(self, bucket: np.ndarray, ends: np.ndarray) -> np.ndarray:
        counts = np.diff(ends, prepend=0)
        out = np.zeros((len(ends), len(self.classes)))
        full = np.flatnonzero(counts)
        if len(full):
            begins = (ends - counts)[full]
            for c in range(len(self.classes)):
                out[full, c] = np.add.reduceat(self.scores[c][bucket], begins, dtype=np.float64) / counts[full]
        return out + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated class probabilities of each text; a text without features has those of the bias alone."""
        return _softmax(self.logits(texts) * self.scale + self.shift)


def train(texts: list[str], labels: list, features: Features, width: int = 8, epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 11) -> Model | None:
    """Fit on whole texts; a fifth of them is held back to calibrate the probabilities. None without any text."""
    if not texts:
        return None
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept_back = order[: len(texts) // 5]
    fit = order[len(texts) // 5 :]
    sparse = []
    for i in range(0, len(texts), 256):
        bucket, ends = features.of(texts[i : i + 256])
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            ids, n = np.unique(bucket[a:b], return_counts=True)
            sparse.append((ids.astype(np.int32), (n / max(b - a, 1)).astype(np.float32)))
    table = rng.normal(0, 0.1, (features.buckets, width)).astype(np.float32)
    layer = rng.normal(0, 0.1, (width, len(classes))).astype(np.float32)
    bias = np.zeros(len(classes), np.float32)
    seen_table, seen_layer, seen_bias = np.full(features.buckets, 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for chosen in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            ids = np.concatenate([sparse[i][0] for i in chosen])
            part = np.concatenate([sparse[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(sparse[i][0]) for i in chosen])
            unique, place = np.unique(ids, return_inverse=True)
            own = table[unique]
            weighted = own[place] * part[:, None]
            hidden = np.stack([np.bincount(row, weighted[:, k], len(chosen)) for k in range(width)], axis=1).astype(np.float32)
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error = (error / len(chosen)).astype(np.float32)
            back = (error @ layer.T)[row] * part[:, None]
            for_layer, for_bias = hidden.T @ error, error.sum(axis=0)
            for_table = np.stack([np.bincount(place, back[:, k], len(unique)) for k in range(width)], axis=1).astype(np.float32)
            seen_table[unique] += (for_table**2).mean(axis=1)
            table[unique] = own - step * for_table / np.sqrt(seen_table[unique])[:, None]
            seen_layer += for_layer**2
            seen_bias += for_bias**2
            layer -= step * for_layer / np.sqrt(seen_layer)
            bias -= step * for_bias / np.sqrt(seen_bias)
    model = Model(features, classes, np.ascontiguousarray((table @ layer).T.astype(np.float32)), bias.astype(np.float64), 1.0, np.zeros(len(classes)))
    if len(kept_back) >= 20 and len(classes) > 1:
        _calibrate(model, np.concatenate([model.logits([texts[i]]) for i in kept_back]), y[kept_back])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift the logits to the least log loss on texts that were held back, by gradient descent; a prior keeps the scale near 1."""
    scale, shift = 1.0, np.zeros(logits.shape[1])
    for _ in range(500):
        error = _softmax(logits * scale + shift)
        error[np.arange(len(y)), y] -= 1
        scale -= 0.05 * ((error * logits).sum() + (scale - 1)) / len(y)
        shift -= 0.5 * (error.sum(axis=0) + shift) / len(y)
        scale = max(scale, 0.05)
    model.scale, model.shift = float(scale), shift

