"""Toxicity by subword-bag embeddings and a linear softmax.

A word is a bag of hashed parts: itself and the character n-grams of "<word>" in lower
case.  A window of consecutive words, one from every word on, is the mean of the vectors of all its parts, and a
softmax over it gives the window's probability; a document takes its most toxic window, so words put before or
after a text never lower its score.  A text of fewer words is one window.
Vectors and softmax are trained jointly by AdaGrad in numpy on a bounded labelled sample:
the windows that stand for a document are its likeliest ones under the model so far, so
that a few bad words in a long text are enough.  Unseen misspellings share n-grams with
known words.

As the softmax is linear in the mean, scoring needs one number for each part: its vector
times the difference of the two class rows.

Defined cases: a text without words scores as the bias alone; without labelled rows of both
classes the score is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm import labelled
from rentlake.llm.textbatch import LOWER, byte_prefix, flat, slices, span_hash, words

BITS = 17
DIMENSIONS = 12
#: Lengths in bytes of the character n-grams.
GRAMS = (3, 4, 5, 6)
#: Longest part of a word that gives n-grams; a longer word gives those of all its parts.
WORD_BYTES = 24
WINDOW = 3
EPOCHS = 6
TOXIC_FROM = 0.5
ROWS_PER_CLASS = 2000

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    parts: np.ndarray  # one number for each part
    bias: float


def word_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part numbers of each word, word by word, and the n + 1 bounds between words."""
    shift = np.uint64(64 - BITS)
    # "<" and ">" around each word
    length = ends - starts + 2
    bounds = np.concatenate([[0], np.cumsum(length)])
    buffer = np.empty(bounds[-1], np.uint8)
    buffer[bounds[:-1]], buffer[bounds[1:] - 1] = 60, 62
    inner = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    inside = (inner > 0) & (inner < np.repeat(length, length) - 1)
    buffer[inside] = data[(inner + np.repeat(starts - 1, length))[inside]]
    sums = byte_prefix(buffer)
    per_word = np.ones(len(starts), np.int64)
    for n in GRAMS:
        per_word += np.maximum(0, length - n + 1)
    out_bounds = np.concatenate([[0], np.cumsum(per_word)])
    out = np.empty(out_bounds[-1], np.int32)
    out[out_bounds[:-1]] = span_hash(sums, bounds[:-1], bounds[1:]) >> shift
    at = out_bounds[:-1] + 1
    for n in GRAMS:
        count = np.maximum(0, length - n + 1)
        within = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        first = np.repeat(bounds[:-1], count) + within
        out[np.repeat(at, count) + within] = span_hash(sums, first, first + n) >> shift
        at = at + count
    return out, out_bounds


def _words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    starts, ends, bounds = words(np.where(_LETTER[low], low, np.uint8(32)), offsets)
    return low, starts, ends, bounds


def fit(rows: list[tuple[int, str, int]], epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> Model | None:
    """Model from (id, text, label) rows; None without both classes."""
    y = np.array([r[2] for r in rows])
    if len(set(y)) < 2:
        return None
    documents = []
    for _, text, _ in rows:
        low, starts, ends, _ = _words(*flat(pa.array([text], pa.string())))
        parts, bounds = word_parts(low, starts, ends)
        first, last = windows(np.array([len(starts)]))
        documents.append((parts, bounds[first], bounds[last]))
    rng = np.random.default_rng(10)
    order = rng.permutation(len(rows))
    aside, own_rows = (order[: len(rows) // 4], order[len(rows) // 4 :]) if len(rows) >= 40 else (order, order)
    vectors = ((rng.random((1 << BITS, dimensions)) - 0.5) / dimensions).astype(np.float32)
    classes = ((rng.random((2, dimensions)) - 0.5) * 2).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_classes = np.full(1 << BITS, 1e-6, np.float32), np.full((2, dimensions), 1e-6, np.float32)

    def learn(parts: np.ndarray, label: int, rate: float) -> None:
        mean = vectors[parts].mean(0)
        z = classes @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        step = p @ classes / len(parts)
        own = np.outer(p, mean)
        seen_classes[:] += own * own
        classes[:] -= rate * own / np.sqrt(seen_classes)
        bias[:] -= 0.02 * p
        np.add.at(seen, parts, float(step @ step))
        np.subtract.at(vectors, parts, (rate / np.sqrt(seen[parts]))[:, None] * step)

    for epoch in range(epochs):
        scores = vectors @ (classes[1] - classes[0])
        done: set[bytes] = set()  # windows that copies of a document repeat
        for i in rng.permutation(own_rows):
            parts, first, last = documents[i]
            n = len(first)
            if not len(parts):
                continue
            if epoch == 0:  # nothing is known yet: some windows, all under the document's label
                chosen = rng.integers(0, n, min(n, 24))
            else:
                means = window_means(scores, parts, first, last)
                likely = int(np.argmax(means))
                apart = np.where(np.abs(np.arange(n) - likely) < WINDOW, -np.inf, means)  # windows that share no word with it
                chosen = [likely] if y[i] else [likely, int(np.argmax(apart)), int(rng.integers(0, n))]
            for w in chosen:
                window = parts[first[w] : last[w]]
                if len(window) and window.tobytes() not in done:
                    done.add(window.tobytes())
                    learn(window, int(y[i]), 0.3)
    scores = (vectors @ (classes[1] - classes[0])).astype(np.float32)
    return Model(scores, _bias(np.array([window_means(scores, *documents[i]).max() for i in aside if len(documents[i][0])]), np.array([y[i] for i in aside if len(documents[i][0])])))


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the windows of each row, counting words over all rows."""
    before = np.concatenate([[0], np.cumsum(n_words)])
    count = np.where(n_words > 0, np.maximum(1, n_words - WINDOW + 1), 0)
    row = np.repeat(np.arange(len(n_words)), count)
    first = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first, np.minimum(first + WINDOW, before[row + 1])


def window_means(scores: np.ndarray, parts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mean score of the parts from ``first`` to before ``last``."""
    sums = np.concatenate([[0], np.cumsum(scores[parts], dtype=np.float64)])
    return (sums[last] - sums[first]) / np.maximum(1, last - first)


def _bias(logits: np.ndarray, y: np.ndarray) -> float:
    """Bias that fits the likeliest windows of rows the training has not seen, both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(logits + middle, -30, 30)))
        low, high = (low, middle) if weight @ (p - y) > 0 else (middle, high)
    return (low + high) / 2


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each row, and the first word of its most toxic window (-1 without words)."""
    low, starts, ends, bounds = _words(data, offsets)
    parts, part_bounds = word_parts(low, starts, ends)
    out, where = np.full(len(offsets) - 1, model.bias), np.full(len(offsets) - 1, -1, np.int64)
    n_words = np.diff(bounds)
    begin, end = windows(n_words)
    n_windows = np.where(n_words > 0, np.maximum(1, n_words - WINDOW + 1), 0)
    first = np.concatenate([[0], np.cumsum(n_windows)])
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    logit = window_means(model.parts, parts, part_bounds[begin], part_bounds[end]) + model.bias
    full = np.flatnonzero(n_windows)
    if len(full):
        out[full] = np.maximum.reduceat(logit, first[:-1][full])
        best = np.flatnonzero(logit == out[row])
        where[row[best[::-1]]] = (begin - bounds[:-1][row])[best[::-1]]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30))), where


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, size=1 << 18):
            score, where = scores(model, data, offsets) if model else (np.zeros(rows.num_rows), np.full(rows.num_rows, -1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(where, mask=where < 0)], ["key", "score", "worst_word"])

    return run


def classify(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_where=None, rows: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per document: key, ``score`` (0 to 1) and ``worst_word``, where its most toxic window begins."""
    model = fit(labelled.sample(training, labels, label, where=learn_where, rows=rows, key=key, text=text))
    rows_in = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows_in.schema["key"].dataType.simpleString()
    return rows_in.mapInArrow(_score(model), f"key {kind}, score double, worst_word bigint").withColumnRenamed("key", key)
