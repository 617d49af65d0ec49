"""Quality rules: counts over the whole text and a calibrated n-gram logistic regression.

The regression has one weight for each hashed word, word pair and character 4-gram; a
document's logit is the mean weight of each kind, summed.  It is fitted by AdaGrad on a
bounded sample of labelled rows, and its probability is calibrated (Platt) on a part of the
sample that took no part in the fit.  Scoring runs in Arrow batches and keeps a document
when its probability reaches a fixed threshold.

Defined cases: a null, empty or blank text has zero counts, fails the base rules and gets
the probability of the intercept alone; without labelled rows of both classes every
probability is 1 and the base rules alone decide; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm import labelled
from rentlake.llm.textbatch import byte_prefix, flat, gram_hash, keep_rows, runs, slices, span_hash, sums_by_row, words

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
KEEP_FROM = 0.5

KINDS = ("word", "pair", "chars")
BITS = 17
CHARS = 4
EPOCHS = 12

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    bias: float
    slope: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind: feature numbers, and from where to where each row has them."""
    top = np.uint64(64 - BITS)
    out = {"word": ((hashes >> top).astype(np.int32), bounds[:-1], bounds[1:])}
    pairs = (gram_hash(hashes, 2) >> top).astype(np.int32)
    out["pair"] = (pairs, np.minimum(bounds[:-1], len(pairs)), np.minimum(np.maximum(bounds[:-1], bounds[1:] - 1), len(pairs)))
    wide = data.astype(np.uint32)
    code = np.zeros(max(0, len(data) - CHARS + 1), np.uint32)
    for i in range(CHARS):
        code = (code << np.uint32(8)) | wide[i : i + len(code)]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    out["chars"] = (code, np.minimum(offsets[:-1], len(code)), np.minimum(np.maximum(offsets[:-1], offsets[1:] - CHARS + 1), len(code)))
    return out


def logits(model: Model, kinds: dict) -> np.ndarray:
    total = np.full(len(kinds["word"][1]), model.bias)
    for kind, (features, start, end) in kinds.items():
        sums = np.zeros(len(features) + 1)
        np.cumsum(model.weights[kind][features], out=sums[1:])
        total += (sums[end] - sums[start]) / np.maximum(1, end - start)
    return total


def _rows_of_sample(texts: list[str]) -> list[dict[str, tuple[np.ndarray, np.ndarray]]]:
    rows = []
    for text in texts:
        data, offsets = flat(pa.array([text], pa.string()))
        starts, ends, bounds = words(data, offsets)
        kinds = grams(data, offsets, span_hash(byte_prefix(data), starts, ends), bounds)
        row = {}
        for kind, (features, start, end) in kinds.items():
            found, n = np.unique(features[start[0] : end[0]], return_counts=True)
            row[kind] = found, (n / max(1, n.sum())).astype(np.float32)
        rows.append(row)
    return rows


def fit(rows: list[tuple[int, str, int]], shares: dict[int, float] | None = None, epochs: int = EPOCHS) -> Model | None:
    """Model from (id, text, label) rows; None without both classes.

    ``shares`` has the share of each class among all labels, for which the probability is
    calibrated; without it the rows' own shares count.
    """
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y)) < 2:
        return None
    features = _rows_of_sample([r[1] for r in rows])
    order = np.random.default_rng(5).permutation(len(rows))
    aside, own = (order[: len(rows) // 4], order[len(rows) // 4 :]) if len(rows) >= 40 else (order, order)
    weights = {k: np.zeros(1 << BITS) for k in KINDS}
    seen = {k: np.full(1 << BITS, 1e-8) for k in KINDS}
    bias, rng = 0.0, np.random.default_rng(6)

    def logit(i: int) -> float:
        return bias + sum(float(weights[k][f] @ v) for k, (f, v) in features[i].items())

    weight = {0.0: 0.5 / max(1e-9, 1 - y[own].mean()), 1.0: 0.5 / max(1e-9, y[own].mean())}
    for epoch in range(epochs):
        for i in rng.permutation(own):
            error = (1 / (1 + np.exp(-np.clip(logit(i), -30, 30))) - y[i]) * weight[y[i]]
            bias -= 0.02 * error
            for k, (f, v) in features[i].items():
                step = error * v
                seen[k][f] += step * step
                weights[k][f] -= 0.5 * step / np.sqrt(seen[k][f])
    # Platt: targets are drawn in a little, as few rows are held aside
    z, t = np.array([logit(i) for i in aside]), y[aside]
    n1, n0 = t.sum(), len(t) - t.sum()
    held = t == 1
    counted = np.where(held, shares[1] / max(1, n1), shares[0] / max(1, n0)) * len(t) if shares else np.ones(len(t))
    t = np.where(held, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = counted * (p - t), counted * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [g @ z + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
    return Model({k: w.astype(np.float32) for k, w in weights.items()}, bias, float(a), float(b))


def counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    inside = (data & 0xC0) != 0x80  # first byte of a code point
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=points[1:])
    n_repeat = np.zeros(len(offsets) - 1, np.int64)
    grams3 = gram_hash(hashes, 3)
    n_dup = np.zeros(len(offsets) - 1, np.int64)
    line_starts, line_ends = runs(data != 10, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    lines = span_hash(byte_prefix(data), line_starts, line_ends)
    line_bounds = np.searchsorted(line_starts, offsets)
    for i in range(len(offsets) - 1):
        first, n = bounds[i], bounds[i + 1] - bounds[i]
        if n >= 4:
            own = grams3[first : first + n - 2]
            order = np.argsort(own, kind="stable")
            ordered = own[order]
            same = ordered[1:] == ordered[:-1]
            if same.any():
                repeated = np.zeros(n - 2, bool)
                repeated[order[1:][same]] = True
                repeated[order[:-1][same]] = True
                covered = np.zeros(n, bool)
                for k in range(3):
                    covered[k : k + n - 2] |= repeated
                n_repeat[i] = covered.sum()
        own = lines[line_bounds[i] : line_bounds[i + 1]]
        if len(own) > 1:
            n_dup[i] = len(own) - len(np.unique(own))
    return {
        "n_words": np.diff(bounds),
        "word_chars": sums_by_row(points[ends] - points[starts], bounds),
        "n_symbols": sums_by_row(_IS_SYMBOL[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
    }


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def verdicts(model: Model | None, threshold: float, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``SCHEMA``."""
    starts, ends, bounds = words(data, offsets)
    hashes = span_hash(byte_prefix(data), starts, ends)
    out = counts(data, offsets, starts, ends, bounds, hashes)
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
    p = model.probability(logits(model, grams(data, offsets, hashes, bounds))) if model else np.ones(len(failed))
    return out | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}


def _score(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            out = verdicts(model, threshold, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, out.values())], ["key", *out])

    return run


def judge(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = KEEP_FROM, rows: int = labelled.ROWS_PER_CLASS) -> DataFrame:
    """One row per document: key, the base counts, ``base_failed``, ``probability`` and ``kept``."""
    model = fit(labelled.sample(training, labels, label, rows=rows, key=key, text=text), labelled.shares(labels, label))
    rows_in = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows_in.schema["key"].dataType.simpleString()
    return rows_in.mapInArrow(_score(model, threshold), f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def keep(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = KEEP_FROM, rows: int = labelled.ROWS_PER_CLASS) -> DataFrame:
    """The documents that ``judge`` would keep, with all their columns."""
    model = fit(labelled.sample(training, labels, label, rows=rows, key=key, text=text), labelled.shares(labels, label))
    return keep_rows(docs, text, lambda data, offsets: verdicts(model, threshold, data, offsets)["kept"])
