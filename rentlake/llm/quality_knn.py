"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of hashed terms: words, word shapes and their pairs, character 4-grams,
and marks for words that repeat.  Terms are weighted by 1 + log(count) and by their
rarity in the labelled sample, and a truncated SVD of the sample gives the latent space.
The sample's vectors and the projection are sent to the tasks (their size is fixed by the
parameters); every document is compared with every sample vector in blocks of a matrix
product, and its nearest neighbours vote with their similarity and the weight of their
class, as the sample holds both classes alike.

Defined cases: a text without any term (null, empty) gets the share of label 1 in the
sample; so does a document to which no neighbour is similar.  Without labelled rows the
score is 0.5.  Equal similarities are ordered by the sample's order of ids.  Repeated rows
are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm import labelled
from rentlake.llm.textbatch import LOWER, byte_prefix, flat, gram_hash, keep_rows, owners, slices, span_hash, words

TERMS = 1 << 12
DIMENSIONS = 48
NEIGHBOURS = 15
GOOD_FROM = 0.7
ROWS_PER_CLASS = 1500
#: Marks: the word stands 1, 2 or 3 words before, too; they count this much more than other terms.
REPEATS, REPEAT_WEIGHT = 3, 4.0
#: Rows of a block of the product.
BLOCK = 512

# Shape of a byte: letters of either case, digits, bytes of non-ASCII characters; others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 128


@dataclass
class Space:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # of the sample, unit length
    labels: np.ndarray
    votes: np.ndarray  # what a neighbour counts, besides its similarity
    share: float


def _number(hashes: np.ndarray, salt: int) -> np.ndarray:
    return ((hashes ^ np.uint64(salt * 0x1F123BB5)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)).astype(np.int64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x terms."""
    n = len(offsets) - 1
    starts, ends, bounds = words(data, offsets)
    row = owners(bounds)
    cells = [row * TERMS + _number(span_hash(byte_prefix(LOWER[data]), starts, ends), 1)]
    exact = span_hash(byte_prefix(data), starts, ends)
    # shape: first, last and middle class and a coarse length
    if len(starts):
        kinds = _SHAPE[data]
        shape = kinds[starts].astype(np.uint64) << np.uint64(24) | kinds[ends - 1].astype(np.uint64) << np.uint64(16) | kinds[(starts + ends) // 2].astype(np.uint64) << np.uint64(8) | np.minimum(ends - starts, 12).astype(np.uint64) // np.uint64(4)
        cells.append(row * TERMS + _number(shape, 2))
        pair = gram_hash(shape, 2)
        same = row[1:] == row[:-1]
        cells.append((row[1:] * TERMS + _number(pair, 3))[same])
        for back in range(1, REPEATS + 1):
            repeats = np.flatnonzero((exact[back:] == exact[:-back]) & (row[back:] == row[:-back]))
            cells.append(row[repeats] * TERMS + back)
    if len(data) > 3:
        wide = data.astype(np.uint32)
        code = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        of = np.repeat(np.arange(n), np.diff(offsets))
        whole = of[:-3] == of[3:]
        cells.append((of[:-3] * TERMS + ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64))[whole])
    return np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.log1p(counts, out=counts)
    out *= weight
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def fit(rows: list[tuple[int, str, int]], shares: dict[int, float] | None = None, dimensions: int = DIMENSIONS) -> Space | None:
    """Space and labelled vectors from (id, text, label) rows; None without rows.

    ``shares`` has the share of each class among all labels: neighbours of a class that the
    sample holds too often count for less.
    """
    if not rows:
        return None
    parts = []
    for at in range(0, len(rows), BLOCK):
        data, offsets = flat(pa.array([r[1] for r in rows[at : at + BLOCK]], pa.string()))
        parts.append(term_counts(data, offsets))
    counts = np.concatenate(parts)
    weight = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    weight[1 : REPEATS + 1] *= REPEAT_WEIGHT
    matrix = _unit(_weighted(counts, weight))
    # randomised range finder with power steps, then an exact SVD of the small matrix
    found = np.random.default_rng(9).standard_normal((TERMS, min(dimensions + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        found = np.linalg.qr(matrix.T @ (matrix @ found))[0]
    _, _, axes = np.linalg.svd(matrix @ found, full_matrices=False)
    basis = (found @ axes[:dimensions].T).astype(np.float32)
    labels = np.array([r[2] for r in rows], np.float32)
    votes = np.ones(len(rows))
    if shares:
        for c in (0, 1):
            votes[labels == c] = shares[c] / max(1e-9, float((labels == c).mean()))
    return Space(weight, basis, _unit(matrix @ basis), labels, votes, float(labels.mean()))


def vote(space: Space, data: np.ndarray, offsets: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each row."""
    out = np.full(len(offsets) - 1, space.share)
    k = min(neighbours, len(space.labels))
    for at in range(0, len(out), BLOCK):
        to = min(len(out), at + BLOCK)
        counts = term_counts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        near = _unit(_weighted(counts, space.weight) @ space.basis) @ space.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        alike = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 4 * space.votes[top]
        total = alike.sum(1)
        out[at:to] = np.divide((alike * space.labels[top]).sum(1), total, out=out[at:to].copy(), where=total > 0)
    return np.clip(out, 0.0, 1.0)


def _score(space: Space | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            scores = vote(space, data, offsets) if space else np.full(rows.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores)], ["key", "score"])

    return run


def classify(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn_where=None, rows: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per document: key and ``score`` (0 to 1, higher: label 1 likelier)."""
    learned = labels if learn_where is None else labels.where(learn_where)
    space = fit(labelled.sample(training, learned, label, rows=rows, key=key, text=text), labelled.shares(learned, label))
    rows_in = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows_in.schema["key"].dataType.simpleString()
    return rows_in.mapInArrow(_score(space), f"key {kind}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = GOOD_FROM, rows: int = ROWS_PER_CLASS) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    A text too short to have terms of its own is not rejected by a vote; without labelled
    rows nothing is.
    """
    space = fit(labelled.sample(training, labels, label, rows=rows, key=key, text=text), labelled.shares(labels, label))
    if space is None:
        return docs
    space.share = 1.0
    return keep_rows(docs, text, lambda data, offsets: vote(space, data, offsets) >= threshold)
