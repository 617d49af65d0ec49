"""Near-duplicate vectors by an epsilon grid order join.

Equal vectors are counted first and go on as one.  Unit vectors are projected on the
leading principal axes of all vectors; a cosine of at least t means a distance of at most
sqrt(2 - 2t), which a projection can only shorten.  Vectors are sorted by label and grid cell
(cells as wide as that distance) and cut into blocks of the sequence.  Pairs of sequence
intervals are joined from the top down: a pair whose boxes are farther apart is dropped,
the others are split into their parts, down to blocks and, within a task, to runs of a
block.  What remains is compared in double precision.

Links are not written out: a block pair gives each vector's number of links and one
link to the first vector of its local group, which is enough for components.

Defined cases: vectors with a null label, null, empty, zero, or with null or non-finite
components link with nothing, nor do vectors of different lengths; rows without an id are kept
and link with nothing; rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm.components import components
from rentlake.llm.textbatch import column
from rentlake.session import cut_lineage

THRESHOLD = 0.93
AXES = 8
#: Vectors of a block, and of the runs into which a task splits it.
BLOCK = 1024
RUN = 128
#: Parts of an interval.
FAN = 8
#: What rounding may take from a distance between boxes.
SLACK = 1e-6


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.asarray(column(batch, "width"))
    for width in np.unique(widths):
        yield int(width), batch.filter(pa.array(widths == width))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x and of x x^T of each width, one entry a row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, rows in _by_width(batch):
            x = _unit(_matrix(column(rows, "vector"), width))
            x = np.hstack([np.ones((len(x), 1)), x])
            total[width] = total.get(width, 0) + x.T @ x
    for width, sums in total.items():
        n = sums.size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, width)), pa.array(np.arange(n)), pa.array(sums.ravel())], ["width", "place", "value"])


def principal_axes(vectors: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """Of each width, the directions along which unit vectors vary most (columns)."""
    sums = vectors.select("width", "vector").mapInArrow(_moments, "width bigint, place bigint, value double").groupBy("width", "place").agg(F.sum("value").alias("value"))
    entries: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        entries.setdefault(r["width"], {})[r["place"]] = r["value"]
    out = {}
    for width, own in entries.items():
        m = np.array([own[i] for i in range((width + 1) ** 2)]).reshape(width + 1, width + 1)
        mean = m[0, 1:] / m[0, 0]
        _, directions = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[width] = directions[:, ::-1][:, :axes]
    return out


def _project(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in _by_width(batch):
                at = _unit(_matrix(column(rows, "vector"), width)) @ axes[width]
                cells = np.floor(at / epsilon).astype(np.int32)
                pad = AXES - at.shape[1]
                at, cells = np.pad(at, ((0, 0), (0, pad))), np.pad(cells, ((0, 0), (0, pad)))
                bounds = pa.array(np.arange(0, at.size + 1, AXES, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.ravel())) for x in (cells, at)]
                yield pa.RecordBatch.from_arrays([*(column(rows, c) for c in ("label", "width", "node", "n")), *lists, column(rows, "vector")], ["label", "width", "node", "n", "cells", "place", "vector"])

    return run


_BLOCK_FIELDS = "label bigint, width bigint, part bigint, number bigint, low array<double>, high array<double>, nodes binary, counts binary, places binary, vectors binary"


def _blocks(size: int):
    """Runs of a sorted partition with one label and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            place = _matrix(column(rows, "place"), AXES)
            width = column(rows, "width")[0].as_py()
            values = [column(rows, "label")[0].as_py(), width, column(rows, "part")[0].as_py(), number, place.min(0).tolist(), place.max(0).tolist()]
            blobs = [np.asarray(column(rows, "node"), np.int64), np.asarray(column(rows, "n"), np.int64), place, np.asarray(column(rows, "vector").flatten())]
            return pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in _BLOCK_FIELDS.split(", ")), [*values, *(b.tobytes() for b in blobs)]))], _BLOCK_TYPE)

        n, group = 0, None
        for batch in batches:
            labels, widths = np.asarray(column(batch, "label")), np.asarray(column(batch, "width"))
            at = 0
            while at < batch.num_rows:
                own = (labels[at], widths[at])
                if held and (own != group or n == size):
                    yield made(held)
                    number, held, n = number + 1, [], 0
                group = own
                same = (labels[at:] == own[0]) & (widths[at:] == own[1])
                to = at + min(size - n, len(same) if same.all() else int(same.argmin()))
                held.append(batch.slice(at, to - at))
                n, at = n + to - at, to
        if held:
            yield made(held)

    return run


_BLOCK_TYPE = pa.schema([
    ("label", pa.int64()), ("width", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
    ("nodes", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("vectors", pa.binary()),
])


def _apart(a: str, b: str, epsilon: float):
    """Whether two boxes may hold points within epsilon."""
    square = F.lit(0.0)
    for i in range(AXES):
        gap = F.greatest(F.lit(0.0), F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i], F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i])
        square = square + gap * gap
    return square <= (epsilon + SLACK) ** 2


def _block_pairs(boxes: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(a, b) with a <= b: blocks of one label that may hold links, from the top down."""
    levels = 0
    while FAN**levels < n:
        levels += 1
    own = ["label", "width"]
    at = lambda level: boxes.groupBy(*own, F.floor(F.col("seq") / FAN**level).alias("node"), F.floor(F.col("seq") / FAN ** (level + 1)).alias("parent")).agg(
        *[F.array(*[f(F.col(side)[i]) for i in range(AXES)]).alias(side) for side, f in (("low", F.min), ("high", F.max))]
    )
    top = at(levels)
    pairs = top.select(*own, F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(levels - 1, -1, -1):
        parts = at(level)
        left = parts.select(*own, F.col("parent").alias("a"), F.struct("node", "low", "high").alias("x"))
        right = parts.select(*own, F.col("parent").alias("b"), F.struct("node", "low", "high").alias("y"))
        pairs = pairs.join(left, [*own, "a"]).join(right, [*own, "b"]).where((F.col("x.node") <= F.col("y.node")) & _apart("x", "y", epsilon))
        pairs = cut_lineage(pairs.select(*own, F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs.select("a", "b")


def _runs(place: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    return [(i, min(i + RUN, len(place)), place[i : i + RUN].min(0), place[i : i + RUN].max(0)) for i in range(0, len(place), RUN)]


def _compare(threshold: float, epsilon: float, element: type):
    def links_of(a: dict, b: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        found = []
        runs_b = _runs(b["place"])
        for start, end, low, high in _runs(a["place"]):
            for start_b, end_b, low_b, high_b in runs_b:
                if same and end_b <= start:
                    continue
                gap = np.maximum(0, np.maximum(low_b - high, low - high_b))
                if gap @ gap > (epsilon + SLACK) ** 2:
                    continue
                i, j = np.nonzero(a["vector"][start:end] @ b["vector"][start_b:end_b].T >= threshold)
                i, j = i + start, j + start_b
                found.append((i[i < j], j[i < j]) if same else (i, j))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def block(row: dict, side: str) -> dict:
        nodes = np.frombuffer(row[f"{side}_nodes"], np.int64)
        return {
            "node": nodes, "n": np.frombuffer(row[f"{side}_counts"], np.int64), "place": np.frombuffer(row[f"{side}_places"], np.float64).reshape(len(nodes), AXES),
            "vector": _unit(np.frombuffer(row[f"{side}_vectors"], element).astype(np.float64).reshape(len(nodes), -1)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b, same = block(row, "x"), block(row, "y"), row["a"] == row["b"]
                i, j = links_of(a, b, same)
                if not len(i):
                    continue
                if same:
                    node, n = a["node"], a["n"]
                else:
                    node, n, j = np.concatenate([a["node"], b["node"]]), np.concatenate([a["n"], b["n"]]), j + len(a["node"])
                count = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
                first = np.arange(len(node))
                while True:  # local groups: every vector takes the smallest place it is linked with
                    before = first.copy()
                    np.minimum.at(first, i, first[j])
                    np.minimum.at(first, j, first[i])
                    first = first[first]
                    if (first == before).all():
                        break
                own = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(count[own].astype(np.int64)), pa.array(node[first[own]])], ["node", "links", "first"])

    return run


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id`` and ``kept``.  ``threshold`` lies between 0 and 1."""
    epsilon = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & whole, F.lit(False))
    # two hashes of label and vector stand for them, so that copies meet without the vector
    rows = rows.withColumns({"node": F.when(usable, F.xxhash64("label", "vector")), "guard": F.when(usable, F.xxhash64(F.lit(1), "vector"))})
    same = ["node", "guard"]
    distinct = cut_lineage(
        rows.where("node is not null")
        .groupBy(*same)
        .agg(F.first("label").alias("label"), F.min("id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
        .withColumn("width", F.size("vector").cast("long"))
    )
    kind = distinct.schema["vector"].dataType.simpleString()
    axes = principal_axes(distinct)
    placed = distinct.select("label", "width", "node", "n", "vector").mapInArrow(
        _project(axes, epsilon), f"label bigint, width bigint, node bigint, n bigint, cells array<int>, place array<double>, vector {kind}"
    )
    order = ["label", "width", *[F.col("cells")[i] for i in range(AXES)], "node"]
    sequence = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")).drop("cells")
    blocks = cut_lineage(sequence.mapInArrow(_blocks(BLOCK), _BLOCK_FIELDS))
    # one number for each input partition: where its blocks begin in the whole sequence
    sizes = sorted((r["part"], r["count"]) for r in blocks.groupBy("part").count().collect())
    before, n = [], 0
    for part, count in sizes:
        before.append((part, n))
        n += count
    begins = blocks.sparkSession.createDataFrame(before, "part bigint, before bigint")
    blocks = blocks.join(begins, "part").withColumn("seq", F.col("before") + F.col("number"))
    pairs = _block_pairs(blocks.select("label", "width", "seq", "low", "high"), n, epsilon)
    side = lambda name, s: blocks.select(F.col("seq").alias(name), *[F.col(c).alias(f"{s}_{c}") for c in ("nodes", "counts", "places", "vectors")])
    element = np.float32 if kind == "array<float>" else np.float64
    compared = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(_compare(threshold, epsilon, element), "node bigint, links bigint, first bigint")
    found = cut_lineage(compared)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
    known = distinct.select(*same, "least", "n").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("vector").join(known, same, "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
