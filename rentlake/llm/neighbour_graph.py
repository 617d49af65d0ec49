"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Equal vectors are one node.  Nodes start with the best partners they meet in short runs of
a few random orders (sorted by the signs of random projections).  Then rounds of joins compare
neighbours of neighbours: every node is sent the codes of those it lists and of those that list it,
compares all that have not met, and proposes to each what beats its list; the rounds end when
few entries change.  A query starts at its own node and its list, and goes on from all unvisited
nodes among the best found, until the best ``POOL`` are visited.  What it found is scored again on
the original vectors, in double precision.

Codes are vectors in 8 bits a component and a scale: they decide which nodes are looked at, never
a score that is returned.  A node is sent to the ``LISTED`` nearest of those that list it; the
others keep it in their own lists.  Results are approximate: README has the measured share of true neighbours.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, take no part; a vector is compared with those of its own length only; rows that
repeat an id are rows of their own, of which a query leaves out all with its own id.  With fewer
candidates than asked for, a query returns those it found.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlake.llm.textbatch import column
from rentlake.session import cut_lineage, fresh_folder, scratch

#: Partners a node lists, and nodes by which it is listed that it is sent to.
NEIGHBOURS, LISTED = 32, 64
#: Random orders of the start, and nodes of a run.
ORDERS, RUN = 3, 128
#: Nodes of a partition of a random order.
PART = 1 << 14
#: Descent ends when at most this share of all list entries is new, or after so many rounds.
CHANGED, ROUNDS = 0.01, 12
#: Best nodes a query visits, and those of them that are scored again for each result asked for.
POOL, RESCORED = 160, 2

_FOUND = "node bigint, ids array<bigint>, sims array<float>"
_FOUND_TYPE = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])
_LISTS = "node bigint, width int, code binary, worst float, ids array<bigint>, sims array<float>, marks array<boolean>"


def encode(vectors: np.ndarray, top: float) -> list[bytes]:
    """One code per row: its scale (in parts of ``top``), then its components in 8 bits."""
    largest = np.abs(vectors).max(1)
    scale = (largest / top / 127).astype(np.float32)
    small = np.rint(vectors / largest[:, None] * 127).astype(np.int8)
    return [s.tobytes() + v.tobytes() for s, v in zip(scale, small)]


def decode(codes: np.ndarray) -> np.ndarray:
    """Vectors of codes, one code a row of bytes."""
    scale = np.ascontiguousarray(codes[:, :4]).view(np.float32)
    return np.ascontiguousarray(codes[:, 4:]).view(np.int8).astype(np.float32) * scale


def _bytes(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes end to end, and where each begins."""
    codes = codes.cast(pa.large_binary())
    _, offsets, data = codes.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(codes) + 1, codes.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _flat(lists: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Items of all lists and the n + 1 bounds between them."""
    bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind), bounds


def _listed(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _ranked(row: np.ndarray, ids: np.ndarray, sims: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n rows' entries (no id twice in a row) the places of the ``size`` nearest, nearest first, and their bounds."""
    order = np.lexsort((ids, -sims, row))
    begins = np.searchsorted(row[order], np.arange(n + 1))
    order = order[np.arange(len(order)) - begins[row[order]] < size]
    return order, np.searchsorted(row[order], np.arange(n + 1))


def _coded(top: float):
    """Codes, and the signs of random projections as sort keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(column(batch, "width"))
            for width in np.unique(widths).tolist():
                rows = batch.filter(pa.array(widths == width))
                x = np.asarray(column(rows, "vector").flatten(), np.float64).reshape(rows.num_rows, width)
                # directions follow from the length alone: every task has the same
                directions = np.random.default_rng(width).standard_normal((width, ORDERS * 62))
                signs = ((x / np.abs(x).max(1, keepdims=True)) @ directions > 0).astype(np.int64)
                keys = [pa.array(signs[:, 62 * i : 62 * i + 62] @ (np.int64(1) << np.arange(61, -1, -1))) for i in range(ORDERS)]
                names = ["node", "width", "code", *(f"key{i}" for i in range(ORDERS))]
                yield pa.RecordBatch.from_arrays([column(rows, "node"), column(rows, "width"), pa.array(encode(x, top), pa.binary()), *keys], names)

    return run


class _Proposals:
    """What a batch found for each node: its ``size`` nearest."""

    def __init__(self, size: int):
        self.size, self.held = size, []

    def add(self, to: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        if len(to):
            self.held.append((to, ids, sims))

    def rows(self) -> pa.RecordBatch:
        if not self.held:
            return pa.RecordBatch.from_pylist([], _FOUND_TYPE)
        to, ids, sims = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order = np.lexsort((ids, to))
        to, ids, sims = to[order], ids[order], sims[order]
        new = np.append(True, (to[1:] != to[:-1]) | (ids[1:] != ids[:-1]))
        to, ids, sims = to[new], ids[new], sims[new]
        nodes, row = np.unique(to, return_inverse=True)
        own, bounds = _ranked(row, ids, sims, len(nodes), self.size)
        return pa.RecordBatch.from_arrays([pa.array(nodes), _listed(ids[own], bounds), _listed(sims[own], bounds)], schema=_FOUND_TYPE)


def _meet(out: _Proposals, x: np.ndarray, ids: np.ndarray, worst: np.ndarray, fresh: np.ndarray) -> None:
    """Propose to each node those that are nearer than its worst; pairs without a fresh entry have met."""
    sims = x @ x.T
    better = (sims > worst[:, None]) & (fresh[:, None] | fresh)
    np.fill_diagonal(better, False)
    i, j = np.nonzero(better)
    out.add(ids[i], ids[j], sims[i, j])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each run of a sorted partition; the last run takes what is left over."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        out = _Proposals(NEIGHBOURS)
        ids, widths = (rows.column(c).to_numpy() for c in ("node", "width"))
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            codes = b"".join(rows.column("code").take(pa.array(own)).to_pylist())
            _meet(out, decode(np.frombuffer(codes, np.uint8).reshape(len(own), -1)), ids[own], np.full(len(own), -np.inf, np.float32), np.ones(len(own), bool))
        return out.rows()

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows >= 2 * RUN:
            yield compare(held.slice(0, RUN))
            held = held.slice(RUN)
    if held is not None and held.num_rows:
        yield compare(held)


def _merge(size: int, mark_new: bool):
    """Lists with what was found for them; a listed id keeps its mark, a new one gets ``mark_new``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (ids, old), (more, new) = (_flat(column(batch, c), np.int64) for c in ("ids", "more_ids"))
            sims = np.concatenate([_flat(column(batch, c), np.float32)[0] for c in ("sims", "more_sims")])
            marks = np.concatenate([_flat(column(batch, "marks"), bool)[0], np.full(len(more), mark_new)])
            row = np.concatenate([np.repeat(np.arange(n), np.diff(b)) for b in (old, new)])
            ids = np.concatenate([ids, more])
            order = np.lexsort((np.arange(len(ids)), ids, row))  # listed entries stand first
            row, ids, sims, marks = row[order], ids[order], sims[order], marks[order]
            once = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])) if len(row) else np.zeros(0, bool)
            row, ids, sims, marks = row[once], ids[once], sims[once], marks[once]
            own, bounds = _ranked(row, ids, sims, n, size)
            sims = sims[own]
            worst = np.full(n, -np.inf, np.float32)
            full = np.diff(bounds) == size
            worst[full] = sims[bounds[1:][full] - 1]
            lists = [_listed(v, bounds) for v in (ids[own], sims, marks[own])]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("node", "width", "code")), pa.array(worst), *lists], [f.split()[0] for f in _LISTS.split(", ")])

    return run


def _with_found(lists: DataFrame, found: DataFrame, size: int, mark_new: bool) -> DataFrame:
    more = found.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("more_ids"), F.flatten(F.collect_list("sims")).alias("more_sims"))
    return lists.join(more, "node", "left").mapInArrow(_merge(size, mark_new), _LISTS)


def _neighbourhoods(lists: DataFrame) -> DataFrame:
    """Of every node, those it lists and the nearest that list it."""
    edges = lists.select(F.col("node").alias("a"), "code", "worst", F.inline(F.arrays_zip(F.col("ids").alias("b"), F.col("sims").alias("sim"), F.col("marks").alias("fresh"))))
    nearest = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    back = edges.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= LISTED).select(F.col("b").alias("node"), F.col("a").alias("id"), "code", "worst", "fresh")
    ends = lists.select(F.col("node").alias("b"), F.col("code").alias("code_b"), F.col("worst").alias("worst_b"))
    forward = edges.select("a", "b", "fresh").join(ends, "b").select(F.col("a").alias("node"), F.col("b").alias("id"), F.col("code_b").alias("code"), F.col("worst_b").alias("worst"), "fresh")
    items = [F.collect_list(c).alias(c) for c in ("id", "code", "worst", "fresh")]
    return forward.unionAll(back).groupBy("node").agg(*items)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node, one with another."""
    for batch in batches:
        out = _Proposals(NEIGHBOURS)
        ids, bounds = _flat(column(batch, "id"), np.int64)
        worst, fresh = _flat(column(batch, "worst"), np.float32)[0], _flat(column(batch, "fresh"), bool)[0]
        codes, at = _bytes(column(batch, "code").flatten())
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if fresh[a:b].any():
                # one that lists and is listed stands twice, once with the mark of either list
                order = np.lexsort((~fresh[a:b], ids[a:b]))
                own = order[np.append(True, np.diff(ids[a:b][order]) != 0)]
                x = decode(codes[at[a] : at[b]].reshape(b - a, -1)[own])
                _meet(out, x, ids[a:b][own], worst[a:b][own], fresh[a:b][own])
        yield out.rows()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a visited node that are nearer to the query than its worst."""
    for batch in batches:
        out = _Proposals(POOL)
        query, worst = (column(batch, c).to_numpy() for c in ("query", "worst"))
        ids, bounds = _flat(column(batch, "id"), np.int64)
        codes, at = _bytes(column(batch, "codes").flatten())
        asked, begin = _bytes(column(batch, "code"))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            x = decode(codes[at[a] : at[b]].reshape(b - a, -1))
            sims = x @ decode(asked[begin[i] : begin[i + 1]].reshape(1, -1))[0]
            near = np.flatnonzero(sims > worst[i])
            out.add(np.full(len(near), query[i]), ids[a:b][near], sims[near])
        yield out.rows()


def _written(df: DataFrame) -> DataFrame:
    """Written like ``cut_lineage``, but not dropped with the tables of a round."""
    path = fresh_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (node, least id, width, vector), and the nodes of all usable ids (id, node)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(F.col("id").isNotNull() & (F.size("vector") > 0) & whole, F.lit(False)))
    same = ["hash", "guard"]
    rows = rows.withColumns({"hash": F.xxhash64("vector"), "guard": F.xxhash64(F.lit(1), "vector")})
    distinct = _written(rows.groupBy(*same).agg(F.min("id").alias("least"), F.first("vector").alias("vector")).withColumns({"width": F.size("vector"), "node": F.col("hash")}))
    return distinct.select("node", "least", "width", "vector"), rows.join(distinct.select("node", *same), same).select("id", "node").distinct()


def descend(points: DataFrame) -> DataFrame:
    """The neighbour graph of ``nodes``: of each node its code, its nearest found, and how near they are."""
    spark = points.sparkSession
    shape = points.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    keys = [f"key{i}" for i in range(ORDERS)]
    with scratch(spark):
        coded = cut_lineage(points.select("node", "width", "vector").mapInArrow(_coded(shape["top"] or 1.0), "node bigint, width int, code binary, " + ", ".join(f"{k} bigint" for k in keys)))
        found = None
        for k in keys:
            order = coded.select("node", "width", "code", k).repartitionByRange(-(-shape["n"] // PART) or 1, "width", k, "node").sortWithinPartitions("width", k, "node")
            met = order.drop(k).mapInArrow(_runs, _FOUND)
            found = met if found is None else found.unionAll(met)
        empty = coded.select("node", "width", "code", F.lit(float("-inf")).cast("float").alias("worst"), F.expr("cast(array() as array<bigint>)").alias("ids"), F.expr("cast(array() as array<float>)").alias("sims"), F.expr("cast(array() as array<boolean>)").alias("marks"))
        graph = _written(_with_found(empty, found, NEIGHBOURS, True))
    for _ in range(ROUNDS):
        with scratch(spark):
            found = _neighbourhoods(graph).where(F.array_contains("fresh", True)).mapInArrow(_compare, _FOUND)
            met = graph.withColumn("marks", F.transform("marks", lambda _: F.lit(False)))
            graph = _written(_with_found(met, found, NEIGHBOURS, True))
        changed = graph.agg(F.sum(F.size(F.filter("marks", lambda m: m)))).first()[0] or 0
        if changed <= CHANGED * NEIGHBOURS * shape["n"]:
            break
    return graph


def search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, node, sim) of the best nodes that greedy search finds from each of the ``queries`` (node); similarities are of codes."""
    around = cut_lineage(_neighbourhoods(graph).select("node", "id", F.col("code").alias("codes")))
    start = graph.join(queries.select("node").distinct(), "node", "left_semi")
    own = start.select("node", F.array("node").alias("more_ids"), F.array(F.lit(float("-inf")).cast("float")).alias("more_sims"))
    state = _written(start.withColumn("marks", F.transform("marks", lambda _: F.lit(False))).withColumn("worst", F.lit(float("-inf")).cast("float")).join(own, "node").mapInArrow(_merge(POOL, False), _LISTS))
    while True:
        at = F.filter(F.arrays_zip(F.col("ids").alias("node"), "marks"), lambda e: ~e.marks)
        open_ = state.select(F.col("node").alias("query"), "code", "worst", F.inline(at)).drop("marks")
        if open_.isEmpty():
            break
        found = open_.join(around, "node").mapInArrow(_expand, _FOUND)
        visited = state.withColumn("marks", F.transform("marks", lambda _: F.lit(True)))
        state = _written(_with_found(visited, found, POOL, False))
    return state.select(F.col("node").alias("query"), F.inline(F.arrays_zip(F.col("ids").alias("node"), F.col("sims").alias("sim"))))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), key, ``score``: of each row that ``queries`` picks (a condition on columns of ``vectors``), the k nearest found.

    ``score`` is the inner product of the original vectors in double precision.
    """
    points, members = nodes(vectors, key, vector)
    members = cut_lineage(members)
    asked = cut_lineage(vectors.where(F.coalesce(queries, F.lit(False))).select(F.col(key).cast("long").alias("id")).distinct().join(members, "id"))
    graph = descend(points)
    found = search(graph, asked)
    near = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    pairs = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= RESCORED * (k + 4)).select("query", "node")
    pairs = pairs.unionAll(asked.select(F.col("node").alias("query"), "node")).distinct()
    side = lambda name, x: points.select(F.col("node").alias(name), F.col("vector").alias(x), F.col("least").alias(f"least_{x}"))
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    scored = pairs.join(side("query", "x"), "query").join(side("node", "y"), "node").select("query", "node", F.col("least_y").alias("least"), product.alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place", "least")
    # of equal vectors only the smallest ids can be among the nearest
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1).drop("place")
    listed = scored.join(first, "node").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("list"))
    results = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
    others = F.slice(F.filter("list", lambda e: e.id != F.col("query_id")), 1, k)
    return results.select("query_id", F.posexplode(others).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias(key), F.col("e.score").alias("score"))
