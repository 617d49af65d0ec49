"""Documents alike in their five-word shingles, by prefix filters under several token orders.

A document is the set of its distinct shingles (64-bit hashes); two link when their Jaccard
similarity reaches a threshold.  Documents with the same set go on as one.  All token
orders put rare shingles first (by the power of two of their document frequency) and differ in how they
arrange equally rare ones.  Under any fixed order two linked sets share a shingle among
their first n - ceil(t n) + 1, so a candidate pair must do so under every order before its
sets are compared.

Frequencies: tasks send shingles, packed by bucket of the hash, to the task of the bucket,
which knows a shingle's frequency and sends back those held by more than one set.  Shingles
that are frequent within a task's share of documents are sent to no single place: the bucket
gets a mark, all tasks treat the shingle as of the highest frequency, and its occurrences are dealt
out.  A set that has too few shared shingles to link with anything drops out.

Candidates without all pairs of a group: within the postings of a prefix shingle each set is
first compared with the one that has the fewest shingles of its own, the likely original of
a group of near copies; then only sets of different components are compared, those outside a
shingle's largest component with all its others.  Links inside a component can't change it, so
the components are exact.  A posting knows how many shingles of its set come before it: a pair
whose first common shingle has too few after it can't link.

Defined cases: words are runs of other than ASCII white space, A to Z lower-cased; a text with
one to four words has its whole word sequence as its only shingle; a null, empty or blank
text has none and links with nothing; a row without an id is a component of its own with a
null id unless it links with a row that has one; rows that repeat an id are documents of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm.components import components
from rentlake.llm.textbatch import LOWER, byte_prefix, gram_hash, mix, slices, span_hash, words
from rentlake.session import cut_lineage

SHINGLE = 5
#: Similarity in hundredths.
ALIKE = 75
ORDERS = 3
#: Shingles a task holds before it sends them.
HELD = 1 << 20
#: A shingle is locally frequent from this many sets, and this share of the held sets.
FREQUENT, FREQUENT_SHARE = 64, 64
HIGHEST = 255

_SEEDS = np.random.default_rng(1).integers(1, 1 << 63, ORDERS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, the n + 1 bounds, and a hash of each set."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    hashes = span_hash(byte_prefix(low), starts, ends)
    grams = gram_hash(hashes, k)
    sets = []
    for i, n in enumerate(np.diff(bounds).tolist()):
        first = bounds[i]
        if n >= k:
            sets.append(np.unique(grams[first : first + n - k + 1]))
        elif n:
            sets.append(gram_hash(hashes[first : first + n], n) ^ np.uint64(n))
        else:
            sets.append(np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(1)))])
    return flat, at, mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        _, at, sets = shingle_sets(data, offsets)
        size = np.diff(at)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size), pa.array(sets, mask=size == 0)], ["id", "mark", "n_shingles", "set"])


def needed(n):
    """Least number of shared shingles of a set of n with any set it links with."""
    return (ALIKE * n + 99) // 100


class _Blobs:
    """Entries (shingle, set, size) and their codes, packed by bucket into few rows."""

    fields = "bucket int, shingles binary, codes binary, sets binary, sizes binary, counts binary, frequent binary"
    schema = pa.schema([("bucket", pa.int32()), *((f.split()[0], pa.binary()) for f in fields.split(", ")[1:])])

    @classmethod
    def pack(cls, bucket: np.ndarray, shingles: np.ndarray, codes: np.ndarray, sets: np.ndarray, sizes: np.ndarray, frequent: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Entries in any order; within a bucket they keep it, runs of a set are stored once."""
        order = np.argsort(bucket, kind="stable")
        bucket, shingles, codes, sets, sizes = bucket[order], shingles[order], codes[order], sets[order], sizes[order]
        numbers, first = np.unique(bucket, return_index=True)
        first = np.append(first, len(bucket))
        rows = []
        for b in sorted({*numbers.tolist(), *frequent}):
            i = int(np.searchsorted(numbers, b))
            x, y = (first[i], first[i + 1]) if i < len(numbers) and numbers[i] == b else (0, 0)
            own = sets[x:y]
            change = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if y > x else np.zeros(0, np.int64)
            counts = np.diff(np.append(change, y - x)).astype(np.uint32)
            parts = (shingles[x:y], codes[x:y], own[change], sizes[x:y][change].astype(np.uint32), counts, frequent.get(b, np.zeros(0, np.uint64)))
            rows.append([b, *(p.tobytes() for p in parts)])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), cls.schema.types)], cls.schema.names) if rows else pa.RecordBatch.from_pylist([], cls.schema)

    @classmethod
    def unpack(cls, table: pa.Table) -> tuple[np.ndarray, ...]:
        """shingles, codes, sets, sizes of the entries, and the shingles marked as frequent."""
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(name))])
        counts = read("counts", np.uint32)
        return read("shingles", np.uint64), read("codes", np.uint8), np.repeat(read("sets", np.int64), counts), np.repeat(read("sizes", np.uint32), counts), read("frequent", np.uint64)


def _deal(bits: int):
    """Shingles of the texts' sets, by bucket; locally frequent ones go to spare buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            shingles, size, sets = (np.concatenate([h[i] for h in held]) for i in range(3))
            # copies of a set within the share count once
            _, first = np.unique(sets, return_index=True)
            one = np.zeros(len(sets), bool)
            one[first] = True
            shingles = shingles[np.repeat(one, size)]
            sets, size = sets[one], size[one]
            of = np.repeat(np.arange(len(sets)), size)
            ordered = np.sort(shingles)
            change = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            often = ordered[change][np.diff(np.append(change, len(ordered))) >= max(FREQUENT, len(sets) // FREQUENT_SHARE)]
            bucket = (shingles >> np.uint64(64 - bits)).astype(np.int32)
            marks = {}
            if len(often):
                is_often = np.isin(shingles, often)
                spread = mix(sets.view(np.uint64) + np.uint64(5))[of]
                bucket[is_often] = (1 << bits) + (spread[is_often] >> np.uint64(64 - bits)).astype(np.int32)
                home = (often >> np.uint64(64 - bits)).astype(np.int32)
                marks = {int(b): often[home == b] for b in np.unique(home)}
            return _Blobs.pack(bucket, shingles, np.zeros(len(shingles), np.uint8), sets[of], size[of], marks)

        for _, data, offsets in slices(batches):
            shingles, at, sets = shingle_sets(data, offsets)
            held.append((shingles, np.diff(at), sets))
            n += len(shingles)
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _frequencies(bits: int):
    """Entries of shingles that more than one set holds, with the power of two of their number."""

    def run(table: pa.Table) -> pa.Table:
        spare = table.column("bucket")[0].as_py() >= 1 << bits
        shingles, codes, sets, sizes, frequent = _Blobs.unpack(table)
        if spare:
            codes = np.full(len(shingles), HIGHEST, np.uint8)
        else:
            order = np.argsort(shingles, kind="stable")
            ordered = shingles[order]
            same = ordered[1:] == ordered[:-1]
            many = np.append(False, same) | np.append(same, False) | np.isin(ordered, np.unique(frequent))
            order = order[many]
            order = order[np.lexsort((sets[order], shingles[order]))]
            shingles, sets, sizes = shingles[order], sets[order], sizes[order]
            # a set may come from several tasks
            new = np.append(True, (shingles[1:] != shingles[:-1]) | (sets[1:] != sets[:-1])) if len(order) else np.zeros(0, bool)
            shingles, sets, sizes = shingles[new], sets[new], sizes[new]
            first = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1])) if len(shingles) else np.zeros(0, np.int64)
            number = np.diff(np.append(first, len(shingles)))
            marked = np.isin(shingles[first], frequent)
            code = np.where(marked, HIGHEST, np.minimum(np.log2(np.maximum(number, 1)).astype(np.int64), HIGHEST - 1))
            wanted = np.repeat((number > 1) | marked, number)
            codes = np.repeat(code, number).astype(np.uint8)[wanted]
            shingles, sets, sizes = shingles[wanted], sets[wanted], sizes[wanted]
            order = np.argsort(sets, kind="stable")
            shingles, codes, sets, sizes = shingles[order], codes[order], sets[order], sizes[order]
        home = (mix(sets.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
        return pa.Table.from_batches([_Blobs.pack(home, shingles, codes, sets, sizes, {})], _Blobs.schema)

    return run


def prefix(shingles: np.ndarray, codes: np.ndarray, n: int, order: int) -> np.ndarray:
    """The shared ones among the first n - needed(n) + 1 shingles of a set under an order; unshared ones come first."""
    take = len(shingles) - int(needed(n)) + 1
    return shingles[np.lexsort((mix(shingles ^ _SEEDS[order]), codes))[:take]]


def _collect(table: pa.Table) -> pa.Table:
    """Sets that may link: their shared shingles, sorted, and the prefix under the first order."""
    shingles, codes, sets, sizes, _ = _Blobs.unpack(table)
    order = np.lexsort((shingles, sets))
    shingles, codes, sets, sizes = shingles[order], codes[order], sets[order], sizes[order]
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (sets[1:] != sets[:-1])) if len(order) else np.zeros(0, bool)
    shingles, codes, sets, sizes = shingles[new], codes[new], sets[new], sizes[new]
    first = np.flatnonzero(np.append(True, sets[1:] != sets[:-1])) if len(sets) else np.zeros(0, np.int64)
    out: dict[str, list] = {"set": [], "n": [], "own": [], "shingles": [], "codes": [], "prefix": []}
    for a, b in zip(first, np.append(first[1:], len(sets))):
        n = int(sizes[a])
        if b - a < needed(n):
            continue
        out["set"].append(int(sets[a]))
        out["n"].append(n)
        out["own"].append(n - int(b - a))
        out["shingles"].append(shingles[a:b].tobytes())
        out["codes"].append(codes[a:b].tobytes())
        out["prefix"].append(prefix(shingles[a:b], codes[a:b], n, 0).view(np.int64))
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], list(out))


def alike(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> bool:
    """Whether two sets (shared shingles, codes, size) pass the filter of every further order and link."""
    for order in range(1, ORDERS):
        if not len(np.intersect1d(prefix(*a, order), prefix(*b, order), True)):
            return False
    both = len(np.intersect1d(a[0], b[0], True))
    return 100 * both >= ALIKE * (a[2] + b[2] - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = {}
        for s in "ab":
            shingles, codes = (batch.column(batch.schema.get_field_index(f"{s}_{c}")) for c in ("shingles", "codes"))
            n = np.asarray(batch.column(batch.schema.get_field_index(f"{s}_n")))
            own[s] = lambda i, x=shingles, y=codes, n=n: (np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint8), int(n[i]))
        yield batch.select(["a", "b"]).filter(pa.array([alike(own["a"](i), own["b"](i)) for i in range(batch.num_rows)], pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda s: sets.select(F.col("set").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "shingles", "codes")])
    return cut_lineage(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a bigint, b bigint"))


def _may_link(n_a, rest_a, n_b, rest_b):
    """Whether sets of these sizes can link, given how many shingles each has from a common one on."""
    size = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * ALIKE)
    return size & (F.least(rest_a, rest_b) * (100 + ALIKE) >= (n_a + n_b) * ALIKE)


def _grouped(docs: DataFrame, key: str, text: str, buckets: int | None) -> DataFrame:
    """id, mark (hash of the text), n_shingles, component (null without shingles)."""
    spark = docs.sparkSession
    wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (wanted - 1).bit_length())
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sized = cut_lineage(rows.mapInArrow(_sizes, f"id {kind}, mark bigint, n_shingles bigint, set bigint"))

    dealt = rows.select("text").mapInArrow(_deal(bits), _Blobs.fields)
    shared = dealt.groupBy("bucket").applyInArrow(_frequencies(bits), _Blobs.fields)
    sets = cut_lineage(shared.groupBy("bucket").applyInArrow(_collect, "set bigint, n int, own int, shingles binary, codes binary, prefix array<bigint>"))

    k = F.col
    postings = sets.select("set", "n", "own", F.posexplode("prefix").alias("at", "shingle"))
    postings = postings.select("set", "n", "own", (k("n") - k("own") - k("at")).alias("rest"), "shingle")
    hubs = postings.groupBy("shingle").agg(F.min(F.struct("own", "set", "n", "rest")).alias("hub"), F.count("*").alias("held")).where("held > 1").select("shingle", "hub")
    first = postings.join(hubs, "shingle").where("set <> hub.set").where(_may_link(k("n"), k("rest"), k("hub.n"), k("hub.rest")))
    links = _linked(first.select(k("set").alias("a"), k("hub.set").alias("b")).distinct(), sets)

    groups = components(links).withColumnsRenamed({"node": "set", "component": "group"})
    grouped = postings.join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))
    # Shingles of several components, without sets that have too little left for any other there.
    split = grouped.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("n").alias("least")).where("low <> high").select("shingle", "least")
    enough = k("rest") * (100 + ALIKE) >= (k("n") + F.greatest(k("least"), F.ceil(k("n") * ALIKE / 100))) * ALIKE
    open_ = cut_lineage(grouped.join(split, "shingle").where(enough).select("shingle", "set", "n", "rest", "group"))
    sizes = open_.groupBy("shingle", "group").agg(F.count("*").alias("held"))
    split = sizes.groupBy("shingle").agg(F.max_by("group", F.struct("held", "group")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("shingle", "largest")
    open_ = cut_lineage(open_.join(split, "shingle"))
    left = open_.where("group <> largest").select("shingle", *[k(c).alias(f"a_{c}") for c in ("set", "n", "rest", "group")])
    across = left.join(open_, "shingle").where("group <> a_group and (group = largest or a_set < set)").where(_may_link(k("n"), k("rest"), k("a_n"), k("a_rest")))
    more = _linked(across.select(k("a_set").alias("a"), k("set").alias("b")).distinct(), sets)

    groups = components(links.unionAll(more)).withColumnsRenamed({"node": "set", "component": "group"})
    return sized.join(groups, "set", "left").select("id", "mark", "n_shingles", F.coalesce("group", "set").alias("component"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component`` (a number of its component, null without shingles) and ``component_id``.

    ``buckets`` is the number of parts into which shingles are dealt, up to the next power of
    two; by default as many as shuffle partitions.
    """
    placed = cut_lineage(_grouped(docs, key, text, buckets))
    least = placed.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "component", "left").select("id", "n_shingles", "component", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumnRenamed("id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Documents without shingles all stay, but of rows that repeat both id and text one stays;
    rows without an id are not grouped and stay.
    """
    placed = cut_lineage(_grouped(docs.where(F.col(key).isNotNull()), key, text, buckets))
    least = placed.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("first"))
    stay = least.select("first.*").unionAll(placed.where("component is null").select("id", "mark")).distinct()
    mark = "mark"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(text)).join(stay.withColumnsRenamed({"id": key, "mark": mark}), [key, mark], "left_semi")
    return marked.dropDuplicates([key, mark]).select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where(F.col(key).isNull()))
