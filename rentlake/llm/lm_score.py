"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both are bigram models of the same form (Dirichlet smoothing towards their own unigrams) over one
shared vocabulary: all words of all documents, by 64-bit hash, and one entry for the start of a text.  The background is counted over all documents, the target
over the documents that are labelled as such; to match in size, background counts are
scaled to the target's number of tokens instead of taking a sample.  A document's own words
are part of the models it belongs to.

Pair counts grow with the corpus, so no task or machine holds them: pairs are dealt to buckets by
hash, already added up by task.  A bounded number of the most frequent pairs, and the counts
of the vocabulary, go to all tasks; texts are scored against these on the spot.  Their
other pairs are dealt to the bucket that knows them, added up there for each document (and sent
back with 24 bits), and added to the rest.  A frequent pair thus never meets in one place.

The most frequent words have numbers that go to all tasks; the rest are rare, and no task holds them all.
A pair with a rare second word is dealt by that word, whose bucket thus knows its own count, the sum of its pairs,
as well; one with a rare first word alone, by that.  What a rare word costs as the first of the next pair is charged where
it is the second, and given back (by an entry for the word alone) where it ends a text.

Defined cases: words are runs of other than ASCII white space, A to Z lower-cased; a text without
words has 0 tokens and losses of 0; without target documents both models see the same
counts of nothing in the target, which is its smoothing alone; rows that repeat an id are
scored one by one; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm.textbatch import LOWER, byte_prefix, column, mix, owners, slices, span_hash, words
from rentlake.session import cut_lineage

#: Entries with a number: 0 for rare words, 1 for the start of a text.  Also the fewest entries that unigrams are smoothed over.
VOCABULARY = 1 << 15
#: Numbered words and the two other entries; only speed depends on it.
NUMBERED = VOCABULARY
#: Pairs every task knows.
KNOWN_PAIRS = 1 << 17
#: Weight of the unigrams in a pair's probability, in tokens.
SMOOTHING = 50.0
#: Entries a task holds before it adds them up and sends them, and those of asked pairs, which
#: are written to a table: its rows, and so its pages, stay small.
HELD = 1 << 20
HELD_ASKED = 1 << 18

_UNKNOWN, _START, _SHIFT = 0, 1, np.uint64(15)
_UNIGRAM = np.uint64(VOCABULARY)  # as the first of a pair: the word by itself
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Set in the number of a second word; alone, it stands for a rare word by itself.
_SECOND, _NUMBERS = np.uint64(VOCABULARY), np.uint64(2 * VOCABULARY)

_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNT_FIELDS = "bucket int, target boolean, keys binary, counts binary"


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    numbers, first = np.unique(bucket, return_index=True)
    for b, x, y in zip(numbers.tolist(), first, np.append(first[1:], len(bucket))):
        yield b, [c[x:y] for c in columns]


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(77)) >> np.uint64(64 - bits)).astype(np.int32)


def _added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, c, len(found)).astype(np.int64) for c in counts)


def _dense(blob: bytes) -> bytes:
    """Compressed, after its length; numbers of few digits take far less than their width."""
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True) if blob else blob


def _plain(blob) -> pa.Buffer:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd") if len(blob) else pa.py_buffer(b"")


def _plain_size(x: pa.Scalar) -> int:
    return int.from_bytes(x.as_py()[:8], "little")


def _packed(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    rows = [[_dense(x) if isinstance(x, bytes) else x for x in row] for row in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names) if rows else pa.RecordBatch.from_pylist([], schema)


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(_plain(x.as_py()), kind) for x in table.column(name))])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    return span_hash(byte_prefix(low), starts, ends), bounds


def _partial(keys_of, bits: int, target: bool):
    """Keys of the texts, added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _added(*(np.concatenate(x) for x in zip(*held)))
            # a count beyond 32 bits can't come from a task's share
            parts = _by_bucket(_bucket_of(keys, bits), keys, counts.astype(np.uint32))
            return _packed([[b, target, *(x.tobytes() for x in own)] for b, own in parts], _COUNTS)

        for _, data, offsets in slices(batches):
            keys = keys_of(data, offsets)
            held.append(_added(keys, np.ones(len(keys))))
            n += len(held[-1][0])
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _most_frequent(keep: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _added(_read(table, "keys", np.uint64), _read(table, "counts", np.uint32))
        top = np.lexsort((keys, -counts))[:keep]
        return pa.table({"hash": keys[top].view(np.int64), "n": counts[top]})

    return run


def vocabulary(docs: DataFrame, text: str, bits: int, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the most frequent words, sorted."""
    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_partial(lambda d, o: _word_hashes(d, o)[0], bits, False), _COUNT_FIELDS)
    # hashing spreads frequent words over the buckets; four times a bucket's share is enough for it
    keep = max(64, 4 * size >> bits)
    top = partial.groupBy("bucket").applyInArrow(_most_frequent(keep), "hash bigint, n bigint").orderBy(F.col("n").desc(), "hash").limit(size - 2)
    return np.sort(np.array([r["hash"] for r in top.select("hash").collect()], np.int64).view(np.uint64))


def _ids(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 2, _UNKNOWN).astype(np.uint64)


class _Tokens:
    """Words of texts with the ones before them, as numbers (0 if rare) and as 64-bit symbols (the number, or else the hash)."""

    def __init__(self, known: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        hashes, self.bounds = _word_hashes(data, offsets)
        self.ids = _ids(known, hashes)
        self.symbols = np.where(self.ids == _UNKNOWN, hashes, self.ids)
        some = np.diff(self.bounds) > 0
        firsts, self.lasts = self.bounds[:-1][some], self.bounds[1:][some] - 1
        self.before, self.before_symbols = (self._shifted(x, firsts) for x in (self.ids, self.symbols))
        self.rare = (self.ids == _UNKNOWN) | (self.before == _UNKNOWN)

    @staticmethod
    def _shifted(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[firsts] = _START
        return out

    def numbered_pairs(self) -> np.ndarray:
        return (self.before << _SHIFT | self.ids)[~self.rare]

    def rare_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash each is dealt by, and the other word: a rare first word's hash, a first word's number, or a second word's with a bit."""
        before, word = self.before_symbols[self.rare], self.symbols[self.rare]
        first_alone = self.ids[self.rare] != _UNKNOWN
        return np.where(first_alone, before, word), np.where(first_alone, word | _SECOND, before)


def _rare_key(by: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix(mix(by) * _FACTOR + mix(other + _FACTOR))


def _rare_blob(by: np.ndarray, other: np.ndarray) -> bytes:
    """Entries in the order of ``by``; each of its runs is stored once, a number in 16 bits."""
    change = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    long = other >= _NUMBERS
    runs = np.diff(np.append(change, len(by))).astype(np.uint32)
    parts = (np.array([len(change), len(by)]), by[change], runs, np.where(long, np.uint64(0), other).astype(np.uint16), other[long])
    return b"".join(x.tobytes() for x in parts)


def _rare_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for x in table.column("keys"):
        blob = _plain(x.as_py())
        runs, n = np.frombuffer(blob, np.int64, 2).tolist()
        by, counts = np.frombuffer(blob, np.uint64, runs, 16), np.frombuffer(blob, np.uint32, runs, 16 + 8 * runs)
        other = np.frombuffer(blob, np.uint16, n, 16 + 12 * runs).astype(np.uint64)
        long = other == 0
        other[long] = np.frombuffer(blob, np.uint64, int(long.sum()), 16 + 12 * runs + 2 * n) if long.any() else 0
        out.append((np.repeat(by, counts), other))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pair_counts(known: np.ndarray, bits: int, target: bool):
    """Pairs and single words of the texts, added up by task; those with rare words in buckets from 2 ** bits on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_rare: list[tuple[np.ndarray, ...]] = []
        n = n_rare = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _added(*(np.concatenate(x) for x in zip(*held)))
            # a count beyond 32 bits can't come from a task's share
            parts = _by_bucket(_bucket_of(keys, bits), keys.astype(np.uint32), counts.astype(np.uint32))
            return _packed([[b, target, *(x.tobytes() for x in own)] for b, own in parts], _COUNTS)

        def flush_rare() -> pa.RecordBatch:
            by, other, counts = (np.concatenate(x) for x in zip(*held_rare))
            _, first, at = np.unique(_rare_key(by, other), return_index=True, return_inverse=True)
            counts = np.bincount(at, counts, len(first)).astype(np.uint32)
            order = np.lexsort((other[first], by[first]))
            by, other, counts = by[first][order], other[first][order], counts[order]
            parts = _by_bucket(_bucket_of(by, bits) + (1 << bits), by, other, counts)
            return _packed([[b, target, _rare_blob(*own[:2]), own[2].tobytes()] for b, own in parts], _COUNTS)

        for _, data, offsets in slices(batches):
            tokens = _Tokens(known, data, offsets)
            texts = np.full(len(tokens.lasts), _START, np.uint64)
            keys = np.concatenate([tokens.numbered_pairs(), _UNIGRAM << _SHIFT | tokens.ids[tokens.ids != _UNKNOWN], _UNIGRAM << _SHIFT | texts])
            held.append(_added(keys, np.ones(len(keys))))
            n += len(held[-1][0])
            if n >= HELD:
                yield flush()
                held, n = [], 0
            by, other = tokens.rare_pairs()
            _, first, counts = np.unique(_rare_key(by, other), return_index=True, return_counts=True)
            held_rare.append((by[first], other[first], counts))
            n_rare += len(first)
            if n_rare >= HELD >> 1:  # an entry takes two words
                yield flush_rare()
                held_rare, n_rare = [], 0
        if n:
            yield flush()
        if n_rare:
            yield flush_rare()

    return run


_MODEL_FIELDS = (
    "bucket int, keys binary, background binary, target binary, top binary, top_background binary, top_target binary, "
    "words binary, words_background binary, words_target binary, distinct binary"
)


def _model_row(bucket: int, columns: list) -> pa.Table:
    row = [bucket, *(_dense(c if isinstance(c, bytes) else c.tobytes()) for c in columns)]
    return pa.table({f.split()[0]: pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, (f, v) in enumerate(zip(_MODEL_FIELDS.split(", "), row, strict=True))})


def _second_counts(by: np.ndarray, other: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rare words, where each entry's hash is among them, and how often they occur: always as the second of a pair."""
    words, at = np.unique(by, return_inverse=True)
    second = (other < _SECOND) | (other >= _NUMBERS)
    return words, at, [np.bincount(at, n * second, len(words)) for n in counts]


def _count_rare(table: pa.Table) -> pa.Table:
    """Counts of the pairs with rare words; of those words, their number and the sums of their counts."""
    (by, other), counts = _rare_entries(table), _read(table, "counts", np.uint32)
    target = np.repeat(np.array(table.column("target").to_pylist(), bool), [_plain_size(x) // 4 for x in table.column("counts")])
    _, first, at = np.unique(_rare_key(by, other), return_index=True, return_inverse=True)
    counts = [np.bincount(at, counts * side, len(first)).astype(np.int64) for side in (~target, target)]
    order = np.lexsort((other[first], by[first]))
    by, other, counts = by[first][order], other[first][order], [n[order] for n in counts]
    words, _, singles = _second_counts(by, other, counts)
    none, all_rare = np.zeros(0, np.int64), (_UNIGRAM << _SHIFT | np.uint64(_UNKNOWN)).astype(np.uint32)
    sums = [n.sum(keepdims=True).astype(np.int64) for n in singles]
    return _model_row(table.column("bucket")[0].as_py(), [_rare_blob(by, other), *counts, none, none, none, all_rare, *sums, np.array([len(words)])])


def _count(keep: int, bits: int):
    """A bucket's counts, and apart from them its most frequent pairs and its single words."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= 1 << bits:
            return _count_rare(table)
        sides = [table.filter(pa.array([t == side for t in table.column("target").to_pylist()], pa.bool_())) for side in (False, True)]
        counts = [_read(t, "counts", np.uint32) for t in sides]
        none = [np.zeros(len(c)) for c in counts]
        keys = np.concatenate([_read(t, "keys", np.uint32) for t in sides]).astype(np.uint64)
        keys, background, target = _added(keys, np.concatenate([counts[0], none[1]]), np.concatenate([none[0], counts[1]]))
        single = keys >> _SHIFT == _UNIGRAM
        pairs = ~single
        top = np.zeros(len(keys), bool)
        top[np.flatnonzero(pairs)[np.lexsort((keys[pairs], -background[pairs]))[:keep]]] = True
        parts = [[keys[x].astype(np.uint32), background[x], target[x]] for x in (pairs & ~top, top, single)]
        none = np.zeros(0, np.int64)
        return _model_row(table.column("bucket")[0].as_py(), [*parts[0], *parts[1], *parts[2], none])

    return run


class Model:
    """Counts of words, and of the pairs every task knows."""

    def __init__(self, rows: list, smoothing: float):
        get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(_plain(bytes(r[name])), kind) for r in rows)])
        self.smoothing = smoothing
        word = (get("words", np.uint32) & np.uint32(VOCABULARY - 1)).astype(np.int64)
        self.context, self.share = [], []
        for side in ("background", "target"):
            n = np.zeros(VOCABULARY)
            np.add.at(n, word, get(f"words_{side}", np.int64))
            self.context.append(n)
        tokens = [n.sum() - n[_START] for n in self.context]
        # matched: the background counts as if its corpus had the target's size
        self.scale = [tokens[1] / tokens[0] if tokens[1] else 1.0, 1.0]
        self.total = []
        entries = max(VOCABULARY, 2 + len(np.setdiff1d(word, [_UNKNOWN, _START])) + int(get("distinct", np.int64).sum()))
        for side in (0, 1):
            self.context[side] = n = self.context[side] * self.scale[side]
            own = n.copy()
            own[_START] = 0
            self.total.append(own.sum() + entries)
            self.share.append((own + 1) / self.total[side])
        keys = get("top", np.uint32).astype(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = [get(f"top_{side}", np.int64)[order] for side in ("background", "target")]

    def losses(self, pairs: np.ndarray, background: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Negative log probability of each pair under the background and under the target."""
        before, word = (pairs >> _SHIFT).astype(np.int64), (pairs & np.uint64(VOCABULARY - 1)).astype(np.int64)
        m = self.smoothing
        sides = zip((background, target), self.scale, self.context, self.share)
        return [-np.log((n * scale + m * share[word]) / (context[before] + m)) for n, scale, context, share in sides]

    def first_costs(self, ids: np.ndarray) -> list[np.ndarray]:
        """The part of a pair's losses that its first word alone decides, for numbered ones."""
        return [np.log(context + self.smoothing)[ids.astype(np.int64)] for context in self.context]

    def rare_losses(self, by: np.ndarray, other: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of a bucket's pairs and of its rare words, and their losses less the first word's part.

        A rare second word adds its part as the first of the next pair; a word by itself gives it back.
        """
        m, out = self.smoothing, []
        words, at, singles = _second_counts(by, other, counts)
        second = (other < _SECOND) | (other >= _NUMBERS)
        number = np.where(second, np.uint64(0), other & (_SECOND - np.uint64(1))).astype(np.int64)
        for n, single, scale, total, share in zip(counts, singles, self.scale, self.total, self.share):
            onward = np.log(single * scale + m)
            word = np.where(second, (single[at] * scale + 1) / total, share[number])
            out.append(np.concatenate([np.where(second, onward[at], 0.0) - np.log(n * scale + m * word), -onward]))
        keys = np.concatenate([_rare_key(by, other), _rare_key(words, np.full(len(words), _SECOND))])
        order = np.argsort(keys)
        return keys[order], [x[order] for x in out]


_ASKED = pa.schema([
    ("bucket", pa.int32()), ("first", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()),
    ("ids", pa.binary()), ("null_ids", pa.binary()), ("tokens", pa.binary()), ("background", pa.binary()), ("target", pa.binary()),
])
_ASKED_FIELDS = "bucket int, first bigint, keys binary, places binary, counts binary, docs binary, ids binary, null_ids binary, tokens binary, background binary, target binary"
_SUMS = pa.schema(list(_ASKED)[:1] + [f for f in _ASKED if f.name not in ("bucket", "first", "keys", "places", "counts")])
_SUM_FIELDS = "bucket int, docs binary, ids binary, null_ids binary, tokens binary, background binary, target binary"


def _ask(model: Model, known: np.ndarray, bits: int):
    """What a text's known pairs come to, in rows of bucket -1; its other pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, ...]] = []
        held_rare: list[tuple[np.ndarray, ...]] = []
        n = done = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for part, start in ((held, 0), (held_rare, 1 << bits)):
                by, other, docs, counts = (np.concatenate(x) for x in zip(*part))
                base = int(docs.min()) if len(docs) else 0
                if start:
                    order = np.lexsort((docs, other, by))
                    by, other, docs, counts = by[order], other[order], docs[order], counts[order]
                parts = _by_bucket(_bucket_of(by, bits) + start, by, other, (docs - base).astype(np.uint32), counts.astype(np.uint32))
                rows += [[b, base, _rare_blob(*own[:2]) if start else own[0].astype(np.uint32).tobytes(), own[2].tobytes(), own[3].tobytes(), *[b""] * 6] for b, own in parts]
            return _packed(rows, _ASKED)

        for rows, data, offsets in slices(batches):
            tokens = _Tokens(known, data, offsets)
            bounds, every = tokens.bounds, owners(tokens.bounds)
            pairs, of = tokens.numbered_pairs(), every[~tokens.rare]
            # a pair that a text repeats is looked up once: text and pair fit 64 bits
            both, counts = np.unique(of.astype(np.uint64) << np.uint64(31) | pairs, return_counts=True)
            pairs, of = both & np.uint64((1 << 31) - 1), (both >> np.uint64(31)).astype(np.int64)
            at = np.minimum(np.searchsorted(model.keys, pairs), max(0, len(model.keys) - 1))
            hit = model.keys[at] == pairs if len(model.keys) else np.zeros(len(pairs), bool)
            background, target = model.losses(pairs[hit], *(c[at[hit]] for c in model.counts))
            docs = first + done + np.arange(rows.num_rows)
            done += rows.num_rows
            ids = column(rows, "key")
            sums = [np.bincount(of[hit], x * counts[hit], rows.num_rows) for x in (background, target)]
            after = tokens.rare & (tokens.before != _UNKNOWN)  # a numbered word's part is known here
            sums = [x + np.bincount(every[after], cost, rows.num_rows) for x, cost in zip(sums, model.first_costs(tokens.before[after]))]
            own = (docs, np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.uint8), np.diff(bounds).astype(np.int64), *sums)
            yield _packed([[-1, 0, b"", b"", b"", *(x.tobytes() for x in own)]], _ASKED)
            held.append((pairs[~hit], pairs[~hit], docs[of[~hit]], counts[~hit].astype(np.int64)))
            ends = tokens.lasts[tokens.ids[tokens.lasts] == _UNKNOWN]
            by, other = (np.concatenate(x) for x in zip(tokens.rare_pairs(), (tokens.symbols[ends], np.full(len(ends), _SECOND))))
            of = np.concatenate([every[tokens.rare], every[ends]])
            keys = _rare_key(by, other)
            order = np.lexsort((keys, of))
            keys, by, other, of = keys[order], by[order], other[order], of[order]
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else np.zeros(0, np.int64)
            held_rare.append((by[new], other[new], docs[of[new]], np.diff(np.append(new, len(keys)))))
            n += len(held[-1][0]) + len(new)
            if n >= HELD_ASKED:
                yield flush()
                held, held_rare, n = [], [], 0
        if n:
            yield flush()

    return run


def _answer(model: Model, bits: int):
    """Losses of the dealt pairs, added up by text and packed by the text's own bucket."""

    def run(asked: pa.Table, counted: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([_packed([], _SUMS)], _SUMS)
        rare = asked.column("bucket")[0].as_py() >= 1 << bits
        keys = _rare_key(*_rare_entries(asked)) if rare else _read(asked, "keys", np.uint32).astype(np.uint64)
        counts = _read(asked, "counts", np.uint32)
        places = _read(asked, "places", np.uint32).astype(np.int64)
        docs = places + np.repeat(np.asarray(asked.column("first"), np.int64), [_plain_size(x) // 4 for x in asked.column("places")])
        own = [_read(counted, side, np.int64) for side in ("background", "target")]
        if rare:
            known, losses = model.rare_losses(*_rare_entries(counted), own)
        else:
            known = _read(counted, "keys", np.uint32).astype(np.uint64)
        at = np.searchsorted(known, keys)  # every pair asked for has been counted
        losses = [x[at] for x in losses] if rare else model.losses(keys, *(n[at] for n in own))
        found, of = np.unique(docs, return_inverse=True)
        sums = [np.bincount(of, x * counts, len(found)).astype(np.float32) for x in losses]
        rows = [[b, own[0].tobytes(), b"", b"", b"", own[1].tobytes(), own[2].tobytes()] for b, own in _by_bucket(_bucket_of(found.view(np.uint64), bits), found, *sums)]
        return pa.Table.from_batches([_packed(rows, _SUMS)], _SUMS)

    return run


def _own_buckets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.uint8, np.int64, np.float64, np.float64)
        for batch in batches:
            own = [_read(pa.Table.from_batches([batch]), f.name, k) for f, k in zip(list(_SUMS)[1:], kinds)]
            yield _packed([[b, *(x.tobytes() for x in part)] for b, part in _by_bucket(_bucket_of(own[0].view(np.uint64), bits), *own)], _SUMS)

    return run


def _total(table: pa.Table) -> pa.Table:
    """All sums of a bucket's texts, in one order whatever came first."""
    described = [len(x.as_buffer()) > 0 for x in table.column("ids")]
    own, rest = table.filter(pa.array(described)), table.filter(pa.array([not d for d in described]))
    docs = _read(own, "docs", np.int64)
    order = np.argsort(docs)
    ids, nulls, tokens = (_read(own, c, k)[order] for c, k in (("ids", np.int64), ("null_ids", np.uint8), ("tokens", np.int64)))
    more = _read(rest, "docs", np.int64)
    at = np.searchsorted(docs[order], more)
    out = {"id": pa.array(ids, mask=nulls.astype(bool)), "n_tokens": pa.array(tokens)}
    for side in ("target", "background"):
        values = _read(rest, side, np.float32).astype(np.float64)
        sums = _read(own, side, np.float64)[order] + np.bincount(at[(by := np.lexsort((values, at)))], values[by], len(docs))
        out[f"{side}_loss"] = pa.array(sums / np.maximum(1, tokens))
    return pa.table(out)


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING, buckets: int | None = None) -> DataFrame:
    """One row per document: key (an integer), n_tokens, losses per token under both models, and ``score``, target loss less background loss.

    ``target`` holds the texts of the target corpus.  A negative score says that a text is
    rather like the target.
    """
    wanted = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (wanted - 1).bit_length())
    texts = lambda rows: rows.select(F.col(text).cast("string").alias("text"))
    known = vocabulary(docs, text, bits, NUMBERED)
    partial = texts(docs).mapInArrow(_pair_counts(known, bits, False), _COUNT_FIELDS).unionAll(texts(target).mapInArrow(_pair_counts(known, bits, True), _COUNT_FIELDS))
    counted = cut_lineage(partial.groupBy("bucket").applyInArrow(_count(max(1, KNOWN_PAIRS >> bits), bits), _MODEL_FIELDS))
    columns = [f.split()[0] for f in _MODEL_FIELDS.split(", ")]
    small = columns[4:]
    model = Model(counted.select(*small).collect(), smoothing)  # bounded: KNOWN_PAIRS and VOCABULARY entries
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    asked = cut_lineage(rows.mapInArrow(_ask(model, known, bits), _ASKED_FIELDS))
    names = [f.name for f in _SUMS]
    told = asked.where("bucket = -1").select(*names).mapInArrow(_own_buckets(bits), _SUM_FIELDS)
    counted = counted.select(*columns[:4])
    answered = asked.where("bucket >= 0").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_answer(model, bits), _SUM_FIELDS)
    out = told.unionAll(answered).groupBy("bucket").applyInArrow(_total, "id bigint, n_tokens bigint, target_loss double, background_loss double")
    return out.select(F.col("id").alias(key), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
