"""Phrases whose words stand together more often than their parts do, from sorted streams of counts.

Texts are cut into pieces and those into words; phrases of 2 to 4 words that occur at least ``LEAST``
times in a language are candidates.  A phrase's words and parts then occur as often, so words, pairs and triples that
do not are left out before longer phrases are counted: three scans mark the frequent ones in bitmaps of a fixed
size (a bit that two share only lets more through), and a scan for each length counts exactly what the maps let through.
Every task counts its own share first, so a frequent phrase is one row a share, in the one scan of its length.  It travels
as the hash of what stands before its last word, and that word; which words these are is known from the frequent phrases
of one word less, in a join of the few that remain.  Words alone travel spelled.

The counts are one stream, laid out twice.  In prefix order (by words, a phrase behind its own
beginnings) one pass knows at each phrase the counts of its beginnings; in suffix order (by words from the last) the
same pass knows its endings.  The stream is cut into blocks; what a block needs of earlier ones are the
beginnings of its first phrase, at most three counts.  Nothing is looked up by hash.  The
same passes see each phrase next to its extensions by one word and mark those that one covers.  Longer
extensions occur no more often than those by one word, so these decide.

Scores are whole numbers in decimals of 38 digits.  Words and beginnings of phrases are 64-bit hashes
until the last step: two of N collide with odds of N²/2⁶⁵.

Defined cases: a null text is empty, a null language ``und``; texts without words count nothing; a piece shorter than a phrase
does not hold it; repeated rows count each; ties by count, then by the phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlake.llm.textbatch import LOWER, byte_prefix, mix, owners, runs, slices, span_hash
from rentlake.session import cut_lineage

#: Least count of a phrase, most words of it, and phrases reported of a language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: An extension covers a phrase from this share (hundredths) of its count.
COVERS = 80
#: Words a task holds before it counts them.
HELD = 1 << 21
#: Bits of the maps of frequent words, pairs and triples.
BITS = 1 << 26
#: Parts of a language whose best phrases are found first.
PARTS = 64
#: Phrases of a block of the sorted streams.
BLOCK = 1 << 16
#: Stands for a word that a shorter phrase does not have, and comes before all.
ABSENT = -(1 << 63)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True

#: Words of a phrase, and the same in the order of a stream.
WORDS = [f"w{i + 1}" for i in range(LONGEST)]
PLACES = [f"s{i + 1}" for i in range(LONGEST)]


class _Share:
    """The words a task holds: hashes, whether the next one follows in the same piece and, if ``spelled``, languages and bytes."""

    def __init__(self, spelled: bool = False) -> None:
        self.spelled, self.words, self.texts = spelled, [], []
        self.n = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends = runs(~_GAP[low], offsets)
        if not len(starts):
            return
        row = owners(np.searchsorted(starts, offsets))
        lang = rows.column(1).to_numpy()
        hashes = mix(span_hash(byte_prefix(low), starts, ends) ^ mix(lang[row].view(np.uint64)))
        piece = np.cumsum(_BREAK[low])[starts]
        follows = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
        self.words.append((hashes, follows))
        if self.spelled:
            self.texts.append((lang, row.astype(np.int32), low, starts, (ends - starts).astype(np.int32)))
        self.n += len(starts)

    def whole(self, i: int) -> np.ndarray:
        return np.concatenate([p[i] for p in self.words])

    def languages(self) -> tuple[np.ndarray, np.ndarray]:
        """Languages, and how many words each has."""
        total: dict[int, int] = {}
        for lang, row, *_ in self.texts:
            for k, n in zip(lang.tolist(), np.bincount(row, minlength=len(lang)).tolist()):
                if n:
                    total[k] = total.get(k, 0) + n
        return np.array(list(total), np.int64), np.array(list(total.values()), np.int64)

    def at(self, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Languages of words, and their spelling."""
        order = np.argsort(places)
        bounds = np.cumsum([0] + [len(t[1]) for t in self.texts])
        cuts = np.searchsorted(places[order], bounds)
        langs, names = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
        for (lang, row, low, starts, size), begin, a, b in zip(self.texts, bounds, cuts, cuts[1:]):
            own = places[order[a:b]] - begin
            langs.append(lang[row[own]])
            names.append(_spelled(low, starts[own], size[own].astype(np.int64)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return np.concatenate(langs)[back], pa.concat_arrays(names).take(pa.array(back))


def _spelled(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(size))
    at = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _shares(batches: Iterator[pa.RecordBatch], count: Callable[[_Share], pa.RecordBatch], spelled: bool = False) -> Iterator[pa.RecordBatch]:
    share = _Share(spelled)
    for rows, data, offsets in slices(batches):
        share.add(rows, data, offsets)
        if share.n >= HELD:
            yield count(share)
            share = _Share(spelled)
    if share.n:
        yield count(share)


def _longer(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of phrases, from the hash of all words but the last (of two words: the first) and the last word's."""
    return mix(mix(head) + last)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _begins(hashes: np.ndarray, follows: np.ndarray, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places where phrases of one word more than there are maps (of words, pairs, ...) begin whose longest parts are
    all marked, and the hashes of what stands before their last word."""
    heads, here = hashes, _marked(maps[0], hashes)
    for n in range(2, len(maps) + 2):
        here = here[:-1] & here[1:]
        if n == 2:
            here &= follows[:-1]
        if n <= len(maps):
            heads = _longer(heads[:-1], hashes[n - 1 :])
            here &= _marked(maps[n - 1], heads)
    places = np.flatnonzero(here)
    return places, heads[places]


_WORD = pa.schema([("hash", pa.int64()), ("lang", pa.int64()), ("name", pa.string()), ("n", pa.int64())])


def _count_words(share: _Share) -> pa.RecordBatch:
    """Words with language and spelling; without a spelling, how many words a language has."""
    hashes = share.whole(0)
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    lang, names = share.at(first)
    langs, total = share.languages()
    none = np.zeros(len(langs), np.int64)
    own = [np.append(hashes[first].view(np.int64), none), np.append(lang, langs)]
    return pa.RecordBatch.from_arrays([*map(pa.array, own), pa.concat_arrays([names, pa.nulls(len(langs), pa.string())]), pa.array(np.append(counts, total))], schema=_WORD)


_GRAM = pa.schema([("head", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])


def _count_next(maps):
    """Phrases of one word more than the maps know, all of whose parts are marked: the hash of what stands before the last word, and that word's.

    In the order of the first, so that rows travel next to others that begin alike."""

    def count(share: _Share) -> pa.RecordBatch:
        hashes = share.whole(0)
        places, head = _begins(hashes, share.whole(1), [m.value for m in maps])
        last = hashes[places + len(maps)]
        order = np.lexsort((last, head))
        head, last = head[order], last[order]
        first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (last[1:] != last[:-1]))[: len(head)])
        counts = np.diff(np.append(first, len(head)))
        return pa.RecordBatch.from_arrays([pa.array(head[first].view(np.int64)), pa.array(last[first].view(np.int64)), pa.array(counts)], schema=_GRAM)

    return lambda batches: _shares(batches, count)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        head, last = (rows.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(_longer(head, last).view(np.int64))], [*_GRAM.names, "hash"])


def _bitmap(often: DataFrame):
    """Bits of hashes, sent to all tasks; BITS / 8 bytes at any size."""
    place = F.col("hash").bitwiseAND(F.lit(BITS - 1)) + 1
    parts = often.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        own = np.frombuffer(r["bits"], np.uint8)
        begin = (r["at"] - 1) * len(own)
        bits[begin : begin + len(own)] = own[: len(bits) - begin]
    return often.sparkSession.sparkContext.broadcast(bits)


def frequent(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1..w4, words, name, n): every phrase of two to four words with at least so many places, the words of
    these with their spelling and all their places; a row without words is the number of all words of a language."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), _language(lang))
    counted = rows.mapInArrow(lambda batches: _shares(batches, _count_words, spelled=True), "hash bigint, lang bigint, name string, n bigint")
    words = cut_lineage(counted.groupBy("hash", "lang", "name").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("name").isNull()))
    longer: list[DataFrame] = []
    maps = [_bitmap(words.where("name is not null"))]
    for _ in range(1, LONGEST):
        counted = rows.mapInArrow(_count_next(list(maps)), "head bigint, last bigint, n bigint")
        often = counted.groupBy("head", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        longer.append(cut_lineage(often.mapInArrow(_hashed, "head bigint, last bigint, n bigint, hash bigint")))
        if len(maps) < LONGEST - 1:
            maps.append(_bitmap(longer[-1]))
    return cut_lineage(_spelled_out(words, longer))


def _spelled_out(words: DataFrame, longer: list[DataFrame]) -> DataFrame:
    """The words of phrases, from those of the phrases they begin with."""
    # a word that stands in no pair is in no phrase
    used = longer[0].select(F.explode(F.array("head", "last")).alias("hash")).distinct()
    known = words.where("name is not null").join(used, "hash", "left_semi")
    begins = known.select(F.col("hash").alias("head"), "lang", F.col("hash").alias("w1"))
    grams = [words.where("name is null").select("lang", F.lit(0).alias("words"), "name", "n"), known.select("lang", F.col("hash").alias("w1"), F.lit(1).alias("words"), "name", "n")]
    for k, own in enumerate(longer, 2):
        whole = own.join(begins, "head").withColumnRenamed("last", f"w{k}")
        grams.append(whole.select("lang", *WORDS[:k], F.lit(k).alias("words"), F.lit(None).cast("string").alias("name"), "n"))
        begins = whole.select(F.col("hash").alias("head"), "lang", *WORDS[:k])
    rows = [g.select("lang", *[F.col(w) if w in g.columns else F.lit(ABSENT).alias(w) for w in WORDS], "words", "name", "n") for g in grams]
    return reduce(DataFrame.unionByName, rows)


def _language(lang: str):
    return F.xxhash64(_spelled_language(lang)).alias("lang")


def _spelled_language(lang: str):
    return F.coalesce(F.col(lang).cast("string"), F.lit("und"))


def _block_type(columns: list[str]) -> tuple[pa.Schema, str]:
    whole = ["part", "number", *columns[:6]]
    schema = pa.schema([*((c, pa.int64()) for c in whole), *((f"x_{c}", pa.binary()) for c in columns)])
    return schema, ", ".join(f"{f.name} {'binary' if f.name[:2] == 'x_' else 'bigint'}" for f in schema)


def _blocks(columns: list[str]):
    """A sorted partition as blocks: the first phrase, and all columns as bytes."""
    schema, _ = _block_type(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = 0, [], 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            own = {c: rows.column(c).to_numpy() for c in columns}
            values = {"part": rows.column("part")[0].as_py(), "number": number, **{c: int(own[c][0]) for c in columns[:6]}}
            number += 1
            return pa.RecordBatch.from_pylist([values | {f"x_{c}": v.tobytes() for c, v in own.items()}], schema)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield made(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield made(pa.Table.from_batches(held))

    return run


def covering(base: np.ndarray) -> np.ndarray:
    """Least count that covers a phrase of this count, without products that pass 64 bits."""
    return COVERS * (base // 100) - (-COVERS * (base % 100)) // 100


def _pass(columns: list[str], adds: list[str]):
    """At each phrase the counts of its beginnings, and as rows of their own the beginnings that it covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = {c: np.frombuffer(r[f"x_{c}"], np.int64) for c in columns}
                size, n = own["words"], own["n"]
                at = np.arange(len(n))
                begins = []
                for k in range(1, LONGEST):
                    # the last phrase of k words before a longer one is its beginning
                    last = np.maximum.accumulate(np.where(size == k, at, -1))
                    begins.append(np.where(size > k, np.where(last >= 0, n[np.maximum(last, 0)], r[f"c{k}"] or 0), 0))
                names = [*columns, *adds, "covered"]
                yield pa.RecordBatch.from_arrays([*(pa.array(own[c]) for c in columns), *map(pa.array, begins), pa.array(np.zeros(len(n), bool))], names)
                shorter = np.choose(np.clip(size - 2, 0, LONGEST - 2), begins)
                covers = np.flatnonzero((size > 2) & (n >= covering(shorter)))
                keys = {c: own[c][covers].copy() for c in columns}
                for i, c in enumerate(PLACES):
                    keys[c][size[covers] == i + 1] = ABSENT
                keys["words"] -= 1
                none = [pa.array(np.zeros(len(covers), np.int64))] * len(adds)
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[c]) for c in columns), *none, pa.array(np.ones(len(covers), bool))], names)

    return run


def lockstep(stream: DataFrame, columns: list[str], adds: list[str]) -> DataFrame:
    """The stream (lang, s1..s4, words, n and other numbers) with the counts of each phrase's beginnings of 1 to 3 words, and rows marked ``covered``."""
    order = ["lang", *PLACES]
    parts = stream.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    blocks = cut_lineage(parts.mapInArrow(_blocks(columns), _block_type(columns)[1]))
    # the beginnings of a block's first phrase may lie in earlier blocks
    heads = blocks.select("part", "number", *order, F.explode(F.sequence(F.lit(1), F.lit(LONGEST - 1))).alias("k"), "words").where("k < words")
    heads = heads.select("part", "number", "k", "lang", *[F.when(F.col("k") > i, F.col(c)).otherwise(F.lit(ABSENT)).alias(c) for i, c in enumerate(PLACES)])
    carried = heads.join(stream.select(*order, "n"), order).groupBy("part", "number").agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"c{k}") for k in range(1, LONGEST)])
    kinds = ", ".join(f"{c} bigint" for c in [*columns, *adds]) + ", covered boolean"
    return cut_lineage(blocks.drop(*order, "words").join(carried, ["part", "number"], "left").mapInArrow(_pass(columns, adds), kinds))


def _turned(begin: list[str], names: list[str]):
    """The words the other way round."""
    own = F.reverse(F.slice(F.array(*begin), 1, F.col("words").cast("int")))
    return [F.coalesce(F.get(own, F.lit(i)), F.lit(ABSENT)).alias(c) for i, c in enumerate(names)]


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Of each language the first ``top`` phrases: lang, ``rank``, ``phrase``, ``a`` (places), ``l`` and ``r`` (places of the parts at its weakest cut), ``n`` (words of the language) and ``score``."""
    counted = frequent(docs, least, text, lang)
    column = F.col
    own = ["lang", *PLACES, "words", "n"]
    begins, ends = [f"b{k}" for k in range(1, LONGEST)], [f"e{k}" for k in range(1, LONGEST)]
    stream = counted.where("words > 0").select("lang", *[column(w).alias(s) for w, s in zip(WORDS, PLACES)], column("words").cast("long").alias("words"), "n")
    forward = lockstep(stream, own, begins)
    turned = forward.where("not covered").select("lang", *_turned(PLACES, PLACES), "words", "n", *begins)
    backward = lockstep(turned, [*own, *begins], ends)

    key = ["lang", *WORDS]
    covered = forward.where("covered").select("lang", *[column(s).alias(w) for w, s in zip(WORDS, PLACES)])
    covered = covered.unionAll(backward.where("covered").select("lang", *_turned(PLACES, WORDS)))
    phrases = backward.where("not covered and words > 1").select("lang", *_turned(PLACES, WORDS), "words", column("n").alias("a"), *begins, *ends)
    phrases = phrases.join(covered.distinct(), key, "left_anti")
    cuts = []
    for k in range(1, LONGEST):
        left, right = begins[k - 1], F.get(F.array(*ends), column("words").cast("int") - k - 1)
        phrases = phrases.withColumn(f"r{k}", right)
        score = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast({left} as decimal(19,0)) + cast(r{k} as decimal(19,0)))")
        cuts.append(F.when(column("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), column(left).alias("l"), column(f"r{k}").alias("r"))))
    phrases = phrases.withColumn("cut", F.array_min(F.array(*cuts))).select(*key, "words", "a", "cut.l", "cut.r", "cut.score")

    # words are spelled for those that can be reported: all that tie with the last place
    reported = phrases.withColumn("part", F.pmod(F.xxhash64(*WORDS), F.lit(PARTS)))
    for of in (["lang", "part"], ["lang"]):
        by_number = Window.partitionBy(*of).orderBy(F.desc("score"), F.desc("a"))
        reported = reported.withColumn("place", F.rank().over(by_number)).where(column("place") <= top)
    reported = cut_lineage(reported.drop("place", "part"))
    places = reported.select(*key, F.posexplode(F.slice(F.array(*WORDS), 1, column("words").cast("int"))).alias("at", "hash"))
    spelling = counted.where("words = 1").select(column("w1").alias("hash"), "name")
    spelled = places.join(spelling, "hash").groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    names = docs.select(_spelled_language(lang).alias("spelled_lang"), _language(lang)).distinct()
    total = counted.where("words = 0").select("lang", "n").join(names, "lang")
    named = reported.join(spelled, key).join(total, "lang").select(column("spelled_lang").alias("lang"), "phrase", "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return named.withColumn("rank", rank).where(column("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
