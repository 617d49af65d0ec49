"""Cheapest repair of conversation structure, by a dynamic program over a shared grammar.

A conversation is a sequence of rows.  A row's first fault counts: blank (no character but ASCII white
space), duplicate (role and text seen earlier), truncated (the last such character is none of
``.!?``).  Edits: Keep, Rerole to user or assistant (3), Delete (4; a must for blank and duplicate
rows), Insert an empty user or assistant row anywhere (3); a truncated row that stays adds 3.  The
roles that remain begin with ``(s?(ua)+)?``.  Among the cheapest edits the one whose
initials are least in ASCII is taken.

Roles and faults make one symbol a row.  Conversations become chunks of symbols; rounds of Re-Pair count
neighbouring symbols over all distinct chunks and replace the most frequent pairs by a new symbol.  A
symbol has one min-plus matrix over the grammar's four states; an entry is a cost and the audit as a rope
of two parts, so a rule's matrix is the product of its parts' and is made once, from the bottom up, for all
conversations.  A conversation then takes one vector-matrix product for each symbol left in its chunks.
Equal costs are compared by audit: audits of the same rows and cost are never one the beginning of the
other, since their lengths differ by inserts alone, so the least survives any continuation.

No conversation is gathered: rows are sorted by range, however long it is, and only symbols (a byte a row)
of one conversation meet in order.  Its repaired rows pass one task in order, as a hash of the whole demands, but
are never held.

Defined cases: a null role or text is one space, and such a text is blank; null turns come first; rows of one turn are
ordered by role, then by a hash of the text, so equal rows stand together; a null id is a conversation of
its own; roles other than s, u and a in their first letter can't be kept.  Texts of any length are
taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.session import cut_lineage

#: Symbols of a chunk.
CHUNK = 4096
#: Rules of the grammar, rounds that make them, and pairs looked at in a round.
RULES, ROUNDS, PAIRS = 1024, 16, 512
#: A pair becomes a rule from this many places.
FREQUENT = 4

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What another state can cost at most from here; costlier states can't be part of the best.
CATCH_UP = 10

#: Nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Symbols: first letter of the role (s, u, a, other), the same truncated, and rows that must go.
LETTERS = "sua"
GONE = 8

Rope = str | tuple
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += top[::-1]


def _letters(rope: Rope) -> Iterator[str]:
    for leaf in leaves(rope):
        yield from leaf


def less(a: Entry, b: Entry) -> bool:
    """Whether a is cheaper, or as cheap and before b in ASCII."""
    if a[0] != b[0]:
        return a[0] < b[0]
    for x, y in zip(_letters(a[1]), _letters(b[1])):
        if x != y:
            return x < y
    return False


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                x, y = a[i][k], b[k][j]
                if x is not None and y is not None:
                    entry = (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1])
                    if out[i][j] is None or less(entry, out[i][j]):
                        out[i][j] = entry
    return out


def _after(state: int, letter: str) -> int | None:
    """The state after a row whose role begins with the letter, None where it may not stand."""
    if letter == "s":
        return SYSTEM if state == START else None
    if letter == "u":
        return USER if state != USER else None
    return ASSISTANT if state == USER and letter == "a" else None


def _wanted(state: int) -> str:
    return "a" if state == USER else "u"


def inserts() -> Matrix:
    """Rows put in before a row or at the end: at most two, more only go round in circles."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        one = _after(i, _wanted(i))
        two = _after(one, _wanted(one))
        for j, n in ((one, 1), (two, 2)):
            if out[i][j] is None:
                out[i][j] = (INSERT * n, "I" * n)
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """Inserts, then one row."""
    own: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        own[i][i] = (DELETE, "D")
        if symbol != GONE:
            extra = TRUNCATED if symbol >= 4 else 0
            keep = _after(i, LETTERS[symbol % 4]) if symbol % 4 < 3 else None
            moves = [(keep, (extra, "K")), (_after(i, _wanted(i)), (REROLE + extra, "R"))]
            for j, entry in moves:
                if j is not None and (own[i][j] is None or less(entry, own[i][j])):
                    own[i][j] = entry
    return product(inserts(), own)


def choose(counted: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The most frequent pairs no two of which can overlap: a symbol begins pairs or ends them."""
    firsts, seconds, taken = set(), set(), []
    for a, b, _ in counted:
        if a == b:
            if a in firsts or a in seconds:
                continue
        elif a in seconds or b in firsts or (a, a) in taken or (b, b) in taken:
            continue
        firsts.add(a)
        seconds.add(b)
        taken.append((a, b))
    return taken


class Grammar:
    """Rounds of pairs; the pairs of a round become the next symbols in their order."""

    def __init__(self) -> None:
        self.rounds: list[list[tuple[int, int]]] = []
        self.matrices: list[Matrix] = [symbol_matrix(s) for s in range(GONE + 1)]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append(pairs)
        self.matrices += [product(self.matrices[a], self.matrices[b]) for a, b in pairs]

    def compress(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences end to end, and their bounds, with all rules applied."""
        new = GONE + 1
        for pairs in self.rounds:
            left, right = np.array(pairs).T
            code, order = left * len(self.matrices) + right, np.argsort(left * len(self.matrices) + right)
            code = code[order]
            if len(symbols) > 1:
                here = symbols[:-1] * len(self.matrices) + symbols[1:]
                at = np.minimum(np.searchsorted(code, here), len(code) - 1)
                hit = code[at] == here
                ends = bounds[1:-1]
                hit[ends[(ends > 0) & (ends < len(symbols))] - 1] = False  # a pair lies in one sequence
                places = np.flatnonzero(hit)
                # runs of one symbol: every second place
                run = np.append(True, np.diff(places) != 1) if len(places) else np.zeros(0, bool)
                begin = places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))] if len(places) else places
                places = places[(places - begin) % 2 == 0]
                symbols = symbols.copy()
                symbols[places] = new + order[at[places]]
                gone = np.zeros(len(symbols), bool)
                gone[places + 1] = True
                before = np.append(0, np.cumsum(gone))
                symbols, bounds = symbols[~gone], bounds - before[bounds]
            new += len(pairs)
        return symbols, bounds


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [x.as_buffer() for x in column]
    bounds = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int64)
    return np.frombuffer(b"".join(values), np.uint8).astype(np.int64), bounds


def _pairs(grammar: Grammar):
    """How often each two symbols are neighbours, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column("count").to_numpy()
            symbols, bounds = grammar.compress(*_sequences(batch.column("symbols")))
            of = np.repeat(np.arange(len(weight)), np.diff(bounds))
            inside = np.flatnonzero(of[:-1] == of[1:])
            width = len(grammar.matrices)
            pairs, at = np.unique(symbols[inside] * width + symbols[inside + 1], return_inverse=True)
            n = np.bincount(at, weight[of[inside]], len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // width), pa.array(pairs % width), pa.array(n)], ["a", "b", "n"])

    return run


def learn(chunks: DataFrame) -> Grammar:
    """Re-Pair over all distinct chunks: each round is one count by pair; only the most frequent pairs come back."""
    grammar = Grammar()
    sequences = cut_lineage(chunks.groupBy("symbols").count())
    for _ in range(ROUNDS):
        counted = sequences.mapInArrow(_pairs(grammar), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect()
        pairs = choose([tuple(r) for r in top])[: RULES + GONE + 1 - len(grammar.matrices)]
        if not pairs:
            break
        grammar.add(pairs)
    return grammar


_CHUNK = "key string, part int, number bigint, symbols binary, first int, last int, illegal bigint, blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, turns bigint, first_turn bigint, last_turn bigint"


def _chunks():
    """Sorted rows with their numbers of copies, as chunks of one conversation each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def made(rows: pa.RecordBatch, copies: np.ndarray, later: bool) -> pa.RecordBatch:
            """Chunks of rows times copies; ``later`` says that the first row's first copy went before."""
            nonlocal number
            at = np.repeat(np.arange(len(copies)), copies)
            again = np.append(later, at[1:] == at[:-1])
            fault = rows.column("fault").to_numpy()[at]
            letter = rows.column("letter").to_numpy()[at]
            duplicate = (fault == 2) | (again & (fault != 1))
            blank, cut = fault == 1, (fault == 3) & ~again
            symbols = np.where(blank | duplicate, GONE, letter + 4 * cut).astype(np.uint8)
            keys = pc.dictionary_encode(rows.column("key")).indices.to_numpy()[at]
            change = np.append(True, keys[1:] != keys[:-1])
            begin = np.flatnonzero(change)[np.cumsum(change) - 1]
            starts = np.flatnonzero((np.arange(len(at)) - begin) % CHUNK == 0)
            ends = np.append(starts[1:], len(at))
            turn = rows.column("turn")
            known = turn.is_valid().to_numpy(zero_copy_only=False)[at]
            turns = pc.fill_null(turn, 0).to_numpy()[at]
            legal = [(0, 1), (1, 2), (2, 1)]
            pair = np.append(False, ~np.isin(letter[:-1] * 4 + letter[1:], [4 * a + b for a, b in legal]))
            new_turn = known & np.append(True, (turns[1:] != turns[:-1]) | ~known[:-1])
            pair[starts], new_turn[starts] = False, known[starts]
            total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            # turns ascend and nulls come first, so the last one tells whether any is known
            first_known = np.minimum.reduceat(np.where(known, np.arange(len(at)), len(at) - 1), starts)
            has = known[ends - 1]
            optional = lambda values, valid: pa.array(values, pa.int64(), mask=~valid)
            data = symbols.tobytes()
            numbers = np.arange(number, number + len(starts))
            number += len(starts)
            columns = [
                rows.column("key").take(pa.array(at[starts])), rows.column("part").take(pa.array(at[starts])), pa.array(numbers), pa.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                pa.array(letter[starts], pa.int32()), pa.array(letter[ends - 1], pa.int32()), *(pa.array(total(x)) for x in (pair, blank, duplicate, cut)),
                optional(turns[first_known], has), optional(turns[ends - 1], has), pa.array(total(new_turn)), optional(turns[starts], known[starts]), optional(turns[ends - 1], has),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _CHUNK.split(", ")])

        most = 16 * CHUNK
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            at = 0
            while at < len(copies):
                if copies[at] > most:
                    left = int(copies[at])
                    while left:
                        n = min(left, most)
                        yield made(batch.slice(at, 1), np.array([n]), left < copies[at])
                        left -= n
                    at += 1
                    continue
                sums = np.cumsum(copies[at : at + most])
                to = at + max(1, int(np.searchsorted(sums, most, "right")))
                yield made(batch.slice(at, to - at), copies[at:to], False)
                at = to

    return run


_SUMMARY = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class _Path:
    """The best way into each state so far: a cost, and the audit after what all ways share."""

    def __init__(self, grammar: Grammar, text):
        self.grammar, self.text = grammar, text
        self.settled: list[str] = []
        self.ways: list[tuple[int, str] | None] = [(0, ""), None, None, None]

    def step(self, entries, text) -> None:
        new: list[tuple[int, str] | None] = [None] * 4
        for j in range(4):
            for i, way in enumerate(self.ways):
                if way is not None and entries[i][j] is not None:
                    cost = way[0] + entries[i][j][0]
                    if new[j] is None or cost <= new[j][0]:
                        entry = (cost, way[1] + text(i, j))
                        if new[j] is None or entry < new[j]:
                            new[j] = entry
        least = min(w[0] for w in new if w is not None)
        self.ways = [w if w is not None and w[0] <= least + CATCH_UP else None for w in new]
        if max(len(w[1]) for w in self.ways if w is not None) > 2 * CHUNK:
            self.settle()

    def settle(self) -> None:
        tails = [w[1] for w in self.ways if w is not None]
        low, high = min(tails), max(tails)
        n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.settled.append(low[:n])
        self.ways = [w and (w[0], w[1][n:]) for w in self.ways]

    def add(self, symbols: list[int]) -> None:
        for s in symbols:
            self.step(self.grammar.matrices[s], lambda i, j, s=s: self.text(s, i, j))

    def end(self) -> tuple[int, str]:
        last = inserts()
        self.step(last, lambda i, j: last[i][j][1])
        cost, tail = min(w for w in (self.ways[s] for s in ENDS) if w is not None)
        return cost, "".join(self.settled) + tail


def _resolve(grammar: Grammar):
    """Chunks of whole conversations in their order, to one row a conversation."""

    def short(symbols: bytes) -> list[int]:
        return grammar.compress(np.frombuffer(symbols, np.uint8).astype(np.int64), np.array([0, len(symbols)]))[0].tolist()

    def finished(rows: list[dict]) -> tuple:
        """The counts of one conversation so far, as one row."""
        known = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(rows, rows[1:]))
        gaps = max(r["high"] for r in known) - min(r["low"] for r in known) + 1 - turns if known else 0
        between = sum((a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(rows, rows[1:]))
        return min(gaps, (1 << 63) - 1), *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), sum(r["illegal"] for r in rows) + between

    names = [f.split()[0] for f in _CHUNK.split(", ") if f.split()[0] != "symbols"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, facts, only, path = None, [], None, None
        @lru_cache(1 << 14)
        def text(symbol: int, i: int, j: int) -> str:
            return "".join(leaves(grammar.matrices[symbol][i][j][1]))

        @lru_cache(1 << 14)
        def whole(symbols: bytes) -> tuple[int, str]:
            path = _Path(grammar, text)
            path.add(short(symbols))
            return path.end()

        out: list[tuple] = []

        def done() -> None:
            nonlocal path
            cost, audit = whole(only) if path is None else path.end()
            out.append((key, *finished(facts), cost, audit))
            path = None

        def packed() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in _SUMMARY.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            rows, symbols = batch.select(names).to_pylist(), batch.column("symbols").to_pylist()
            for row, own in zip(rows, symbols):
                if row["key"] != key:
                    if key is not None:
                        done()
                    key, facts, only = row["key"], [row], own
                    continue
                if path is None:
                    path = _Path(grammar, text)
                    path.add(short(only))
                path.add(short(own))
                facts.append(row)
                if len(facts) > 2:  # two rows with their ends stand for all that went before
                    facts = [_joined(facts[0], facts[1]), facts[2]]
            yield packed()
        if key is not None:
            done()
        yield packed()

    return run


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring chunks' counts as of one chunk."""
    same = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low = [r["low"] for r in (a, b) if r["low"] is not None]
    high = [r["high"] for r in (a, b) if r["high"] is not None]
    broken = (a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1))
    sums = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")}
    return {
        "first": a["first"], "last": b["last"], "first_turn": a["first_turn"], "last_turn": b["last_turn"], **sums, "turns": a["turns"] + b["turns"] - same,
        "illegal": a["illegal"] + b["illegal"] + broken, "low": min(low, default=None), "high": max(high, default=None),
    }


_ORDER = ["key", "turn", "role", "hash", "guard"]


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv"), key.alias("key"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    return rows.withColumns({"hash": F.xxhash64("role", "text"), "guard": F.xxhash64(F.lit(1), "text", "role")})


def _fault(text: Column) -> Column:
    """1 blank, 3 truncated, 0 neither."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 1).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(3)


def _letter(role: Column) -> Column:
    """Place of the role's first letter among ``LETTERS``, else 3."""
    return F.coalesce(*[F.when(F.startswith(role, F.lit(x)), i) for i, x in enumerate(LETTERS)], F.lit(3))


def _audited(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``key``, counts, ``cost`` and ``audit``."""
    facts = rows.select(*_ORDER, _letter(F.col("role")).cast("long").alias("letter"), _fault(F.col("text")).cast("long").alias("fault"))
    facts = facts.groupBy(*_ORDER, "letter", "fault").agg(F.count("*").alias("copies"))
    same = ["key", "hash", "guard"]
    # only what a conversation says at several turns has a first turn to be asked for
    first = facts.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")) & F.col("first").isNotNull(), F.lit(False))
    fault = F.when((F.col("fault") != 1) & later, F.lit(2).cast("long")).otherwise(F.col("fault"))
    flagged = cut_lineage(facts.join(first, same, "left").select(*_ORDER, "letter", fault.alias("fault"), "copies"))
    ordered = flagged.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("key", "turn", "letter", "fault", "copies", F.spark_partition_id().alias("part"))
    chunks = cut_lineage(ordered.mapInArrow(_chunks(), _CHUNK))
    whole = chunks.repartition("key").sortWithinPartitions("key", "part", "number")
    return whole.mapInArrow(_resolve(learn(chunks)), _SUMMARY)


_EDIT = "key string, position bigint, edit string, turn bigint, role string, text string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Edits (key, initial, turn, role, text) of conversations that stand in order behind their audits, by batch."""
    key, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            letter = _wanted(state)
            yield key, "I", None, "user" if letter == "u" else "assistant", ""
            at, state = at + 1, _after(state, letter)

    for batch in batches:
        found: list[tuple] = []
        for k, own, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "turn", "role", "text"))):
            if own is not None:
                found += inserted()
                key, audit, at, state = k, own, 0, START
                found.append((key, "", None, None, None))  # a conversation begins
                continue
            found += inserted()
            edit = audit[at]
            at += 1
            if edit == "R":
                role = "user" if _wanted(state) == "u" else "assistant"
            if edit != "D":
                state = _after(state, role[0])
            found.append((key, edit, turn, role, text))
        yield found
    yield list(inserted())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, empty = None, None, True
    for found in _walk(batches):
        done = []
        for k, edit, _, role, text in found:
            if not edit:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, empty = k, hashlib.sha256(), True
            elif edit != "D":
                digest.update((("" if empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                empty = False
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "repaired_sha256"), d)) for d in done], pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": digest.hexdigest()}])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string()}[k]) for n, k in (f.split() for f in _EDIT.split(", "))])
    position = 0
    for found in _walk(batches):
        rows = []
        for key, edit, *rest in found:
            position = position + 1 if edit else 0
            if edit:
                rows.append(dict(zip(schema.names, (key, position, edit, *rest))))
        yield pa.RecordBatch.from_pylist(rows, schema)


def _in_order(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition that streams."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = audited.select("key", "audit", none("turn", "bigint"), none("role", "string"), none("text", "string"), none("hash", "bigint"), none("guard", "bigint"))
    both = heads.unionByName(rows.select("key", none("audit", "string"), "turn", "role", "text", "hash", "guard"))
    return both.repartition("key").sortWithinPartitions("key", F.col("audit").isNull(), *_ORDER[1:])


def edits(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every edit in its place: conv, ``position`` (from 1), ``edit`` (K, R, D or I), turn, role and text after it."""
    rows = _rows(conversations, conv, turn, role, text)
    found = _in_order(rows, cut_lineage(_audited(rows))).mapInArrow(_edits, _EDIT)
    names = rows.groupBy("key").agg(F.first("conv").alias("conv"))
    return found.join(names, "key").select(F.col("conv").alias(conv), "position", "edit", F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, ``gaps`` (turns missing between its first and last), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (neighbouring roles that may not follow each other), ``cost``, ``audit`` (initials of the edits)
    and ``repaired_sha256`` (of the repaired ``role:text`` lines)."""
    rows = _rows(conversations, conv, turn, role, text)
    audited = cut_lineage(_audited(rows))
    hashed = _in_order(rows, audited).mapInArrow(_hashes, "key string, repaired_sha256 string")
    names = rows.groupBy("key").agg(F.first("conv").alias("conv"))
    return audited.join(hashed, "key").join(names, "key").select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
