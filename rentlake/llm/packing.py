"""Packing examples into sequences under several limits at once (vector bin packing).

An example asks for a vector: tokens, segments (one for each piece) and loss-bearing
tokens; a sequence offers a capacity in each.  Whole sequences are filled one after the
other.  For the open one, the next example is the fitting one whose demand has the largest
dot product with what the sequence still offers, both as shares of the capacity.  When
nothing fits whole and cutting is allowed, the best-aligned example is cut to fill the gap.

Packing works within a task on a pool of bounded size, so no row is moved between tasks:
only the last sequence of a task, or one that ran into another limit, has a gap; with
``powers`` it is dealt out to sequences whose lengths are powers of two, which need no padding.  Sequence ids
hold the input partition's number, so a lost task makes the same ids again.

Defined cases: a null or empty text has the closing id alone; an example without tokens takes
part in no sequence; an example that exceeds a limit by itself is cut, or, where cutting
is off, gets a sequence of its own (with cutting, its tokens count as loss-bearing from the start on); equal examples are placed in input order; repeated rows are
packed each on its own.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rentlake.llm.textbatch import column, slices

TOKENS = 1024
SEGMENTS = 64
#: Examples in the pool of a task.
POOL = 512
CLOSING_ID = 0
#: White space in a row, in characters, from which a run is cut out by hand: the pattern's engine gives up at a million.
LONG_SPACE = 1 << 19

_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


@dataclass(frozen=True)
class Limits:
    """Of a sequence; ``loss`` is the most loss-bearing tokens."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS


class Packer:
    """Places examples as they come; gives pieces (example, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int = 0, cut: bool = True, powers: bool = True, pool: int = POOL):
        self.limits, self.cut, self.powers, self.pool, self.next_id = limits, cut, powers, pool, first_sequence
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.examples: list = []
        self.starts, self.tokens, self.loss = (np.zeros(0, np.int64) for _ in range(3))
        self.open: list[tuple] = []  # (example, start, length) of the sequence being filled
        self.room = self._all_room()

    def _all_room(self) -> list[int]:
        return [self.limits.tokens, self.limits.segments, self.limits.loss]

    def add(self, examples: list, tokens: np.ndarray, loss: np.ndarray) -> Iterator[tuple]:
        """Take examples into the pool and place what exceeds it."""
        most = min(self.limits.tokens, self.limits.loss)
        starts = np.zeros(len(examples), np.int64)
        if self.cut:  # whole sequences out of one example, all of whose tokens bear loss
            for i in np.flatnonzero((loss == tokens) & (tokens >= most)):
                while tokens[i] - starts[i] >= most:
                    yield from self._numbered([(examples[i], int(starts[i]), most)])
                    starts[i] += most
        left = tokens - starts
        kept = np.flatnonzero(left > 0)
        self.examples += [examples[i] for i in kept]
        self.starts = np.concatenate([self.starts, starts[kept]])
        self.tokens = np.concatenate([self.tokens, left[kept]])
        self.loss = np.concatenate([self.loss, np.minimum(loss, left)[kept]])
        while len(self.examples) > self.pool:
            yield from self._step()

    def close(self) -> Iterator[tuple]:
        """Place all that is left."""
        while self.examples:
            yield from self._step()
        if self.open:
            yield from self._shut()

    def _numbered(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for example, start, length in pieces:
            out.append((example, start, length, self.next_id, offset))
            offset += length
        self.next_id += 1
        return out

    def _shut(self) -> list[tuple]:
        """Number the open sequence; one with a gap is dealt out to powers of two."""
        pieces, gap = self.open, self.room[0]
        self.open, self.room = [], self._all_room()
        if not (gap > 0 and self.cut and self.powers):
            return self._numbered(pieces)
        out, left, own, space = [], self.limits.tokens - gap, [], 0
        for example, start, length in pieces:
            while length:
                space = space or 1 << (left.bit_length() - 1)
                n = min(length, space)
                own.append((example, start, n))
                start, length, space, left = start + n, length - n, space - n, left - n
                if not space:
                    out, own = out + self._numbered(own), []
        return out

    def _step(self) -> list[tuple]:
        """One piece into the open sequence, which is given out when nothing more goes in."""
        tokens, segments, loss = self.room
        share = np.array(self.room) / self.capacity / self.capacity
        aligned = self.tokens * share[0] + share[1] + self.loss * share[2]
        fits = (self.tokens <= tokens) & (self.loss <= loss)
        if segments and fits.any():
            i = int(np.argmax(np.where(fits, aligned, -1.0)))
            take = int(self.tokens[i])
        elif self.cut and segments and tokens and loss:
            i = int(np.argmax(aligned))
            take = min(int(self.tokens[i]), tokens, loss)
        elif not self.open:  # exceeds a whole sequence and may not be cut
            i, take = 0, int(self.tokens[0])
        else:
            return self._shut()
        lossy = min(take, int(self.loss[i]))
        self.open.append((self.examples[i], int(self.starts[i]), take))
        self.room = [tokens - take, segments - 1, loss - lossy]
        if take == self.tokens[i]:
            del self.examples[i]
            self.starts, self.tokens, self.loss = (np.delete(a, i) for a in (self.starts, self.tokens, self.loss))
        else:
            self.starts[i] += take
            self.tokens[i] -= take
            self.loss[i] -= lossy
        return self._shut() if self.room[0] <= 0 else []


def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Encoder for a file of ranks: the ids the library gives for the same vocabulary."""
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoding, spaces = (tiktoken.Encoding("byte_bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, r"\s+"))

    def encode(text: str) -> np.ndarray:
        """A long run is a piece of its own, up to its last character if something follows."""
        parts, at = [], 0
        for run in _SPACES.finditer(text) if len(text) >= LONG_SPACE else ():
            if run.end() - run.start() >= LONG_SPACE:
                end = run.end() - (run.end() < len(text))
                parts += [encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), spaces.encode_to_numpy(text[run.start() : end], disallowed_special=())]
                at = end
        parts.append(encoding.encode_to_numpy(text[at:] if at else text, disallowed_special=()))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    return encode


PIECE = "start bigint, length bigint, ids_crc32 bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint"
_FIRST = 1 << 32  # sequences of one input partition


def _pack(make_encoder: Callable[[], Callable[[str], np.ndarray]], limits: Limits, pool: int, with_ids: bool, names: list[str], kind: pa.DataType):
    def emit(pieces: list[tuple]) -> pa.RecordBatch:
        ids = [p[0][1][p[1] : p[1] + p[2]] for p in pieces]
        columns = [
            pa.array([p[0][0] for p in pieces], kind),
            *(pa.array([p[i] for p in pieces], pa.int64()) for i in (1, 2)),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            *([pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []),
            pa.array([len(p[0][1]) for p in pieces], pa.int64()),
            *(pa.array([p[i] for p in pieces], pa.int64()) for i in (3, 4)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        packer = Packer(limits, TaskContext.get().partitionId() * _FIRST, pool=pool)
        done: list[tuple] = []
        for rows, data, offsets in slices(batches):
            raw, keys = data.tobytes(), column(rows, "key").to_pylist()
            examples, lengths = [], []
            for i, key in enumerate(keys):
                ids = np.append(encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")), np.uint32(CLOSING_ID))
                examples.append((key, ids.astype(np.uint32)))
                lengths.append(len(ids))
            n = np.array(lengths, np.int64)
            done += packer.add(examples, n, n)
            if done:
                yield emit(done)
                done = []
        done += packer.close()
        if done:
            yield emit(done)

    return run


def pack_texts(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), pool: int = POOL, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``CLOSING_ID``; all of them bear loss.  The spelling of
    a special token in a text is ordinary text.  ``ranks`` is the tokenizer's file, present on
    every machine.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    fields = [f for f in PIECE.split(", ") if with_ids or not f.startswith("ids ")]
    names = ["key", *(f.split()[0] for f in fields)]
    run = _pack(lambda: byte_bpe(ranks), limits, pool, with_ids, names, to_arrow_type(rows.schema["key"].dataType))
    return rows.mapInArrow(run, f"key {kind}, {', '.join(fields)}").withColumnRenamed("key", key)
