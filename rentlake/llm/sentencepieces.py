"""Encoding and decoding with merge-type piece vocabularies.

Encoding starts from single characters and, again and again, merges the adjacent pair whose
merged piece has the best score (the leftmost among equals) until no pair makes a piece.
No piece holds a word mark behind another character, so merges never cross the start of a
word: the text is cut there, and each distinct unit of a slice is encoded once.  Short
units of one length form a matrix whose rows take one merge from their agenda per step;
a long unit has an agenda of its own, a heap over linked symbols.  Characters outside the
vocabulary become byte pieces.

Every batch can be compared with the sentencepiece library, which also decodes.

Defined cases: a null or empty text has the begin and end ids alone; a text of white space
keeps every blank; control pieces spelled out in a text are ordinary characters; repeated
rows are encoded one by one; a vocabulary of another type, with a normaliser or with
user-defined pieces is refused with ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.llm.textbatch import mix, prefix_hash, slices, span_hash

MARK = 0x2581
#: Longest unit (characters) that goes into a matrix.
LONG = 40
_SLOTS = 19
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.int32(1 << 30)


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trained, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if (
            trained.model_type != 2 or not trained.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
            or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or any(c not in pieces for p in pieces for c in p)
            or any(a != chr(MARK) == b for p in pieces for a, b in zip(p, p[1:]))
        ):
            raise ValueError("not a merge-type vocabulary with byte pieces and without normalisation")
        self.begin = next(i for i, p in enumerate(model.pieces) if p.piece == trained.bos_piece)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == trained.eos_piece)
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        # best score first; equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in pieces.values()}, reverse=True))}
        self.rank = np.full(len(model.pieces) + 1, _NONE, np.int32)
        for i in pieces.values():
            self.rank[i] = order[model.pieces[i].score]
        self.of_char = np.full(0x110000, -1, np.int32)
        merging = np.zeros(0x110000, bool)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            else:
                merging[[ord(c) for c in piece]] = True
        self.alone = ~merging
        pairs = [(pieces[p[:k]] << 16 | pieces[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        self.keys, self.merged = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, -1, np.int32)
        if len(pairs) > 1 << (_SLOTS - 1):
            raise ValueError("too many pairs")
        for key, i in pairs:
            slot = int(self._slot(np.int64(key)))
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOTS) - 1)
            self.keys[slot], self.merged[slot] = key, i

    @staticmethod
    def _slot(keys):
        with np.errstate(over="ignore"):
            return (keys * np.int64(-7046029254386353131) >> np.int64(64 - _SLOTS)) & np.int64((1 << _SLOTS) - 1)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, or -1."""
        keys = left.astype(np.int64) << 16 | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slots]
            hit = there == keys
            out[todo[hit]] = self.merged[slots[hit]]
            on = ~hit & (there >= 0)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & ((1 << _SLOTS) - 1)
        return out

    def encode_rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of one length, a row each, merged in place step by step; and their new lengths."""
        n, width = symbols.shape
        lengths = np.full(n, width)
        out = symbols
        if width == 1:
            return out, lengths
        made = self.merge(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        current = symbols.copy()
        while True:
            ranks = self.rank[made]
            best = ranks.argmin(1)
            going = ranks[np.arange(len(best)), best] < _NONE
            out[rows[~going], : current.shape[1]] = current[~going]
            rows, current, made, best = rows[going], current[going], made[going], best[going]
            if not len(rows):
                return out, lengths
            lengths[rows] -= 1
            each = np.arange(len(rows))
            current[each, best] = made[each, best]
            keep = np.arange(current.shape[1]) != (best + 1)[:, None]
            current = current[keep].reshape(len(rows), -1)
            wide = current.shape[1]
            if wide == 1:
                out[rows, 0] = current[:, 0]
                return out, lengths
            keep = np.arange(wide) != best[:, None]
            made = made[keep].reshape(len(rows), -1)
            inner = best > 0
            made[each[inner], best[inner] - 1] = self.merge(current[each[inner], best[inner] - 1], current[each[inner], best[inner]])
            inner = best < wide - 1
            made[each[inner], best[inner]] = self.merge(current[each[inner], best[inner]], current[each[inner], best[inner] + 1])

    def encode_long(self, symbols: np.ndarray) -> np.ndarray:
        """One unit by a heap of (rank, place)."""
        n = len(symbols)
        piece, before, after = symbols.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        made = self.merge(symbols[:-1], symbols[1:])
        agenda = [(int(self.rank[m]), i, m, piece[i], piece[i + 1]) for i, m in enumerate(made.tolist()) if m >= 0]
        heapq.heapify(agenda)
        while agenda:
            _, i, m, left, right = heapq.heappop(agenda)
            j = after[i]
            if piece[i] != left or j < 0 or piece[j] != right:
                continue
            piece[i], piece[j] = m, -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    new = int(self.merge(np.array([piece[a]], np.int32), np.array([piece[b]], np.int32))[0])
                    if new >= 0:
                        heapq.heappush(agenda, (int(self.rank[new]), a, new, piece[a], piece[b]))
        return np.array([p for p in piece if p != -2], np.int32)

    def _unit_ids(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and the n + 1 bounds."""
        lengths = ends - starts
        by_unit: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(lengths):
            own = np.flatnonzero(lengths == width)
            if width > LONG:
                for u in own:
                    ids = self.encode_long(self.of_char[points[starts[u] : ends[u]]])
                    by_unit.append((np.array([u]), ids[None, :], np.array([len(ids)])))
                continue
            symbols = self.of_char[points[starts[own][:, None] + np.arange(width)]]
            if width == 1 and (symbols < 0).any():
                unknown = own[symbols[:, 0] < 0]
                for u in unknown:
                    ids = self.byte_ids[list(chr(points[starts[u]]).encode())]
                    by_unit.append((np.array([u]), ids[None, :], np.array([len(ids)])))
                own, symbols = own[symbols[:, 0] >= 0], symbols[symbols[:, 0] >= 0]
            by_unit.append((own, *self.encode_rows(symbols)))
        count = np.zeros(len(starts), np.int64)
        for own, _, n in by_unit:
            count[own] = n
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(bounds[-1], np.int32)
        for own, ids, n in by_unit:
            if len(own):
                flat[np.repeat(bounds[own], n) + _within(n)] = ids[np.repeat(np.arange(len(own)), n), _within(n)]
        return flat, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and the n + 1 bounds."""
        points = np.frombuffer("".join(f" {t}" if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[points == 32] = MARK
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        offsets = np.concatenate([[0], np.cumsum(size)])
        cut = np.zeros(len(points) + 1, bool)
        cut[offsets] = True
        mark, alone = points == MARK, self.alone[points]
        cut[1:-1] |= (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        hashes = span_hash(prefix_hash(mix(points.astype(np.uint64) + np.uint64(1 << 40))), starts, ends)
        _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        flat, bounds = self._unit_ids(points, starts[first], ends[first])
        # begin and end ids are two more units
        flat = np.append(flat, np.array([self.begin, self.end], np.int32))
        bounds = np.append(bounds, [bounds[-1] + 1, bounds[-1] + 2])
        of_text = np.searchsorted(starts, offsets)
        unit = np.insert(unit, np.repeat(of_text, 2)[1:-1], np.tile([len(first), len(first) + 1], len(texts)))
        n = bounds[unit + 1] - bounds[unit]
        ids = flat[np.repeat(bounds[unit], n) + _within(n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[of_text + 2 * np.arange(len(texts) + 1)]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def _encode(model: str, check: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own, library = Vocabulary(model), sentencepiece.SentencePieceProcessor(model_file=model)
        for rows, data, offsets in slices(batches):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids, bounds = own.encode(texts)
            lists = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            if check:
                for mine, theirs in zip(lists, library.encode(texts, add_bos=True, add_eos=True, num_threads=1)):
                    if mine != theirs:
                        raise RuntimeError("ids differ from the library's")
            decoded = library.decode(lists, num_threads=1)
            words = ids.astype("<u4")
            columns = [
                rows.column(0),
                pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(words[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            ]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", check: bool = True, with_ids: bool = True) -> DataFrame:
    """One row per document: key, n_tokens, digests of ids and decoded text, and with ``with_ids`` both themselves.

    ``model`` is the vocabulary's file, present on every machine.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return rows.mapInArrow(_encode(model, check, with_ids), schema).withColumnRenamed("key", key)
