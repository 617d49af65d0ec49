"""Licence scan: notice phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text is reduced to its words (runs of ASCII letters and digits, lower-cased, and of any
non-ASCII character) with one space between; one automaton finds all phrases in it in a
single pass.  Texts that hold the words of an identifier tag are read again in their own
spelling, and the expression behind each tag is parsed and evaluated.

Defined cases: a null or empty text has no words, no matches and score 0; overlapping
phrases all count; a malformed expression is used up to its longest well-formed beginning,
and dropped if there is none; repeated rows are scanned one by one; other columns are not
read.  A match depends on its text alone, so a lost task can be run again at any time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.llm.textbatch import slices

# The phrases every scan looks for.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices the method knows besides.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

# Words an identifier tag leaves in the reduced text.
TAG = "spdx license identifier"

# How much a licence asks of those who use a text, by the beginning of its label; the longest counts.
BURDENS = {
    "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "apache": 0.15, "unlicense": 0.05, "cc0": 0.05, "public-domain": 0.05,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.4, "cc-by": 0.2, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.9, "cc-by-nc": 0.9,
    "all-rights-reserved": 1.0,
}
UNKNOWN_BURDEN = 0.6
#: An exception takes away this share of its licence's burden.
EXCEPTION_RELIEF = 0.5

_REDUCED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_LINE = re.compile(rb"spdx-license-identifier\s*:([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_STRENGTH = {"or": 1, "and": 2, "with": 3}

MATCH = "struct<label: string, kind: string, first_word: bigint, n_words: int, burden: double>"
EXPRESSION = "struct<text: string, labels: array<string>, burden: double>"


def burden_of(label: str) -> float:
    fits = [k for k in BURDENS if label == k or label.startswith(k + "-")]
    return BURDENS[max(fits, key=len)] if fits else UNKNOWN_BURDEN


def label_of(identifier: str) -> str:
    """Label of a licence identifier: lower case, without the suffixes for "or later" and "only"."""
    label = re.sub(r"(\+|-only|-or-later)$", "", identifier.lower())
    label = re.sub(r"(?<=\d)\.0$", "", label)
    return "cc-by-nc" if label.startswith("cc-by-nc-") and label[9:10].isdigit() else label


def _well_formed(tokens: list[str]) -> list[str]:
    """Longest beginning that is a whole expression."""
    depth, operand, best, in_exception = 0, True, 0, False
    for i, token in enumerate(tokens):
        low = token.lower()
        if operand:
            if token == "(" and not in_exception:
                depth += 1
                continue
            if token == ")" or low in _STRENGTH or token == "(":
                break
            operand, in_exception = False, False
            with_allowed = i == 0 or tokens[i - 1].lower() != "with"
        elif token == ")":
            if not depth:
                break
            depth, with_allowed = depth - 1, False
        elif low in _STRENGTH and (low != "with" or with_allowed):
            operand, in_exception = True, low == "with"
        else:
            break
        if not depth and not operand:
            best = i + 1
    return tokens[:best]


def evaluate(text: str) -> tuple[str, list[str], float] | None:
    """(expression, licences it names, burden): of alternatives the lightest, of joint terms the heaviest."""
    tokens = _well_formed(_TOKEN.findall(text))
    if not tokens:
        return None
    output: list[tuple[set[str], float]] = []
    pending: list[str] = []

    def apply() -> None:
        operator, (right, heavy), (left, light) = pending.pop(), output.pop(), output.pop()
        if operator == "with":
            output.append((left, light * (1 - EXCEPTION_RELIEF)))
        else:
            output.append((left | right, (min if operator == "or" else max)(light, heavy)))

    for token in tokens:
        low = token.lower()
        if token == "(":
            pending.append(token)
        elif token == ")":
            while pending[-1] != "(":
                apply()
            pending.pop()
        elif low in _STRENGTH:
            while pending and pending[-1] != "(" and _STRENGTH[pending[-1]] >= _STRENGTH[low]:
                apply()
            pending.append(low)
        else:
            label = label_of(token)
            output.append(({label}, burden_of(label)))
    while pending:
        apply()
    labels, burden = output[0]
    return " ".join(tokens), sorted(labels), burden


def _automaton(phrases: dict[str, tuple[str, str]]):
    found = ahocorasick.Automaton()
    for phrase, (label, kind) in phrases.items():
        found.add_word(f" {phrase} ", (label, kind, phrase.count(" ") + 1, burden_of(label)))
    found.make_automaton()
    return found


def _scan(phrases: dict[str, tuple[str, str]], keys: list[str], text: str):
    automaton = _automaton(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, text):
            raw = data.tobytes()
            n_words, matches, expressions = np.zeros(rows.num_rows, np.int64), [], []
            for i in range(rows.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                words = own.translate(_REDUCED).split()
                n_words[i] = len(words)
                reduced = f" {b' '.join(words).decode('latin-1')} "
                found, tagged, at, before = [], False, 0, 0
                for end, (label, kind, n, weight) in automaton.iter(reduced):
                    if kind == "tag":
                        tagged = True
                        continue
                    # the phrase starts n spaces before the closing one
                    before, at = before + reduced.count(" ", at, end), end
                    found.append({"label": label, "kind": kind, "first_word": before - n, "n_words": n, "burden": weight})
                matches.append(found)
                parsed = [evaluate(m[1].decode("utf-8", "replace")) for m in _TAG_LINE.finditer(own)] if tagged else []
                expressions.append([{"text": p[0], "labels": p[1], "burden": p[2]} for p in parsed if p])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in keys), pa.array(n_words), pa.array(matches, _MATCHES), pa.array(expressions, _EXPRESSIONS)],
                [*keys, "n_words", "matches", "expressions"],
            )

    return run


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("burden", pa.float64())]))
_EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("burden", pa.float64())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: key, n_words, ``matches`` (places of phrases) and ``expressions`` (of tags)."""
    phrases = {TAG: (TAG, "tag")} | {p: (label, "notice") for p, label in notices.items()} | {p: (label, "base") for p, label in base.items()}
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, matches array<{MATCH}>, expressions array<{EXPRESSION}>"
    return rows.mapInArrow(_scan(phrases, ["key"], "text"), schema).withColumnRenamed("key", key)


def burden() -> Column:
    """Heaviest burden among notices and expressions of a scanned row, 0 without any."""
    parts = [F.array_max(F.transform(F.col(c), lambda x: x.burden)) for c in ("matches", "expressions")]
    return F.coalesce(F.greatest(*parts), F.lit(0.0))
