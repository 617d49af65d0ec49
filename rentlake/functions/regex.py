"""ECMAScript patterns on the JVM.

Three spellings differ between the two dialects and change results: ``\\b`` knows
ASCII word characters only, ``\\s`` includes the Unicode spaces, and ``$`` is the
very end of the text.  ``js`` rewrites those and folds case the Unicode way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, (0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
SPACE = r"\s\x0b" + _WIDE + chr(0x2000) + "-" + chr(0x200A)
#: One space.  Printable ASCII, most of any text, is ruled out by one comparison.
BLANK = f"[[^!-~]&&[{SPACE}]]"
_BEFORE_WORD, _AFTER_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_EDGE = rf"(?:{_BEFORE_WORD}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){_AFTER_WORD})"


def _starts_with_word(rest: str) -> bool:
    """Does everything this pattern can match begin with an ASCII word character?"""
    if rest.startswith("("):
        depth, start, branches = 0, 3 if rest.startswith("(?:") else 1, []
        for i, char in enumerate(rest):
            depth += (char == "(") - (char == ")")
            if (char == "|" and depth == 1) or (char == ")" and depth == 0):
                branches.append(rest[start:i])
                start = i + 1
            if depth == 0:
                optional = rest[i + 1 : i + 2] in ("?", "*")
                return not optional and all(map(_starts_with_word, branches))
        return False
    return bool(re.match(r"(?:[A-Za-z0-9]|\\d)(?![?*])", rest))


def edge(before: str, after: str) -> str:
    """Cheapest spelling of an ASCII word boundary between two pieces of a pattern."""
    if _starts_with_word(after):
        return _BEFORE_WORD
    if re.search(r"(?<!\\)[A-Za-z0-9]$", before):
        return _AFTER_WORD
    return _EDGE


def respell(pattern: str, space: str, boundary, end: str) -> str:
    """Rewrite ``\\s``, ``\\b`` and ``$``, minding character classes."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair, one = pattern[i : i + 2], pattern[i]
        if pair == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif pair == r"\S" and in_class:
            out.append(pair)
        elif pair == r"\b" and not in_class:
            out.append(boundary(pattern[:i], pattern[i + 2 :]))
        elif one == "\\":
            out.append(pair)
        elif one == "$" and not in_class:
            out.append(end)
            i += 1
            continue
        else:
            in_class = (one == "[") or (in_class and one != "]")
            out.append(one)
            i += 1
            continue
        i += 2
    return "".join(out)


def js(pattern: str, fold_case: bool = True) -> str:
    return ("(?iu)" if fold_case else "") + respell(pattern, SPACE, edge, r"\z")


def has(text: Column, pattern: str, fold_case: bool = True) -> Column:
    """Does the pattern occur?  NULL text counts as no."""
    return F.coalesce(text.rlike(js(pattern, fold_case)), F.lit(False))


def has_any(text: Column, patterns) -> Column:
    return has(text, "|".join(f"(?:{p})" for p in patterns))


def group(text: Column, pattern: str, n: int = 1, fold_case: bool = True) -> Column:
    """Group of the first match, NULL where there is none."""
    return F.nullif(F.regexp_extract(text, js(pattern, fold_case), n), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; no blank at either end."""
    # A single blank between words is left as it is.
    return F.trim(F.regexp_replace(text, f"[[^ -~]&&[{SPACE}]]{BLANK}*| {BLANK}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def cut(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def filled(text: Column) -> Column:
    """The text if it holds anything but white space, else NULL."""
    return F.when(text.rlike(f"[^{SPACE}]"), text)


def number_text(value: Column) -> Column:
    """3.0 reads ``3``; 2.5 reads ``2.5``."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )


def half_up(value: Column) -> Column:
    """Rounding with ties towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def stages(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Add columns step by step; a step may use the columns of the ones before.

    A column that later steps read more than once is computed once: the optimizer keeps
    such projections apart, and they still run in one generated function.
    """
    for step in steps:
        df = df.withColumns(step)
    return df


def cut_before(text: Column, patterns, beyond: int) -> Column:
    """Cut collapsed text at each marker in turn when its first hit lies past ``beyond`` characters.

    One replacement per marker: no hit may start within the head, then the shortest
    longer text up to a hit stays.
    """
    for pattern in patterns:
        hit = f"(?:{respell(pattern, SPACE, edge, r'\z')})"
        whole = rf"(?iu)\A(?![\s\S]{{0,{beyond}}}{hit})([\s\S]{{{beyond + 1},}}?){hit}[\s\S]*\z"
        text = F.rtrim(F.regexp_replace(text, whole, "$1"))
    return text


def exploded(df: DataFrame, keep, array: Column, item: str) -> DataFrame:
    """One row per array element with its position.

    The outer form with a filter behind it: the plain form makes the optimizer compute
    the array a second time, in a filter below, just to see whether it is empty.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("pos", item)).where("pos is not null")
