"""Rent, area, rooms and fees read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.functions.regex import group, half_up, has, js, stages


def with_amounts(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """European number text (column) to a whole amount (new column).

    NULL if the text does not start with a digit.
    """
    bare, plain, number = {}, {}, {}
    for out, raw in outs.items():
        text = F.col(f"_{out}_bare")
        bare[f"_{out}_bare"] = F.regexp_replace(F.col(raw), js(r"\s"), "")
        comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
        no_dots, no_commas = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))
        plain[f"_{out}_plain"] = (
            F.when(comma & dot & text.rlike(r",[^.]*\z"), F.replace(no_dots, F.lit(","), F.lit(".")))
            .when(comma & dot, no_commas)
            .when(text.rlike(r"\A[^,]*,[^,]{3}\z"), no_commas)
            .when(comma, F.replace(text, F.lit(","), F.lit(".")))
            .when(text.rlike(r"\A\d{1,3}(\.\d{3})+\z"), no_dots)
            .otherwise(text)
        )
        head = F.regexp_extract(F.col(f"_{out}_plain"), r"\A\d+(\.\d+)?", 0)
        number[f"_{out}_n"] = half_up(head.try_cast("double"))
    final = {
        out: F.when((F.col(f"_{out}_n") == 1) & F.col(f"_{out}_plain").rlike(r"\A1\.0+\z"), F.lit(1000))
        .otherwise(F.col(f"_{out}_n"))
        .cast("bigint")
        for out in outs
    }
    return stages(df, bare, plain, number, final).drop(*bare, *plain, *number)


def repair_thousand(amount: Column, text: Column) -> Column:
    """``€ 1.000`` anywhere in the text, or an amount of 1, means 1000."""
    return F.when(has(text, V.RENT_THOUSAND) | (amount == 1), F.lit(1000)).otherwise(amount)


def accepted(fixed: Column, text: Column) -> Column:
    """A repaired amount in the plausible range; a high one only if named monthly."""
    named_monthly = (fixed <= V.RENT_HINT_ABOVE) | has(text, V.RENT_MONTH_WORD)
    return F.when((fixed >= V.RENT_MIN) & (fixed <= V.RENT_MAX) & named_monthly, fixed).cast("int")


def with_rent(df: DataFrame, text: str, out: str) -> DataFrame:
    """Monthly rent of a text: named monthly, else after the sign, else before it."""
    t = F.col(text)
    raw = {f"_{out}_r0": V.RENT_MONTHLY, f"_{out}_r1": V.RENT_AFTER_SIGN, f"_{out}_r2": V.RENT_BEFORE_SIGN}
    read = {name: group(t, pattern) for name, pattern in raw.items()}
    area_follows = F.regexp_extract(t, js(V.RENT_AFTER_SIGN_TAIL), 1).rlike(js(V.AREA_TAIL))
    amounts = {f"{name}n": name for name in raw}
    fixed = {
        f"{name}f": F.when(F.col(name).isNotNull(), repair_thousand(F.col(f"{name}n"), t)) for name in raw
    }
    first, second, third = [accepted(F.col(name), t) for name in fixed]
    df = with_amounts(df.withColumns(read), amounts).withColumns(fixed)
    rent = F.coalesce(first, F.when(~area_follows, second), third)
    return df.withColumn(out, rent).drop(*read, *amounts, *fixed)


def has_monthly_hint(text: Column) -> Column:
    return has(text, V.RENT_HINT)


def area(text: Column) -> Column:
    return group(text, V.AREA).try_cast("double")


def rooms(text: Column) -> Column:
    listed = F.replace(group(text, V.ROOMS_LOCALI), F.lit(","), F.lit("."))
    return F.coalesce(
        group(text, V.ROOMS_EN).try_cast("double"),
        group(text, V.ROOMS_STANZE).try_cast("double"),
        listed.try_cast("double"),
    )


def rooms_from_words(title: Column) -> Column:
    found = F.lit(None).cast("double")
    for word, count in reversed(V.ROOM_WORDS):
        found = F.when(has(title, rf"\b{word}\b"), F.lit(float(count))).otherwise(found)
    return found


def rooms_from_prefix(title: Column) -> Column:
    return group(title, V.ROOMS_TITLE_PREFIX).try_cast("double")


def condo_fee(text: Column) -> Column:
    return group(text, V.CONDO_FEE).try_cast("int")


def total_cost(rent_eur: Column, fee_eur: Column) -> Column:
    return F.coalesce(rent_eur + fee_eur, rent_eur)
