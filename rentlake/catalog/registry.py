"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlake.catalog.sqlkit import chain
from rentlake.catalog.views import view, with_clause
from rentlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def projection(name: str, source: str, keep, columns, steps, outputs=None, prepare=None):
    """Register a row-by-row projection of a view.

    ``columns`` builds the Spark columns; ``steps`` are dicts of SQL expressions, each of
    which may use the columns of the ones before.  ``prepare`` adds staged columns first.
    """
    steps = [steps] if isinstance(steps, dict) else steps
    keep = list(keep)

    def run(spark, sf_dir):
        rows = view(spark, sf_dir, source)
        if prepare is not None:
            rows = prepare(rows)
        return rows.select(*keep, *[c.alias(n) for n, c in columns(F.col).items()])

    def sql():
        names = outputs or list(steps[-1])
        return chain(with_clause(source), source, steps, f"select {', '.join([*keep, *names])} from {{from}}")

    query(name, sql())(run)


def oracle(body: str, *views_: str, steps=None, base: str | None = None) -> str:
    """SQL over views; ``{from}`` stands for the last step, a leading comma adds CTEs."""
    if steps is None:
        return f"with {with_clause(*views_)}\n{body}"
    return chain(with_clause(*views_), base or views_[0], steps, body)
