"""Bounded sample of labelled texts on which the text models are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of each class, and the longest text (bytes) that is taken into a sample.
ROWS_PER_CLASS = 2000
TEXT_BYTES = 20_000


def crc_of_id(key: str = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def shares(labels: DataFrame, label: str) -> dict[int, float] | None:
    """Share of label 0 and of label 1 among all labelled rows; None unless both occur."""
    n = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
    return {c: n[c] / sum(n.values()) for c in (0, 1)} if len(n) == 2 else None


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = ROWS_PER_CLASS, text_bytes: int = TEXT_BYTES, key: str = "doc_id", text: str = "text") -> list[tuple[int, str, int]]:
    """(id, text, label) of at most ``rows`` documents of each class, in order of id.

    Taken in the order of a hash of the id, so the choice does not depend on partitioning.
    Only ids are sorted; the documents are read in one scan against the chosen ids, whose
    number is bounded by ``rows``.  Ids labelled both ways count as the larger label; other
    labels and null ids are left out; of documents that repeat an id, the smallest text is taken.
    """
    votes = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if where is not None:
        votes = votes.where(where)
    votes = votes.groupBy(key).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64(key), F.col(key)]
    taken = [votes.where(F.col("label") == c).orderBy(*order).limit(2 * rows) for c in (0, 1)]
    chosen = taken[0].unionByName(taken[1]).select(F.col(key).alias("id"), "label")
    rows_of = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= text_bytes)
    found = rows_of.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kept = [found.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows) for c in (0, 1)]
    return sorted((r["id"], r["text"], r["label"]) for r in kept[0].unionByName(kept[1]).collect())
