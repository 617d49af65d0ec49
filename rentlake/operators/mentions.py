"""Which words of a table occur in which texts, also inside words.

Each word is looked for by one short piece of it, the one that fewest texts hold.  A text meets only the words whose
piece it holds, by an equality join; these few are then searched for in the whole text.  No text is compared with
all words, and no words are carried to all tasks unless they are below Spark's own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake.session import cut_lineage

#: Characters in a piece; shorter words are their own piece.
PIECE = 3


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of a text; one pass, at every length of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _exploded(rows: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.concat(*[_pieces(F.col(text), size) for size in range(1, PIECE + 1)])
    return rows.select(key, F.explode(whole).alias("_piece"))


def mentions(texts: DataFrame, key: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct pairs (key, word) where the text holds the word; ``key`` tells texts apart.

    Upper and lower case differ, so fold both before.  Null or empty words and null texts meet nothing; repeated
    words count once.
    """
    distinct = words.select(F.col(word).alias("_word")).where("_word <> ''").distinct()
    size = F.least(F.char_length("_word"), F.lit(PIECE))
    own = F.when(size == 1, _pieces(F.col("_word"), 1)).when(size == 2, _pieces(F.col("_word"), 2)).otherwise(_pieces(F.col("_word"), PIECE))
    of_words = distinct.select("_word", F.explode(own).alias("_piece"))
    # Only pieces of words travel; a text names each of them once.
    held = cut_lineage(_exploded(texts.select(key, text), key, text).join(of_words.select("_piece").distinct(), "_piece", "left_semi"))
    often = held.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", "_piece")).alias("_rarest")
    # A word with a piece that no text holds is in none of them.
    known = of_words.join(often, "_piece", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    by_piece = known.groupBy("_word").agg(rarest).where("_rarest._n > 0").select("_word", F.col("_rarest._piece").alias("_piece"))
    near = held.join(by_piece, "_piece").select(key, "_word")
    found = near.join(texts.select(key, text), key).where(F.contains(F.col(text), F.col("_word")))
    return found.select(key, F.col("_word").alias(word))


def zones(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Distinct pairs (key, zone) for a table of (zone, word): the zones a text mentions by any of their words.

    ``text`` is in lower case, as the search text is; the words are folded here.  A zone without a name is none.
    """
    rows = aliases.where("zone is not null").select("zone", F.lower("word").alias("word")).distinct()
    return mentions(texts, key, text, rows).join(rows, "word").select(key, "zone").distinct()


def zone_counts(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Per zone the number ``n`` of numeric keys whose texts mention it, the smallest of them and their sum ``ids``.

    A key may stand at several texts.  Equal texts are searched once, and keys whose texts mention the same zones are
    counted together, so no pair of key and zone is made.
    """
    rows = texts.where(F.col(text).isNotNull()).select(key, text)
    whole = cut_lineage(rows.select(text).distinct().withColumn("_id", F.monotonically_increasing_id()))
    found = zones(whole, "_id", text, aliases).groupBy("_id").agg(F.sort_array(F.collect_set("zone")).alias("_zones"))
    found = cut_lineage(found)
    kinds = cut_lineage(found.select("_zones").distinct().withColumn("_kind", F.monotonically_increasing_id()))
    kind_of = cut_lineage(whole.join(found, "_id").join(kinds, "_zones").select(text, "_kind"))
    held = rows.join(kind_of, text).groupBy(key).agg(F.sort_array(F.collect_set("_kind")).alias("_kinds"))
    k = F.col(key)
    totals = cut_lineage(held.groupBy("_kinds").agg(F.count("*").alias("n"), F.min(k).alias("first_id"), F.sum(k).alias("ids")))
    of_kind = totals.select("_kinds", F.explode("_kinds").alias("_kind")).join(kinds.select("_kind", F.explode("_zones").alias("zone")), "_kind")
    each = of_kind.select("_kinds", "zone").distinct().join(totals, "_kinds")
    return each.groupBy("zone").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.sum("ids").alias("ids"))
