"""Words and buckets that come from tables, against loops over all pairs."""

import random

from pyspark.sql import functions as F

from rentlake.functions import places
from rentlake.operators import mentions, ranges


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("NestedLoop", "Cartesian") if name in plan]


def test_mentions_equal_a_search_for_every_word(spark):
    rng = random.Random(5)
    letters = "abc d€😀"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, piece(rng.randrange(40))) for i in range(150)] + [(900, None), (901, ""), (902, "xab"), (903, "abca" * 30000 + "zzz"), (904, "a\nb")]
    words = [piece(rng.randrange(1, 6)) for _ in range(200)] + ["ab", "ab", "", None, "a\nb", "zzz", "never", "abcabcabcabc", "b" * 300]
    left, right = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame([(w, 1) for w in words], "word string, id int")
    found = mentions.mentions(left, "id", "body", right)
    want = sorted((i, w) for i, t in texts if t is not None for w in {w for w in words if w} if w in t)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    assert joins(found) == []
    assert mentions.mentions(left.limit(0), "id", "body", right).count() == mentions.mentions(left, "id", "body", right.limit(0)).count() == 0


def test_zones_share_and_overlap_aliases(spark):
    texts = spark.createDataFrame([("t1", "vicino sansalvario nord"), ("t2", "crocetta"), ("t3", "nord est"), ("t4", None)], "id string, txt string")
    rows = [("San", "San"), ("Salvario", "salvario"), ("Salvario", "SALVARIO"), ("Nord", "nord"), ("Altro", "nord"), ("Croce", "croce"), (None, "est"), ("Leer", None), ("Leer", "")]
    found = mentions.zones(texts, "id", "txt", spark.createDataFrame(rows, "zone string, word string"))
    assert sorted(map(tuple, found.collect())) == [("t1", "Altro"), ("t1", "Nord"), ("t1", "Salvario"), ("t1", "San"), ("t2", "Croce"), ("t3", "Altro"), ("t3", "Nord")]


def test_equal_texts_are_searched_once(spark, monkeypatch):
    texts = [(i, ("vicino san nord", "crocetta", "nord", None)[i % 4]) for i in range(400)] + [(0, "nord"), (0, "san"), (1, "crocetta")]
    rows = [("San", "san"), ("Nord", "nord"), ("Nord", "NORD"), ("Croce", "croce"), ("Leer", None)]
    searched, search = [], mentions.mentions
    monkeypatch.setattr(mentions, "mentions", lambda t, *rest: searched.append(t.count()) or search(t, *rest))
    found = mentions.zone_counts(spark.createDataFrame(texts, "id bigint, txt string"), "id", "txt", spark.createDataFrame(rows, "zone string, word string"))
    want = {}
    for i, t in texts:
        for z in {z for z, w in rows if t and w and w.lower() in t}:
            want.setdefault(z, set()).add(i)
    assert sorted(map(tuple, found.collect())) == sorted((z, len(ids), min(ids), sum(ids)) for z, ids in want.items())
    assert searched == [4]  # four texts that are not null


def test_buckets_from_a_table_equal_the_literal_ones(spark, monkeypatch):
    monkeypatch.setattr("rentlake.operators.ordered.CHUNK", 7)
    rng = random.Random(9)
    buckets = {v: [(rng.randrange(0, 50), rng.randrange(11)) for _ in range(n)] for v, n in (("a", 12), ("b", 1), ("c", 30))}
    buckets["b"].append((None, 3))
    table = spark.createDataFrame([(v, *b) for v, bs in buckets.items() for b in bs], "version string, reach int, points int")
    odd = [None, float("nan"), float("inf"), -1.0, -0.0, 0.0, 49.0, 1e300]
    values = odd + [float(rng.randrange(60)) for _ in range(40)] + [7.0] * 20
    rows = spark.createDataFrame([(i, v, m, "kept") for v in ("a", "b", "c", "none", None) for i, m in enumerate(values)], "i int, version string, meters double, points string")
    got = ranges.points(rows, "meters", table, "version", F.lit(4))
    assert got.columns == ["i", "version", "meters", "points", "score"] and joins(got) == []
    want = None
    for v in ("a", "b", "c", "none", None):
        known = [b for b in buckets.get(v, []) if b[0] is not None]
        part = rows.where(F.col("version").eqNullSafe(F.lit(v))).withColumn("score", places.distance_score(F.col("meters"), known, 4).cast("int"))
        want = part if want is None else want.unionByName(part)
    show = lambda df: sorted((r["version"] or "", r["i"], r["score"]) for r in df.collect())
    assert show(got) == show(want)
    assert ranges.points(rows.limit(0), "meters", table, "version").count() == 0
    assert {r["score"] for r in ranges.points(rows.where("meters = 7"), "meters", table.limit(0), "version").collect()} == {0}
