import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlake.llm import collocations, dialogue_repair, neighbour_graph, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def products(rows):
    """Nearest 20 of each usable row whose id is divisible by 20, by (score, id)."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    found = {}
    for i, v in usable:
        if i % 20 == 0:
            found[i] = sorted((-float(np.dot(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:20]
    return found


def test_nearest_of_a_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.5, 2)).tolist()) for i in range(90)]
    rows += [(100 + i, rows[20][1]) for i in range(30)] + [(200, [1.0, 2.0]), (201, [2.0, 0.5]), (220, None), (240, []), (260, [0.0] * 8), (280, [float("nan")] * 8), (300, [None] + [1.0] * 7), (None, [1.0] * 8), (320, [float("inf")] * 8), (340, [3.0])]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, node string, sims double").repartition(3)
    got = {}
    for r in sorted(neighbour_graph.nearest(frame, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: found for q, found in products(rows).items() if found}
    assert set(got) == set(want)
    for q, found in want.items():
        assert [g[0] for g in got[q]] == list(range(1, len(found) + 1))
        assert np.allclose([-s for s, _ in found], [g[2] for g in got[q]], rtol=0, atol=1e-12)
        if q != 20 and not 100 <= q < 130:
            assert [j for _, j in found] == [g[1] for g in got[q]]


def test_nearest_finds_nine_in_ten(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    want = products(rows)
    got = {}
    for r in queries.QUERIES["op11_nn_descent"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert sum(len(got[q] & {j for _, j in found}) for q, found in want.items()) >= 0.9 * 20 * len(want)


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbour_graph.nearest(empty, F.lit(True)).collect() == []


def conversations(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "u", "stranger"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Same text.", "a?\n ", "ende, ", "été.", "x" * 3000 + "."]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 5, 9, 30])):
            if rng.random() < 0.9:
                text = rng.choice(texts)
                rows.append((c, rng.choice([t, t * 3]) if c % 7 else None, rng.choice(roles), text if rng.random() < 0.5 else f"{text}{t}."))
    # at most one row a turn, but for equal rows
    once = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    rows = list(once.values())
    return rows + [r for r in rows if rng.random() < 0.1] + [(None, 1, "user", "Nobody."), (None, 2, "assistant", "Nothing.")]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(dialogue_repair, "CHUNK", chunk)
    rows = conversations(chunk, 90)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, key int, audit string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue_repair.repair(frame).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert set(got) == set(by)
    lines_of = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        *want, lines_of[c] = brute.repaired(own)
        assert got[c] == (*want, hashlib.sha256("\n".join(lines_of[c]).encode()).hexdigest()), (c, own)
    if chunk == 3:
        lines = {}
        for e in sorted(dialogue_repair.edits(frame).collect(), key=lambda e: e.position):
            lines.setdefault(e.conv_id, []).append(e)
        assert {c: "".join(e.edit for e in es) for c, es in lines.items()} == {c: g[6] for c, g in got.items() if g[6]}
        assert {c: [f"{e.role}:{e.text}" for e in es if e.edit != "D"] for c, es in lines.items()} == {c: lines_of[c] for c in lines}


def test_rules_are_products():
    """A compressed sequence gives what its symbols give one by one, and rules unfold to what they replaced."""
    grammar = dialogue_repair.Grammar()
    rng = np.random.default_rng(5)
    symbols = rng.choice(9, 400, p=[0.05, 0.35, 0.35, 0.05, 0.02, 0.06, 0.06, 0.01, 0.05]).astype(np.int64)
    bounds = np.array([0, 0, 130, 131, 400])
    for _ in range(4):
        now, at = grammar.compress(symbols, bounds)
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pairs, n = np.unique(np.stack([now[:-1], now[1:]])[:, of[:-1] == of[1:]], axis=1, return_counts=True)
        grammar.add(dialogue_repair.choose([(int(a), int(b), int(k)) for (a, b), k in sorted(zip(pairs.T.tolist(), n), key=lambda x: -x[1]) if k > 1]))

    def unfold(s):
        rules = list(itertools.chain(*grammar.rounds))
        return [s] if s < 9 else [x for part in rules[s - 9] for x in unfold(part)]

    now, at = grammar.compress(symbols, bounds)
    assert len(now) < 0.6 * len(symbols)
    for a, b, c, d in zip(bounds, bounds[1:], at, at[1:]):
        assert [x for s in now[c:d] for x in unfold(int(s))] == symbols[a:b].tolist()
        whole = plain = dialogue_repair.inserts()
        for s in now[c:d]:
            whole = dialogue_repair.product(whole, grammar.matrices[s])
        for s in symbols[a:b]:
            plain = dialogue_repair.product(plain, grammar.matrices[s])
        same = lambda m: [[e and (e[0], "".join(dialogue_repair.leaves(e[1]))) for e in row] for row in m]
        assert same(whole) == same(plain)


def test_repair_query_equals_brute_force(spark):
    import zlib

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in rows}
    for c, t, role, text in sorted(rows, key=lambda r: r[:2]):
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            by[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {}
    for c, own in by.items():
        *facts, lines = brute.repaired(own)
        want[c] = (*facts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_dialogue_repair"](spark, SF).collect()}
    assert got == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert dialogue_repair.repair(empty).collect() == [] and dialogue_repair.edits(empty).collect() == []


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_collocations_equal_brute_force(spark, monkeypatch, odd_texts, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(block)
    words = ["the", "old", "stone", "bridge", "of", "New", "York", "City", "é", "漢字", "a.b", "x"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in [*texts, *odd_texts, *["New York City never sleeps"] * 9]]
    frame = spark.createDataFrame([(t, g, 1, "k", 2.0) for g, t in rows], "text string, lang string, n int, phrase string, w1 double").repartition(3)
    got = collocations.mine(frame, least=4, top=25).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows, 4, 25))


def test_a_share_counts_a_phrase_in_one_scan(spark, monkeypatch):
    """Before, the last scan repeated every frequent word, pair and triple of each share next to the phrases of four words."""
    made = []

    def counting(self, function, schema, *args, **kwargs):
        out = whole(self, function, schema, *args, **kwargs)
        if self.columns == ["text", "lang"]:
            made.append(out.count())
        return out

    frame = spark.createDataFrame([("one two three four five", "en")] * 40, "text string, lang string").coalesce(1)
    whole = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", counting)
    found = collocations.frequent(frame).collect()
    assert made == [5 + 1, 4, 3, 2]  # five words and their language, four pairs, three triples, two of four
    assert sorted((r.words, r.n) for r in found) == [(0, 200)] + [(1, 40)] * 5 + [(2, 40)] * 4 + [(3, 40)] * 3 + [(4, 40)] * 2


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "x")], "text string, lang string")).collect() == []


def test_covering_is_exact():
    base = np.array([0, 1, 2, 4, 5, 30, 99, 101, 10**17 + 3], np.int64)
    assert collocations.covering(base).tolist() == [-(-80 * int(b) // 100) for b in base]
