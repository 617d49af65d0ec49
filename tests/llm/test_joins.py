import math
import random

import duckdb
import numpy as np
import pytest

from compare import _rows
from rentlake.llm import components, embedding_dedup, lm_score, ngram_join, queries, url_filter
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLES[name])
    names = rel.columns
    assert set(names) <= set(df.columns)
    assert _rows(names, [tuple(r) for r in df.select(*names).collect()]) == _rows(names, rel.fetchall())


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, 1), (1, 3), (2, 9), (9, 3), (None, 4), (5, 6)]])
def test_components(spark, links):
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    whole = [p for p in links if None not in p]
    assert got == brute.groups({x for p in whole for x in p}, whole)


def near_copies(seed, n, words=60, changes=6):
    """Texts around one another: exact copies, near copies, shared passages, chains."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            own = base[:]
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        elif kind == 1:
            own = passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 14))]
        elif kind == 2:
            own = base[:]
        elif kind == 3:
            base = base[3:] + [rng.choice(vocabulary) for _ in range(3)]
            own = base[:]
        elif kind == 4:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        else:
            own = [rng.choice(vocabulary[:3]) for _ in range(rng.randint(4, 30))]
        texts.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_ngram_join_equals_brute_force(spark, frame, odd_texts, seed, monkeypatch):
    if seed % 2:  # frequent shingles take the way of the spare buckets
        monkeypatch.setattr(ngram_join, "FREQUENT", 4)
        monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 1 << 20)
    texts = near_copies(seed, 240) + odd_texts
    got = {r["doc_id"]: r for r in ngram_join.join(frame(texts).repartition(5)).collect()}
    sets = {i: brute.shingles(t) for i, t in enumerate(texts)}
    want = brute.groups(sets, brute.alike_sets(sets))
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_every_order_keeps_linked_sets():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 4 + 1)))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        codes = lambda x: (x % np.uint64(3)).astype(np.uint8)
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 75 * (len(a) + len(b) - both)
        assert ngram_join.alike((a, codes(a), len(a)), (b, codes(b), len(b))) == linked or len(b) == 0


def test_keep_one(spark, frame):
    texts = near_copies(9, 120) + [None, "", " "]
    docs = frame(texts).unionAll(frame(texts[:4])).unionAll(spark.createDataFrame([(None, texts[0], "k", 1, "s", None)], frame([]).schema))
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    sets = {i: brute.shingles(t) for i, t in enumerate(texts)}
    want = sorted(set(brute.groups(sets, brute.alike_sets(sets)).values()))
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_ngram_join_empty_and_null_ids(spark, frame):
    assert ngram_join.join(frame([])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, None), (7, "A b c"), (7, "A b c"), (3, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(rows).collect()), key=str)
    assert got == sorted([(None, 1, 7), (None, 0, None), (7, 1, 7), (7, 1, 7), (3, 0, 3)], key=str)


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12 + 1, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] * rng.uniform(0.5, 3) + rng.standard_normal(width) * rng.choice([0, 0.1, 0.3])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    out += [(n + k, v, label) for k, (v, label) in enumerate([
        (None, 1), ([], 1), ([0.0] * width, 1), ([float("nan")] * width, 1), ([float("inf")] + [1.0] * (width - 1), 1), ([None] + [1.0] * (width - 1), 1),
        (out[0][1], None), (out[0][1][:5], out[0][2]), (out[0][1][:5], out[0][2]), ([1e-30] * width, 2), ([1e30] * width, 2), ([-1e30] * width, 2),
    ])]
    return out


@pytest.mark.parametrize("element, block", [("float", 1024), ("double", 32)])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, element, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "RUN", 8)
    monkeypatch.setattr(embedding_dedup, "FAN", 3)
    rows = vectors(block, 600)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"vec_id bigint, embedding array<{element}>, label int, node string, n int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(df).collect()}
    usable = {i: v for i, v, label in rows if label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    label = {i: x for i, _, x in rows}
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in usable.items()}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    component = brute.groups([r[0] for r in rows], links)
    n = {i: sum(i in p for p in links) for i, _, _ in rows}
    assert got == {i: (n[i], component[i], component[i] == i) for i in component}


def test_embedding_dedup_empty_and_null_ids(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embedding_dedup.dedup(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [2.0, 0.0], 1)], schema)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(rows).collect())
    assert got == [("4", 1, 4, True), ("4", 1, 4, True), ("None", 0, None, True)]


# -- language models


def bigram_losses(texts, target, smoothing):
    """(target loss, background loss, tokens) of each text, counted in dicts."""
    from collections import Counter

    def model(rows):
        pairs, singles = Counter(), Counter()
        for words in rows:
            if words:
                singles["<start>"] += 1
            singles.update(words)
            pairs.update(zip(["<start>", *words], words))
        return pairs, singles

    split = [brute.SPACE.findall((t or "").translate(brute.LOWER)) for t in texts]
    models = [model([split[i] for i in target]), model(split)]
    size = [sum(v for k, v in singles.items() if k != "<start>") for _, singles in models]
    out = []
    for words in split:
        losses = []
        for (pairs, singles), scale in zip(models, (1, size[0] / size[1])):
            share = lambda w: (singles[w] * scale + 1) / (size[0] + lm_score.VOCABULARY)
            losses.append(sum(-math.log((pairs[a, b] * scale + smoothing * share(b)) / (singles[a] * scale + smoothing)) for a, b in zip(["<start>", *words], words)) / max(1, len(words)))
        out.append((losses[0], losses[1], len(words)))
    return out


@pytest.mark.parametrize("known_pairs", [1 << 17, 16])
def test_lm_scores_equal_brute_force(spark, frame, odd_texts, monkeypatch, known_pairs):
    monkeypatch.setattr(lm_score, "KNOWN_PAIRS", known_pairs)
    monkeypatch.setattr(lm_score, "HELD", 300)
    monkeypatch.setattr(lm_score, "HELD_ASKED", 200)
    texts = near_copies(3, 90) + odd_texts
    target = [i for i in range(len(texts)) if i % 3 == 0]
    docs = frame(texts).repartition(4)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, docs.where("doc_id % 3 = 0")).collect()}
    assert len(rows) == len(texts)
    for i, (target_loss, background_loss, n) in enumerate(bigram_losses(texts, target, lm_score.SMOOTHING)):
        got = rows[i]
        assert got["n_tokens"] == n
        assert (got["target_loss"], got["background_loss"]) == pytest.approx((target_loss, background_loss), rel=1e-6)
        assert got["score"] == pytest.approx(target_loss - background_loss, abs=1e-5)


@pytest.mark.parametrize("numbered", [2, 12, 40])
def test_rare_words_are_scored_exactly(spark, frame, odd_texts, monkeypatch, numbered):
    monkeypatch.setattr(lm_score, "NUMBERED", numbered)
    monkeypatch.setattr(lm_score, "KNOWN_PAIRS", 16)
    monkeypatch.setattr(lm_score, "HELD", 300)
    monkeypatch.setattr(lm_score, "HELD_ASKED", 200)
    texts = near_copies(4, 60) + odd_texts + ["once", "only here once more"]
    rows = lm_score.score(frame(texts).repartition(4), frame(texts).where("doc_id % 3 = 0")).collect()
    want = bigram_losses(texts, {i for i in range(len(texts)) if i % 3 == 0}, lm_score.SMOOTHING)
    for r in rows:
        target_loss, background_loss, n = want[r["doc_id"]]
        assert r["n_tokens"] == n and r["target_loss"] == pytest.approx(target_loss, abs=1e-5) and r["background_loss"] == pytest.approx(background_loss, abs=1e-5)


def test_words_beyond_the_numbered_ones_keep_their_pairs(spark, frame):
    """40,000 words of one text each; two rare ones follow each other only in the target."""
    filler = [" ".join(f"f{i} f{i}" for i in range(a, a + 1000)) for a in range(0, 40_000, 1000)]
    pair = ["zeta omega", "zeta", "omega", "omega zeta"]
    docs = frame([*filler, *pair])
    rows = {r["doc_id"]: r for r in lm_score.score(docs, docs.where("doc_id = 40")).collect()}
    n, entries, m = 80_006, 40_000 + 2 + 2, lm_score.SMOOTHING
    scale = 2 / n  # the background has the target's size
    share = (3 * scale + 1) / (2 + entries)
    want = -(math.log((2 * scale + m * share) / (44 * scale + m)) + math.log((1 * scale + m * share) / (3 * scale + m))) / 2
    assert rows[40]["background_loss"] == pytest.approx(want, abs=1e-5)
    assert rows[40]["score"] < rows[43]["score"]


def test_lm_scores_small_vocabulary_and_no_target(spark, frame):
    docs = frame(["a a a b b c", "a b", None, ""])
    known = lm_score.vocabulary(docs, "text", 2, size=4)
    assert len(known) == 2  # a and b; c is one of the other words
    rows = {r["doc_id"]: r for r in lm_score.score(docs, docs.limit(0)).collect()}
    assert [rows[i]["n_tokens"] for i in range(4)] == [6, 2, 0, 0]
    assert all(rows[i]["target_loss"] > rows[i]["background_loss"] for i in (0, 1)) and rows[2]["score"] == rows[3]["score"] == 0
    assert lm_score.score(frame([]), frame([])).count() == 0
    nulls = spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "x")], "doc_id bigint, text string")
    assert sorted((r["n_tokens"], r["doc_id"]) for r in lm_score.score(nulls, nulls).where("doc_id is not null").collect()) == [(1, 3)]
    assert lm_score.score(nulls, nulls).where("doc_id is null").count() == 2


def test_lm_scores_prefer_the_target(spark, frame):
    rng = random.Random(1)
    own, other = [[f"{c}{i}" for i in range(12)] for c in "st"]
    texts = [" ".join(rng.choice(own if i % 2 else other) for _ in range(80)) for i in range(60)]
    docs = frame(texts)
    rows = lm_score.score(docs, docs.where("doc_id % 2 = 1 and doc_id < 30")).collect()
    assert all((r["score"] < 0) == (r["doc_id"] % 2 == 1) for r in rows)


# -- URL filter


def test_url_filter_equals_brute_force(spark):
    import datetime as dt

    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "HOT.net"]
    at = lambda: start + dt.timedelta(hours=rng.randint(0, 40))
    captures = [(i, f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q?x=1', '//p/r#f'])}", at() if rng.random() < 0.95 else None) for i in range(300)]
    captures += [(300, None, start), (301, "no url", start), (302, "ftp://u@x.org:21/p", start + dt.timedelta(days=9)), (0, "https://x.org/p", start)]
    kinds = [("host", h.lower()) for h in hosts] + [("domain", d) for d in ("example.com", "a.example.com", "com", "net", "org")] + [("path", "x.org/p"), ("path", "hot.net/p/q"), (None, "x.org"), ("host", None)]
    entries = [(i, *rng.choice(kinds), rng.choice(["block", "allow", "remove", None]), at() if rng.random() < 0.97 else None, at() if rng.random() < 0.2 else None) for i in range(160)]
    got = url_filter.judge(
        spark.createDataFrame([(*c, "k") for c in captures], "page_id bigint, url string, fetched_at timestamp, pattern string").repartition(3),
        spark.createDataFrame(entries, "entry_id bigint, kind string, pattern string, action string, listed_at timestamp, expires_at timestamp"),
    ).collect()

    def want(url, fetched):
        import re

        match = re.match(r"(?i)[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", url or "")
        if not match or fetched is None:
            return "none", None, None
        host, path = match[1].lower(), [s for s in match[2].split("/") if s]
        labels = host.split(".")
        asked = [("host", host), *(("domain", ".".join(labels[i:])) for i in range(max(1, len(labels) - 1))), *(("path", "/".join([host, *path[:i]])) for i in range(1, len(path) + 1))]
        found = []
        for kind, pattern in asked:
            last = [e for e in entries if (e[1], e[2]) == (kind, pattern) and e[3] and e[4] and e[4] <= fetched]
            if last:
                e = max(last, key=lambda e: (e[4], e[0]))
                if e[3] != "remove" and (e[5] is None or e[5] > fetched):
                    found.append((url_filter.KINDS[kind], len(pattern), pattern, e[3], e[0]))
        return (max(found)[3], max(found)[2], max(found)[4]) if found else ("none", None, None)

    assert sorted(((r["page_id"], r["url"] or "", r["verdict"], r["pattern"], r["entry_id"]) for r in got), key=str) == sorted(((i, u or "", *want(u, f)) for i, u, f in captures), key=str)


def test_url_filter_without_rows(spark):
    captures = spark.createDataFrame([(1, "https://x.org/", None)], "page_id bigint, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "entry_id bigint, kind string, pattern string, action string, listed_at timestamp, expires_at timestamp")
    assert [tuple(r)[3] for r in url_filter.judge(captures, entries).collect()] == ["none"]
    assert url_filter.judge(captures.limit(0), entries).count() == 0
