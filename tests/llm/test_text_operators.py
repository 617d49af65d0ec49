import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rentlake.llm import license_scan, packing, quality_knn, quality_rules, sentencepieces, textbatch, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_words_and_hashes(odd_texts):
    data, offsets = textbatch.flat(pa.array(odd_texts))
    starts, ends, bounds = textbatch.words(data, offsets)
    hashes = textbatch.span_hash(textbatch.byte_prefix(data), starts, ends)
    found = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    want = [brute.SPACE.findall(t or "") for t in odd_texts]
    assert [len(w) for w in want] == np.diff(bounds).tolist()
    assert [w.encode() for row in want for w in row] == found
    assert len(set(hashes.tolist())) == len(set(found))


def test_flat_of_a_slice():
    texts = pa.array(["no", "yes", None, "well"]).slice(1)
    data, offsets = textbatch.flat(texts)
    assert bytes(data) == b"yeswell" and offsets.tolist() == [0, 3, 3, 7]


def test_slices_cover_all_rows(odd_texts):
    batch = pa.record_batch([pa.array(range(len(odd_texts))), pa.array(odd_texts)], ["key", "text"])
    parts = list(textbatch.slices(iter([batch]), size=500))
    assert [k for rows, _, _ in parts for k in rows.column(0).to_pylist()] == list(range(len(odd_texts)))
    assert b"".join(bytes(d) for _, d, _ in parts) == "".join(t or "" for t in odd_texts).encode()


# -- pieces


def test_pieces_equal_the_library(odd_texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = sentencepieces.Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in odd_texts]
    ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(texts, add_bos=True, add_eos=True)


def test_heap_and_matrix_agree(odd_texts):
    own = sentencepieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("international", "▁▁▁▁▁▁▁▁▁▁▁", "Straßenbahnhaltestelle", "aaaaaaaaaaaaaaaaaaaaaaaa"):
        symbols = own.of_char[[ord(c) for c in text]]
        rows, lengths = own.encode_rows(symbols[None, :].copy())
        assert rows[0, : lengths[0]].tolist() == own.encode_long(symbols).tolist()


def test_pieces_query(spark, frame, odd_texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r["doc_id"]: r for r in sentencepieces.encode(frame(odd_texts), path).collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids"] == ids
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        if "▁" not in (text or ""):  # a word mark spelled out comes back as a blank
            assert rows[i]["decoded"] == (text or "")
    assert sentencepieces.encode(frame([]), path).count() == 0


def test_pieces_refuse_other_vocabularies(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.Vocabulary(str(tmp_path / "other.model"))


# -- licences


@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", ("MIT", ["mit"], 0.1)),
        ("MIT OR GPL-3.0-only", ("MIT OR GPL-3.0-only", ["gpl-3", "mit"], 0.1)),
        ("MIT AND GPL-3.0-or-later", ("MIT AND GPL-3.0-or-later", ["gpl-3", "mit"], 0.7)),
        ("MIT OR Apache-2.0 AND GPL-2.0+", ("MIT OR Apache-2.0 AND GPL-2.0+", ["apache-2", "gpl-2", "mit"], 0.1)),
        ("(MIT or Apache-2.0) and GPL-2.0+ */", ("( MIT or Apache-2.0 ) and GPL-2.0+", ["apache-2", "gpl-2", "mit"], 0.7)),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR AGPL-3.0", ("GPL-2.0 WITH Classpath-exception-2.0 OR AGPL-3.0", ["agpl-3", "gpl-2"], 0.35)),
        ("MIT OR", ("MIT", ["mit"], 0.1)),
        ("MIT see file", ("MIT", ["mit"], 0.1)),
        ("(MIT", None),
        ("OR MIT", None),
        ("MIT WITH a WITH b", ("MIT WITH a", ["mit"], 0.05)),
        ("(MIT) WITH a", ("( MIT )", ["mit"], 0.1)),
        ("", None),
        ("Own-1.0", ("Own-1.0", ["own-1"], 0.6)),
        ("CC-BY-NC-4.0", ("CC-BY-NC-4.0", ["cc-by-nc"], 0.9)),
    ],
)
def test_expressions(text, want):
    got = license_scan.evaluate(text)
    assert got == want if want is None else (got[0], got[1], pytest.approx(got[2])) == (want[0], want[1], want[2])


def test_licence_scan(spark, frame, odd_texts):
    texts = [
        *odd_texts, "Released under the MIT License. under,the;mit-license", "cc by nc cc by nc", "Apache License, Version 2.0; APACHE license version 2",
        "// SPDX-License-Identifier: MIT OR GPL-2.0-only\nint x;", "spdx license identifier without a colon", "x SPDX-License-Identifier: (\nSPDX-License-Identifier: ISC",
        "under the mité license", "GNU Affero General Public License",
    ]
    rows = {r["doc_id"]: r for r in license_scan.scan(frame(texts)).withColumn("score", license_scan.burden()).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n, places = brute.license_places(text, license_scan.BASE_PHRASES)
        assert rows[i]["n_words"] == n
        assert sorted((m["first_word"], m["label"]) for m in rows[i]["matches"] if m["kind"] == "base") == places
        notices = brute.license_places(text, license_scan.NOTICES)[1]
        assert sorted((m["first_word"], m["label"]) for m in rows[i]["matches"] if m["kind"] == "notice") == notices
        assert 0 <= rows[i]["score"] <= 1
    tags = [[e["labels"] for e in rows[len(odd_texts) + k]["expressions"]] for k in (3, 4, 5)]
    assert tags == [[["gpl-2", "mit"]], [], [["isc"]]]
    assert rows[0]["score"] == 0 and rows[len(texts) - 1]["score"] == 0.8
    assert license_scan.scan(frame([])).count() == 0


# -- quality rules


def test_rule_counts(spark, frame, odd_texts):
    rows = {r["doc_id"]: r for r in quality_rules.judge(frame(odd_texts), table(spark, "documents"), table(spark, "labels")).collect()}
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        want = brute.rule_counts(text)
        assert {k: rows[i][k] for k in want} == want, (i, text)
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert rows[i]["base_failed"] == failed and not (failed and rows[i]["kept"])
        assert rows[i]["kept"] == (not failed and rows[i]["probability"] >= quality_rules.KEEP_FROM)


def test_rules_without_labels(spark, frame):
    none = table(spark, "labels").limit(0)
    texts = [" ".join(f"w{i}" for i in range(60)), "short"]
    rows = quality_rules.judge(frame(texts), frame(texts), none).orderBy("doc_id").collect()
    assert [(r["probability"], r["kept"]) for r in rows] == [(1.0, True), (1.0, False)]
    kept = quality_rules.keep(frame(texts), frame(texts), none)
    assert kept.columns == frame(texts).columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_rules_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = quality_rules.judge(docs, docs, labels.where(~aside)).join(labels, "doc_id").where(aside).collect()
    long = [r for r in rows if not r["base_failed"]]
    clean, junk = ([r["kept"] for r in long if r["quality"] == q] for q in (1, 0))
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) <= 0.1 * len(junk) and len(junk) > 30


# -- voting and toxicity


def test_voting_held_out(spark):
    from rentlake.llm.queries import QUERIES, held_out

    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_quality_knn"](spark, sf).join(table(spark, "labels", sf), "doc_id").where(held_out(4, 2)).collect()
    clean, junk = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.05 * len(junk)
    assert all(r["held_out"] and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    from rentlake.llm.queries import QUERIES, held_out

    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op10_toxicity"](spark, sf).join(table(spark, "labels", sf), "doc_id").where(held_out(5, 0)).collect()
    clean, toxic = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (0, 1))
    # 350 toxic rows to learn from, of which some share no part with these; with 1,700 it is 0 of 3,634 and 427 of 427
    assert sum(clean) <= 0.04 * len(clean) and sum(toxic) >= 0.85 * len(toxic)


@pytest.mark.parametrize("module, label", [(quality_knn, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_texts(spark, frame, odd_texts, module, label):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = module.classify(frame(odd_texts), docs, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(odd_texts)))
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(odd_texts[r["doc_id"]] or "", r["score"]) == pytest.approx(r["score"], abs=1e-5)
    assert module.classify(frame([]), docs, labels).count() == 0
    assert {r["score"] for r in module.classify(frame(["a", None]), docs, labels.limit(0)).collect()} == {0.5 if module is quality_knn else 0.0}


def test_votes_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    rows = [(i, t, i % 3 % 2) for i, t in docs[:90]]
    space = quality_knn.fit(rows)
    data, offsets = textbatch.flat(pa.array([t for _, t in docs]))
    got = quality_knn.vote(space, data, offsets)
    for k in range(0, len(docs), 7):
        one = quality_knn.term_counts(*textbatch.flat(pa.array([docs[k][1]])))
        v = (np.log1p(one) * space.weight)[0] @ space.basis
        near = space.vectors @ (v / np.linalg.norm(v))
        top = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        alike = np.maximum(near[top], 0) ** 4
        assert got[k] == pytest.approx(float(alike @ space.labels[top] / alike.sum()), abs=1e-3)


def test_misspellings_share_parts():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abdeghiklmnoprstuvw"), 6)) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(words, 20), *bad])
    rows = [(i, text(["wretchedly"] if i % 2 else []), i % 2) for i in range(300)]
    model = toxicity.fit(rows)
    data, offsets = textbatch.flat(pa.array([text(["wretchhedly"]), text([])]))
    score, where = toxicity.scores(model, data, offsets)
    assert score[0] > 0.5 > score[1] and where[0] == 18


def test_toxicity_equals_brute_force(spark, frame, odd_texts):
    """The score of a text is that of its best window, from whichever word on."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abdeghiklmnoprstuvwé"), rng.integers(1, 40))) for _ in range(60)]
    bad = words[:6]
    line = lambda n, pool: " ".join(rng.choice(pool, n))
    rows = [(i, line(12, words[6:]) + (" " + line(2, bad) if i % 2 else ""), i % 2) for i in range(120)]
    model = toxicity.fit(rows)
    texts = [line(n, words) for n in range(9)] + [*odd_texts, rows[1][1], rows[1][1]]

    def parts(word):
        data = np.frombuffer(word, np.uint8)
        return toxicity.word_parts(data, np.array([0]), np.array([len(data)]))[0].tolist()

    def brute(text):
        found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode("utf-8", "replace").lower())
        numbers = [parts(w) for w in found]
        means = []
        for i in range(max(1, len(found) - toxicity.WINDOW + 1)) if found else ():
            values = [float(model.parts[p]) for w in numbers[i : i + toxicity.WINDOW] for p in w]
            means.append(sum(values) / len(values))
        best = max(means, default=0.0) + model.bias
        return 1 / (1 + np.exp(-np.clip(best, -30, 30))), means

    short = [t for t in texts if len(t or "") < 20000]
    data, offsets = textbatch.flat(pa.array([t or "" for t in short], pa.string()))
    score, where = toxicity.scores(model, data, offsets)
    for text, one, at in zip(short, score, where):
        expected, means = brute(text)
        assert one == pytest.approx(expected, abs=1e-5), text
        assert means[at] == pytest.approx(max(means), abs=1e-5) if means else at == -1, text  # equal windows: any of them
    # a word in front moves the window and nothing else
    moved, _ = toxicity.scores(model, *textbatch.flat(pa.array([f"{words[7]} {rows[1][1]}", f"{words[7]} {words[8]} {rows[1][1]}"])))
    assert (moved > 0.5).all()


# -- packing


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 64), packing.Limits(100, 1000, 40), packing.Limits(256, 3, 256)])
@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_packer(limits, n):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 700, n)
    packer = packing.Packer(limits, 5, pool=50)
    pieces = [*packer.add(list(range(n)), tokens, tokens), *packer.close()]
    check_pieces(pieces, dict(enumerate(tokens.tolist())), limits)


def check_pieces(pieces, tokens, limits):
    by_example, by_sequence = {}, {}
    for example, start, length, sequence, offset in pieces:
        by_example.setdefault(example, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert {k: n for k, n in tokens.items() if n} == {k: sum(x[1] for x in v) for k, v in by_example.items()}
    for parts in [*by_example.values(), *by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
    for parts in by_sequence.values():
        assert sum(x[1] for x in parts) <= min(limits.tokens, limits.loss) and len(parts) <= limits.segments
    return by_sequence


def test_packer_respects_loss_apart_from_tokens():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 60, 400)
    loss = np.minimum(tokens, rng.integers(0, 40, 400))
    limits = packing.Limits(128, 6, 50)
    packer = packing.Packer(limits, cut=False, powers=False)
    pieces = [*packer.add(list(range(400)), tokens, loss), *packer.close()]
    sequences = {}
    for example, start, length, sequence, _ in pieces:
        assert start == 0 and length == tokens[example]
        sequences.setdefault(sequence, []).append(example)
    assert sorted(e for v in sequences.values() for e in v) == list(range(400))
    for v in sequences.values():
        assert tokens[v].sum() <= 128 and len(v) <= 6 and loss[v].sum() <= 50


def test_packing_query(spark, frame, odd_texts):
    docs = frame(odd_texts).repartition(3)
    rows = packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(odd_texts)}
    pieces = [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows]
    sequences = check_pieces(pieces, {k: len(v) for k, v in ids.items()}, packing.Limits())
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for parts in sequences.values():
        n = sum(x[1] for x in parts)
        assert n & (n - 1) == 0  # no padding at all
    assert packing.pack_texts(frame([]), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


@pytest.fixture(scope="module")
def encoders():
    """The operator's encoder and the library's, for the same vocabulary."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    return packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), lambda t: library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\u3000"])
def test_very_long_white_space(encoders, space):
    own, library = encoders
    for text in (f"a{space * 1_000_100}b c", f"{space * 1_000_100} !", f"a  b\n{space * 1_000_100}"):
        assert own(text).tolist() == library(text)


@pytest.mark.parametrize("long", [1, 2, 3, 7])
def test_cut_out_white_space(encoders, monkeypatch, long):
    own, library = encoders
    monkeypatch.setattr(packing, "LONG_SPACE", long)
    rng = np.random.default_rng(long)
    for _ in range(400):
        text = "".join(rng.choice(list("a1!' \n\t\x0b\x1c\x85\xa0\u2003\u180e\u200b\u3000 é漢"), 40))
        assert own(text).tolist() == library(text)
