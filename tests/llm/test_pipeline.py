"""The corpus pipeline against a plain version in one process."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from rentlake.llm import labelled, packing, quality_knn, quality_rules, textbatch
from tests.llm import brute
from tests.llm.test_text_operators import check_pieces

SF = "/root/testdata/sf0.001"


def kept_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    training, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    space = quality_knn.fit(labelled.sample(training, labels, "quality", rows=quality_knn.ROWS_PER_CLASS), labelled.shares(labels, "quality"))
    space.share = 1.0
    model = quality_rules.fit(labelled.sample(training, labels, "quality"), labelled.shares(labels, "quality"))
    kept = []
    for i, text in docs:
        data, offsets = textbatch.flat(pa.array([text]))
        if quality_knn.vote(space, data, offsets)[0] < quality_knn.GOOD_FROM:
            continue
        n = brute.rule_counts(text)
        if n["n_words"] < 50 or 2 * n["n_repeat_words"] > n["n_words"] or not quality_rules.verdicts(model, quality_rules.KEEP_FROM, data, offsets)["kept"][0]:
            continue
        kept.append((i, text))
    sets = {i: brute.shingles(t) for i, t in kept}
    groups = brute.groups(sets, brute.alike_sets(sets))
    return {i: t for i, t in kept if groups[i] == i}


def test_pipeline_equals_plain_version(spark):
    want = kept_by_hand(spark)
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], {i: len(x) for i, x in ids.items()}, packing.Limits())
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert 50 < len(want) < 200


def test_stages_keep_the_columns(spark, odd_texts):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, None, "s", None, "k", [1], 3.5) for i, t in enumerate(odd_texts)] + [(None, "five words in a row " * 20, "en", "s", 1, "k", None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, mark array<int>, `a.b` double")
    more = documents.selectExpr("*", "'k' as key", "array(1) as mark", "1.5D as `a.b`").unionByName(odd)
    for docs in (more, more.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).schema == docs.schema
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert sorted({r["doc_id"] for r in pieces.collect()}, key=str) == sorted({r["doc_id"] for r in docs.collect()}, key=str)


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]


def test_library_stands_without_the_operators(tmp_path):
    """What is left without rentlake/llm and corpus_pipeline.py imports and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "config"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.copytree(root / "rentlake", tmp_path / "rentlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 160 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("where", ["corpus_pipeline.py", "rentlake/llm"])
def test_other_import_errors_are_not_hidden(tmp_path, where):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "config", "rentlake"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    broken = tmp_path / (where if where.endswith(".py") else f"{where}/__init__.py")
    broken.write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
