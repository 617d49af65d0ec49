import json
import random

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, ties, repeats, long and unusual texts."""
    rng = random.Random(4)
    alphabet = "ab the  éñ漢\n\t0.1-▁😀ing#*$|<>"
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 160))) for _ in range(60)]
    words = [" ".join(rng.choice(["stone", "river", "light", "Night", "of", "x!"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    return [
        None, "", "   ", "\n\n", "one", "One two three four", "ONE two  three\tfour", "a b c d e", "a b c d e", "same line\nsame line\n\nsame line",
        "word " * 700, "x" * 30_000, "é" * 5_000, "漢字かな交じり文を書く" * 200, "null\x00byte", "<s> </s> <|endoftext|>", *mixed, *words, *words[:5],
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame of (doc_id, text) with extra columns whose names clash with the operators' own."""

    def make(texts, first=0):
        rows = [(first + i, t, "k", 1, "s", [1.5]) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n int, mark string, score array<double>")

    return make


def as_json(rows):
    return [json.loads(r) for r in rows]
