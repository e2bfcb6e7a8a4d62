"""Odd inputs that the operators' tests share."""

import random

import pytest

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\s>", "\\", "\n", "\t", " ", "  ", "　", "\xa0", "a", "the", "The", "é", "é", "ß", "İ", "Σ",
         "1", "42", "'s", "don't", "<|endoftext|>", "<|startoftext|>", "<|x", "🙂", "中文", "𝒳", ".", "!!", "$1", "\x1c", "\x85", "\x00", "\r\n"]


def odd_texts(n: int, seed: int = 1) -> list:
    """Texts of control strings, odd spaces and several scripts; null, empty,
    white space, repeated and very long ones among them."""
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(30_000))
    return [*out, None, "", "  \n", out[0], out[0], long, "x" * 50_000]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd texts with null and repeated ids and columns whose names clash."""
    rows = [(k if k % 17 else None, t, "x", 1.5, True) for k, t in enumerate(odd_texts(60), 1)] + [(3, "the same id", "y", 2.5, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, _text boolean").repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
