import random

import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def tokenizer():
    return TOKENIZER


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "The", "ou", "ing", "é", "sch", "re,"]) for _ in range(r.randint(1, 4))) for _ in range(words))


def messy():
    """(doc_id, text) with nulls, empty and long texts, repeated rows and equal texts."""
    long = prose(1, 9_000)
    return [
        (0, prose(2, 40)),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long),
        (5, prose(2, 40)),
        (6, "Ünïcödé ΑΣ <|endoftext|> x\x1cy 😀'S \x01 " + "z" * 500),
        (7, prose(3, 1)),
        (None, prose(4, 30)),
        (7, prose(3, 1)),
        *[(20 + k, prose(20 + k, 10 + 37 * k)) for k in range(25)],
    ]


@pytest.fixture(scope="session")
def documents(spark):
    """The messy rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src", len(t or ""), "x", 1.5, True) for i, t in messy()]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, piece string, fp double, kept boolean",
    )


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
