import random

import pytest

WORDS = "the of and to in la der que thing stone river über été niño don't it's 42 3.14 A.B".split()


@pytest.fixture(scope="session")
def texts():
    """Random texts with every kind of white space, marks, accents, emoji and specials."""
    r = random.Random(7)
    atoms = [*WORDS, " ", "  ", "\n", "\t", ".", ",", "<|endoftext|>", "é", "\U0001f600", "日本", "-", "'s", "²", "\x1c"]
    made = ["".join(r.choice(atoms) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [None, "", " ", "\n", "a", "a" * 3000, "word " * 4000, "é" * 500, *made, made[3], made[3]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with a null id, and columns whose names operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1.5, 7) for i, t in enumerate(texts)]
    rows.append((None, "a text without an id", None, None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __text string, score double, fp long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
