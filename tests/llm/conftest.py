"""A small table of documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", prose(20) + " " + passage, passage + " " + prose(30), prose(5) + passage, passage]
    near = prose(120).split()
    for k in range(6):
        words = list(near)
        words[k * 7] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "", "   \n\t ", "one", "one two", "ünï çödé 日本語 😀 " * 8, "a" * 700, "ab " * 500, prose(3000), texts[3]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], (9, "another text of an id that is there", None, "s1", 35), (None, texts[3], None, None, None), (None, prose(12), "xx", "s2", 5)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
