import random

import pytest

from millrace.llm.catalog import importable

WORDS = "the of and to in a is that for it was on are as with his they be at one have this from or had by".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, t string, h long, g long"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "é", "ing", "s", "中"]) for _ in range(n))


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared and periodic passages, nulls and empties, in no order of id."""
    rng = random.Random(seed)
    shared, base = prose(rng, 45), prose(rng, 120)
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            words = base.split()
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(rng, rng.randint(5, 60)) + "\n" + shared + "\n" + prose(rng, rng.randint(5, 60)))
        elif kind == 3:
            texts.append("ab cd " * rng.randint(5, 80))
        elif kind == 4:
            texts.append(rng.choice([None, "", " \n\t", "one", "three little words", "z" * 350]))
        elif kind == 5:
            texts.append("\n".join([shared] * 3 + [prose(rng, 30)]))
        else:
            texts.append(prose(rng, rng.randint(1, 200)))
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", "y", 1, 2) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with inner ones, in several partitions."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, and an id with two texts."""
    long = "a long enough text of many words that goes on and on so that windows of thirteen words and a hundred bytes fit in"
    return spark.createDataFrame(
        [(1, long), (1, long), (None, long), (None, None), (2, long), (3, "short"), (3, "other")], "doc_id long, text string"
    )
