import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id int, n_lines string, block string, shard string, data string, kept string, label string, id string"


def invented(seed, n=60):
    """Documents with copies, near copies, shared passages, repeated lines and secrets."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(k))
    passage, line = text(70), text(25).replace("\n", " ")
    docs = {}
    for i in range(1, n):
        kind = rng.randrange(7)
        if kind == 0 and docs:
            t = rng.choice(list(docs.values()))
        elif kind == 1 and docs:
            w = rng.choice(list(docs.values())).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = text(40) + passage + text(30)
        elif kind == 3:
            t = "\n".join([text(20), line, line.upper(), text(10), line + "x"])
        elif kind == 4:
            t = text(15) + ' password = "hunter2hunter2" ' + "AKIA" + "A1B2C3D4E5F6G7H8" + " é" + "0123456789abcdef" * 2
        else:
            t = text(rng.randint(1, 160))
        docs[i] = t
    return docs


def rows_of(docs, lang=lambda i: ("en", "de")[i % 2]):
    return [(i, t, None if i is None else lang(i), "src", None if t is None else len(t), 7, "x", "b", "s", "d", "k", "l", "i") for i, t in (docs.items() if isinstance(docs, dict) else docs)]


@pytest.fixture(scope="session")
def table(spark):
    """Function: documents of a dict or list of pairs, with further columns whose names clash."""
    return lambda docs: spark.createDataFrame(rows_of(docs), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    return invented(5)


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, short ones, a repeated row, a very long text, ties."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(None, "some words without an id here"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, long), (8, long), (9, "123 456 !!!"), (10, "x" * 30_000)]
