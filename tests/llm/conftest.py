import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, target string, kept string, size string"


def invented(rng, n, vocabulary=400):
    words = ["".join(rng.choice(["ba", "ke", "li", "mo", "nu", "è", "th", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(words))
        if rng.random() < 0.12:
            out[-1] += rng.choice([".", ".", "!", ".\n"])
    return " ".join(out)


def documents():
    """Originals, exact and near copies, shared passages, a very long text, nulls, empties, repeated rows, clashing columns."""
    rng = random.Random(5)
    texts = [invented(rng, rng.choice([1, 3, 6, 40, 120, 300])) for _ in range(60)]
    passage = invented(rng, 70)
    texts += [texts[10], texts[11], texts[12].upper()]
    for i in (13, 14, 15, 16):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [invented(rng, 30) + " " + passage + " " + invented(rng, 30) for _ in range(8)]
    texts += ["", " \t\n ", None, None, "x", "ab " * 400, "a" * 300, "a" * 260, "é" * 120, "one two three four", "one two three four five"]
    texts.append(invented(rng, 30000) + passage)
    rows = [(i * 3 % 101 if i < 101 else i, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[61]]
    return [(d, t, "en", f"s{d % 5}" if d % 7 else None, len(t) if t is not None else None, "x", "y", "z", None) for d, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return {(d, t) for d, t, *_ in documents()}
