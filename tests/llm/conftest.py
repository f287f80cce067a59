from __future__ import annotations

import random

import pytest

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "é"]


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def prose(rnd: random.Random, n_lines: int, per_line: int = 12) -> str:
    return "\n".join(" ".join(words(rnd, per_line)) + "." for _ in range(n_lines))


def edited(rnd: random.Random, text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = words(rnd, 1)[0] + "x"
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, source): prose, copies, near copies of copies, shared
    passages, nulls, empty and blank texts, one long text, repeated rows."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(1, 9)) for _ in range(60)]
    base = prose(rnd, 14)
    shared = prose(rnd, 4)
    texts += [base] * 5
    texts += [edited(rnd, base, rnd.randint(1, 6)) for _ in range(40)]
    texts += [edited(rnd, texts[-1], 1), edited(rnd, texts[-2], 2)]
    texts += [texts[k] + "\n" + shared for k in range(12)]
    texts += [prose(rnd, 2) + "\n\n" + shared + "\n" + prose(rnd, 1) for _ in range(8)]
    texts += ["a a a a a a a a a a " * 30, "DON'T!!! " * 40, "#$% " * 50, "x | y | z\n" * 12, "one two", "one two", "One Two"]
    texts += [None, "", "", " \n\t\n ", "\n", prose(rnd, 900), "Übergrößen 😀 日本 " * 20]
    rows = [(k, t, None if k % 17 == 0 else f"s{k % 5 if k % 3 else 0}") for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (3, "other text of the same id, which has more words than five", "s1"), (None, "text without id", None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with names that operators use."""
    schema = ("doc_id long, text string, source string, lang string, n_chars long, key long, n int, cls string, "
              "bucket int, v double, runs string, size long, target string, taken int, score string")
    rows = [(*r, "en", len(r[1] or ""), 1, 2, "c", 3, 0.5, "r", None, "t", 4, "s") for r in corpus]
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
