from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string"
WORDS = {
    "en": "the of and to in that with from this river stone mountain walking quickly".split(),
    "de": "und der die das nicht eine schöne straße über größe fluß berge schnell".split(),
}


def sentence(rng: random.Random, lang: str, words: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def documents(spark):
    """Both languages, NULLs in every column, repeated rows, odd and long texts, and
    columns whose names clash with results."""
    rng = random.Random(7)
    rows = []
    for n in range(80):
        lang = "en" if n % 2 else "de"
        rows.append((n, sentence(rng, lang, 5 + n), lang, "s", 1, "clash", "clash"))
    long_text = " ".join(sentence(rng, "en", 40) for _ in range(400))
    rows += [
        (100, None, "en", None, None, None, None),
        (101, "", None, "s", 0, None, None),
        (102, " \t\n", "de", "s", 3, None, None),
        (103, "12 34 !!", "en", "s", 8, None, None),
        (104, long_text, "en", "s", None, None, None),
        (105, "x" * 5000, None, "s", None, None, None),
        (105, "x" * 5000, None, "s", None, None, None),
        (None, "the river and the stone", "en", "s", None, None, None),
        (106, "naïve İstanbul ﬁ 中文字 \x1c <|endoftext|> don't we'll", None, None, None, None, None),
        (107, rows[3][1], "en", "s", None, None, None),
        (108, rows[3][1], "en", "s", None, None, None),
        (109, rows[70][1] + " end", "de", "s", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
