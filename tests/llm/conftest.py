from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone cloud leaf grain harbour window north paper signal matter garden copper engine lantern meadow thread".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


ODD_TEXTS = [None, "", "   ", "one", "a b c d", "Ünïcödé façade 漢字 🙂 ok", "x" * 5000, "word " * 3000, "tab\tand\nline\r\nbreaks \x00 nul", "…—!?"]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    rows = [(k if k else None, t, None if k % 3 else "en", None if k % 2 else "src", len(t or ""), 1, "n") for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (100, rows[5][1], "en", "src", 1, 2, "m")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, node string")
