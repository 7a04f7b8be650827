import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, spans string, h string, words string"


def junk(row):
    """A row with further columns whose names the operators use inside."""
    return (*row, "x", "x", "x", "x", "x")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, one id with two texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [
        (None, "an orphan text without an id", "en", "s1", 5), (None, None, None, None, None), (1, None, "en", "s1", 0), (2, "", "de", "s2", 0), (3, " \n\t ", "fr", None, 4),
        (4, "one", "en", "s1", 3), (5, "One", "en", "s1", 3), (6, "a b", None, "s3", 3), (7, "same text here " * 40, "en", "s1", 600), (7, "same text here " * 40, "en", "s1", 600),
        (8, passage, "en", "s1", 1), (9, f"lead {passage} tail", "en", "s2", 1), (10, f"{passage} {passage}", "de", "s2", 1), (11, "first text of eleven " + passage[:40], "en", "s2", 1),
        (11, "second text of eleven", "en", "s2", 1), (12, " ".join(word() for _ in range(30_000)), "en", "s1", 1), (13, "x" * 50_000, "en", "s1", 1),
        (14, "line a\nline b\nline a\n\n  \nline a", "en", "s1", 1), (15, "é ü ß 日本語 😀 ▁mark ▁▁ a\x00b", "de", "s3", 1), (16, " nbsp wide \u0085 end", "de", "s3", 1),
        (17, "# $ % & | < > *** ### 12 34", "und", "s3", 1),
    ]
    rows += [(100 + i, passage if i % 3 else f"{passage} {word()}", "en", "hot", 300) for i in range(60)]
    return spark.createDataFrame([junk(x) for x in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
