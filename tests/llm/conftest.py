import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows (doc_id, text) as a table with columns whose names the operators use themselves."""

    def make(rows):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        return table.selectExpr(
            "*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars",
            "1 AS bucket", "2 AS start", "3 AS kept_id", "4 AS score",
        ).repartition(4)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, short and long texts, copies, near copies, shared passages, repeated words,
    a row given twice, and a row without id."""
    import random

    rng = random.Random(5)

    def prose(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    passage, base = prose(70), prose(120)
    edited = base.split()
    edited[60] = "other"
    rows = [
        (1, None), (2, ""), (3, "one"), (4, "one"), (5, "  \t\n"), (6, base), (7, base), (9, " ".join(edited)),
        (10, prose(30) + " " + passage + " " + prose(30)), (11, prose(9) + "\n" + passage.replace(" ", "  ")),
        (12, passage), (13, "la " * 300), (14, "la " * 301), (15, prose(6000)), (16, "é" * 150 + "ü" * 150),
        (17, "é" * 150 + "ß" * 150), (18, "Two WORDS"), (19, "two words"), (8, passage + " " + passage),
        (20, "a b c d"), (21, "a b c d e f g h i"), (22, "a b c d e f g h i j"), (None, base), (6, base),
    ]
    return rows
