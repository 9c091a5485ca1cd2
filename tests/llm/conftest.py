import pytest


@pytest.fixture(scope="session")
def hard(spark):
    """Rows with nulls, empty and long texts, ties, repeats and clashing columns."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 4
    long = " ".join(f"w{i % 977}é" for i in range(30_000))
    rows = [
        (1, base, 0.5), (2, base + "tail words here", 0.5), (3, base, None), (3, base, None), (4, "", 1.0), (5, None, 1.0),
        (6, "   \n\t ", 1.0), (7, long, 1.0), (8, long + " end", 1.0), (9, "Zwei Wörter", 1.0), (10, "zwei wörter", 1.0),
        (11, "a", None), (12, "x" * 5000, None), (13, "x" * 5000, None), (14, "ab " * 700, None), (None, "no id at all", None),
        (None, base, None), (15, base.upper(), None), (2, "another text under an id used twice " * 9, None),
    ]
    schema = "doc_id bigint, text string, key double, sha string, kept boolean, first int, row string, label int"
    return spark.createDataFrame([(*r, "s", True, 1, "r", 2) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
