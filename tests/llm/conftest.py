import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    line = "this line stands in many documents"
    rows = [
        (1, f"alpha beta\n{line}\nomega", "b", 1), (2, f"gamma\n{line.upper()}  \nx", "a", 2), (3, f"{line}\n{line}\ndelta", None, 3),
        (4, None, "a", 4), (5, "", "b", 5), (6, "word " * 3000 + f"\n{line}", "c", 6), (6, "word " * 3000 + f"\n{line}", "c", 6),
        (None, f"{line}\nno id", "a", 7), (8, "short", None, 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
