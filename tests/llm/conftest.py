import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30, 80]))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(text)]
    rows += [(100 + i, text[2], "en", "s0", 1) for i in range(30)]
    rows += [(200, None, "en", "s1", None), (201, "", None, "s1", 0), (202, " \t\n ", "en", None, 4), (None, text[3], "en", None, 9),
             (None, None, None, None, None), (203, text[5], "en", "s2", 1), (203, text[5], "en", "s2", 1), (203, text[6], "en", "s2", 1),
             (204, " ".join(rng.choice(words) for _ in range(20000)), "en", "s3", 7), (205, "solo", "en", "empty", 4),
             (206, None, "en", "blank", 0)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "1 AS size", "'x' AS shard", "2 AS slot", "3 AS copies", "4 AS score", "5 AS _place", "6 AS _words", "7 AS node",
        "8 AS row_key", "9 AS key", "10 AS _position", "'y' AS label", "11 AS target", "12 AS source_size")
    return frame.repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
