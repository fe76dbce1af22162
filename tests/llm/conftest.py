import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that helper columns might have: whoever has them must get them back as they were.
CLASHING = ("shard", "spans", "row", "key", "hash", "rank", "quality_score", "__key", "__h", "__t", "letters")


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    base, long = prose(120), prose(30_000)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " extra words here", None, "a", None), (4, "", "en", None, 0), (5, None, None, None, None),
        (6, long, "de", "b", 5), (7, "one two", "en", "b", 7), (8, "One  TWO", "en", "b", 8), (9, "... !!! 123", "en", "b", 9), (None, base, "en", "a", 1),
        (10, prose(200), "en", "c", 2), (10, prose(200), "en", "c", 2), (11, "x" * 50_000, "fr", "c", 2), (12, " \n\t ", "fr", "c", 3), (13, "a\nb\na\n" + prose(40), "fr", "c", 4),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*x, *["mine"] * len(CLASHING)) for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
