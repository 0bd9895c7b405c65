import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names an operator could use itself
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.DoubleType()),
])


def documents(spark, rows):
    """Rows (doc_id, text[, source]) as a documents table with clashing extra columns."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", None, "no", 9.0) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + str(g.randrange(50)) for _ in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, a long text, characters beyond 16 bits.
ODD = [
    (None, "row without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here"), (6, "same text here"),
    (7, prose(1, 300)), (7, prose(1, 300)), (7, "other text, same id"), (8, prose(2, 6000)), (9, "😀 naïve  ß x 𝔘nicode"), (10, "x" * 5000),
    (11, "a\nb\na\n\nb\n"), (12, "Same Text HERE"),
]


@pytest.fixture()
def odd(spark):
    return documents(spark, [(i, t, None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(ODD)])


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOCS)
