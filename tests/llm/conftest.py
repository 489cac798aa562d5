import pytest

# Columns beside doc_id and text, with names that operators use inside.
EXTRA = "row long, block long, shard long, f0 long, node long, key string, pii string, ids string, severity string, n_chars int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    long = " ".join(f"word{i * 7919 % 5000} and" for i in range(40_000))
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "another text under the same id"), (2, None), (3, ""), (4, long), (5, long), (None, "a text without an id"), (None, None), (6, " \n\t "), (7, "Ünïcödé “quotes” 漢字 and 😀 emoji")]
    rows = [(d, t, *([0] * 5), "k", "p", "i", "s", len(t or "")) for d, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def docs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, text string")
