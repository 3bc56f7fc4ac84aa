import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _spans string, _key int, _block string, _id string, _sha string, _gone int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) with further columns whose names the operators use inside."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "x", 7, "b", "i", "h", 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


LONG = " ".join(f"word{i % 977} end{i}." for i in range(20_000))


@pytest.fixture(scope="session")
def hard():
    """Null and empty texts, a null id, ties, repeated rows and a very long text."""
    return [
        (1, None), (2, ""), (3, "  \n\t "), (None, "A line of words here and there"), (4, "Alpha beta gamma, delta."), (5, "Alpha  beta gamma, delta."),
        (6, "Alpha beta gamma, delta."), (6, "Alpha beta gamma, delta."), (7, LONG), (8, "naïve café — 東京 👍🏽"), (9, "<|endoftext|> a <|endoftext|>"), (10, "x"),
    ]
