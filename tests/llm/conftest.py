import pytest

ODD_ROWS = [
    (5, "Alpha beta gamma delta epsilon zeta eta theta.\nReleased under the MIT License.", "en", "s1", "k"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta.\nReleased under the MIT License.", "en", "s1", "k"),
    (7, "ALPHA beta gamma delta epsilon zeta eta theta.\nreleased under the MIT License.", "en", None, "k"),
    (2, None, "fr", "s1", None),
    (3, "", None, "s1", "k"),
    (4, "   \n\t 12 34 !!", "de", "s1", "k"),
    (None, "Élan vital à côté de la forêt, où l’été s’étire.", "fr", "s2", "k"),
    (9, "été " * 30_000, "fr", "s1", "k"),
    (10, "a", None, None, None),
    (11, "mail bob@example.com or 10.0.0.1, card 4539 1488 0343 6467", "en", "s1", "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, {}"


@pytest.fixture(scope="session")
def odd(spark):
    """Builds a table of odd rows with one more column of the given name, which may clash with an output column."""

    def build(extra="extra", rows=ODD_ROWS):
        return spark.createDataFrame(rows, SCHEMA.format(f"`{extra}` string")).repartition(3, "source")

    return build


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
