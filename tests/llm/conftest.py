"""Small tables for the operators; awkward ones hold nulls, empty and long texts, repeats and clashes."""

import pytest


@pytest.fixture(scope="session")
def make(spark):
    def table(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema)

    return table


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with null ids and texts, empty, blank and long texts, repeats, and clashing extra columns."""
    rows = [
        (1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"),
        (2, None, "b"), (3, "", "c"), (4, " \n\t ", None), (None, "lost words without an id", "d"),
        (5, "w" * 60_000 + " " + "é日本🙂 " * 3000, "e"), (6, "a", "f"), (6, "another text of the same id", "g"),
    ]
    spark.conf.set("spark.sql.caseSensitive", "true")
    made = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    made = made.selectExpr("doc_id", "text", "score", "'x' AS Text", "1 AS kept", "2 AS component_id", "3 AS path_")
    made = spark.createDataFrame(made.collect(), made.schema)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return made


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
