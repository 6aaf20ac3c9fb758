import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()
    return [dict(zip(("doc_id", "text", "lang", "source"), row, strict=True)) for row in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [
        (1, "", "en", "a", 0, "x", "y"), (2, None, None, None, None, None, None), (None, "one two three four five six", "en", "a", 1, "x", "y"),
        (3, "same words here", "en", "a", 1, "x", "y"), (3, "same words here", "en", "a", 1, "x", "y"), (4, "same words here", "de", "b", 1, "p", "q"),
        (5, "long text " * 30_000, "en", "b", 1, "x", "y"), (6, " \t\n ", "fr", "c", 1, "x", "y"), (7, "x" * 50_000, "fr", "é", 1, "x", "y"),
        (8, "<|endoftext|> 'two  blanks'", "fr", "é", 1, "x", "y"), (8, "other text with this id", "fr", "", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
