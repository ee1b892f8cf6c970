import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty and blank texts, a very long one, ties and repeated rows."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from here, " * 12
    rows = [
        (1, prose, "en", "a", len(prose)),
        (1, prose, "en", "a", len(prose)),
        (2, prose + "again", "en", "b", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "", 4),
        (6, "one two three", "en", None, 13),
        (7, "x" * 300_000 + " " + "wort " * 60_000, "de", "b", 1),
        (8, "12 34 !! 56", "en", "c", 11),
        (None, "der schnelle braune fuchs springt über den faulen hund", "de", "c", None),
        (9, "</s>[INST] <|endoftext|> ok [/INST] 中文 \U0001f600", "zh", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    return {doc: text or "" for doc, text in rows}
