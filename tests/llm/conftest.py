import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, and extra columns whose names operators use."""
    long = " ".join(f"word{i % 977} other{i}." for i in range(20000))
    body = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen. token = 'abcdefghijkl0123456789ab'"
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, " \n\t ", None, "b", 4), (4, long, "de", "a", len(long)), (5, body, "en", "b", len(body)), (5, body, "en", "b", len(body)),
        (6, body, "fr", "c", len(body)), (7, "x", "en", "", 1), (None, body + " more", "en", "c", 1), (9, "Ünï çödé\n\nzwei  drei vier", "de", "c", 20),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.selectExpr("*", "'s' AS size", "1 AS id", "2 AS bucket", "3 AS root", "4 AS length", "5 AS part", "'/p/' || doc_id || '/f.txt' AS path", "6 AS word", "7 AS kept", "8 AS n_words", *[f"{k} AS {c}" for k, c in enumerate(("_source", "_size", "_group", "_at", "_row", "_again", "_of_row", "_length", "key", "row", "number", "of", "rank", "n"))])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con
