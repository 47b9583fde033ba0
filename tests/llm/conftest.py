"""Documents for the tests of this folder: the smallest table and, added to it, every odd case."""

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
# Columns with names that the operators use inside.
CLASHING = ("row", "id", "node", "text_", "word", "words", "set", "label", "score", "lang_pred", "hit_words", "repeated")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def odd_rows():
    sentence = "Of anntre erthnd, thlyre to the inea that esly ndstnd nter inor eringedwh hathre and onon thhahe "
    return [
        (90001, None, "en"),
        (90002, "", "en"),
        (90003, " \t\n ", None),
        (90004, "12 34 !!", "de"),
        (90005, sentence * 3000, "en"),
        (90006, "One two three", "en"),
        (90006, "One two three", "en"),
        (90007, "one TWO three", None),
        (None, "A row without an id, but with words of its own and no others", "en"),
        (90008, sentence * 9 + "tail one", "en"),
        (90009, sentence * 9 + "tail two", "en"),
        (90009, "The same id with another text of more than five words", "en"),
        (90010, "日本語のテキスト <|endoftext|> é x\x85y\x1cz  \n\n", "en"),
        (90011, "a" * 1500, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string")
    rows = rows.withColumns({"source": F.lit("odd"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="session")
def docs(spark, odd, tmp_path_factory):
    """All documents of the smallest table and the odd ones, with clashing columns."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns({c: F.lit(1) for c in CLASHING})
    path = str(tmp_path_factory.mktemp("docs"))
    given.unionByName(odd).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def listed(docs):
    """(doc_id, text) of all rows."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
