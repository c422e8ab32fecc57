import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators might use themselves.
    T.StructField("_id", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
])
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string, host string, rate string, _row string"

PROSE = "the river ran past the old mill and the children watched the water turn the wheel all day long"


def rows_of(texts, first=1):
    """Documents with ids from ``first`` on and awkward extra columns."""
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def hard_docs(make_docs):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"{PROSE} {i}" for i in range(3000))
    rows = rows_of([PROSE, PROSE, " " + PROSE + "\n", "", None, " \t\n", long, long + " end", "one two three", "é　x ￿ 😀 ▁ \x00"])
    rows += [rows[0], rows[3], (None, PROSE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(40, PROSE + " x", None, "s1", 1, None, None, None), (41, PROSE + " x", "fr", None, 1, None, None, None)]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
