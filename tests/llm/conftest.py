import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallybook.session import build_session
    s = build_session("local[*]", 8)
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and wordless texts, repeats, ties, a long text, clashing extra names."""
    long = " ".join(f"word{i % 977} other{i % 31}." for i in range(30_000))
    rows = [(1, "The quick brown fox. Jumps over\nthe lazy dog.", "en", "a"), (1, "The quick brown fox. Jumps over\nthe lazy dog.", "en", "a"),
            (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None), (None, "the QUICK brown fox. Jumps over\nthe lazy dog.", None, None),
            (None, None, None, None), (5, long, "en", "a"), (6, long, "en", "b"), (7, "Ärger über 中文 !!! 123", "de", "c"), (8, "x", "en", "a")]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
            .selectExpr("*", "length(text) as n", "'z' as row", "1 as component", "2 as piece", "3 as place", "'k' as key", "0 as h"))


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
