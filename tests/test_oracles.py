"""Every registered query against its DuckDB statement at the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import compare  # noqa: E402
from sheafwork.plans import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return compare.duck_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches(spark, con, name):
    verdict, _ = compare.compare(spark, con, FOLDER, name)
    assert verdict.startswith(("ok", "rows")), verdict


def test_entry_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["source", "chunks"]
    assert df.count() > 0
