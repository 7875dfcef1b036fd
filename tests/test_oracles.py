"""Every registered query against its SQL twin at the smallest scale; rows only where it has none."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert difference(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["video", "frame", "direction", "held"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_only_corpus_queries_lack_a_twin():
    """Those that SQL cannot express are tested against brute force beside their operators."""
    assert all(n.startswith("op") or n == "pipeline" for n in set(queries()) - set(oracle_sql()))
