"""Every query of the catalogue beside its SQL, on the smallest tables."""

import os

import pytest
from compare import connect, differences

from lodestone.plans.registry import load

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(load()))
def test_matches_sql(spark, duck, name):
    assert differences(spark, duck, name, FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "category", "originality"]
