"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

from check_oracle import connect, rows_of
from plumbline.plans import ORACLES, QUERIES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        assert mine == rows_of([c[0] for c in result.description], result.fetchall())
