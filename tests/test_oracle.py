"""Every query of the reference's operators against its SQL on the smallest tables."""

import pytest

import graincask.plans  # noqa: F401
from graincask import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect()
