"""Every registered retrieval query agrees with its SQL on the smallest tables."""

import pytest

from textloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(compare, name):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).limit(3).collect()
    assert [(r.doc_id, r.score) for r in rows] == [(77, 2.140885), (185, 2.096446), (106, 2.072322)]
