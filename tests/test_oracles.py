"""Every registered query of the engine against its SQL, at the smallest size."""

import pytest

from loomgraph.oracles import ORACLES
from loomgraph.queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, same, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["doc_id", "seq", "s", "p", "o", "confidence", "confidence_level"]
