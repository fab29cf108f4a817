"""Every registered query of the document operators against its SQL."""

import pytest

from oracle import check
from quirework import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    check(spark, name, QUERIES[name], SQL.get(name))


def test_every_sql_has_its_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "n_lines", "n_words", "mean_conf", "text_left_pt", "text_bottom_pt"]
