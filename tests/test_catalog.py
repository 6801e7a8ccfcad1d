"""Every query of the catalogue against its SQL."""

import pytest

from conftest import SF
from markbook import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, agree, name):
    agree(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])


def test_flagship_is_not_empty(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_names_of_oracles_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_edges_are_pairs_of_an_order(spark):
    import pandas as pd

    rows = pd.read_parquet(f"{SF}/lineitem.parquet")[["l_orderkey", "l_partkey"]].drop_duplicates()
    pairs = {(a, b) for _, g in rows.groupby("l_orderkey") for a in g.l_partkey for b in g.l_partkey if a < b}
    assert {tuple(r) for r in catalog.queries()["conflict_edges"](spark, SF).collect()} == pairs
