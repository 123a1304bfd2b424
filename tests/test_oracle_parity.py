"""Every registered query against its DuckDB oracle (row count, columns,
order-insensitive value digest). Analyses at sf0.01 where their fixture
thresholds keep and drop groups; operator queries at sf0.001."""

import pytest

import __spark_entry__ as ent
from ledgerline.plans.catalog import HEADLINE, registry
from tests.conftest import SF001, SF01
from tools.check_oracle import _norm, digest

QUERIES = {name: e.build for name, e in registry().items()}
ORACLE = {name: e.oracle for name, e in registry().items()}
OPERATORS = [n for n in QUERIES if n not in HEADLINE]


def _compare(spark, con, name, sf_dir):
    sp = QUERIES[name](spark, sf_dir).toPandas()
    dk = con.sql(ORACLE[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert digest(sp) == digest(dk)
    return len(sp)


def test_every_query_has_an_oracle():
    assert all(ORACLE.values())
    assert set(QUERIES) <= set(ent.queries()) and set(QUERIES) <= set(ent.oracle_sql())


@pytest.mark.parametrize("name", HEADLINE)
def test_analysis_rows_come_in_the_order_of_the_oracle(spark, duck_sf01, name):
    sp = QUERIES[name](spark, SF01).toPandas()
    dk = duck_sf01.sql(ORACLE[name]).df()[list(sp.columns)]
    assert [tuple(map(_norm, r)) for r in sp.itertuples(index=False)] == [tuple(map(_norm, r)) for r in dk.itertuples(index=False)]


@pytest.mark.parametrize("name", HEADLINE)
def test_analysis_matches_oracle(spark, duck_sf01, name):
    assert _compare(spark, duck_sf01, name, SF01) > 0


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_matches_oracle(spark, duck_sf001, name):
    _compare(spark, duck_sf001, name, SF001)


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) == 16
    assert df.columns == ["seller_city", "seller_state", "total", "uq_orders_count", "avg_order_value", "price_sttdev"]
