"""Every query with an oracle equals its DuckDB SQL on the small fixture (sf0.001), exactly."""

import pytest

import __spark_entry__  # noqa: F401
from custlens.plans.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

MODEL_BACKED = {"latest_predictions"}  # needs the trained models: covered in test_models


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(k for k in ORACLES if k not in MODEL_BACKED))
def test_query_matches_oracle(spark, con, key):
    sp = QUERIES[key](spark, SF_SMALL).toPandas()
    dk = con.sql(ORACLES[key]).df()
    errs = compare(sp, dk)
    assert not errs, "\n".join(errs)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "recency", "frequency", "monetary", "avg_order_value",
                          "customer_lifetime_days", "purchase_frequency", "product_diversity"]
    assert set(oracle_sql()) <= set(queries())
