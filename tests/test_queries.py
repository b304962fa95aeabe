"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from workload import cleaning, files, flows, lags, manifests, pixels, registry, sampling, scores, spatial  # noqa: F401
from workload.check import connect, differences

SMALL = "/root/testdata/sf0.001"
WITHOUT_SQL = {"multiscale_table"}  # its parts have SQL
OWN = tuple(f"workload.{m}" for m in ("cleaning", "files", "flows", "lags", "manifests", "pixels", "sampling", "scores", "spatial"))
# Queries of this part of the library; those of other packages are tested beside them.
QUERIES = {k: f for k, f in registry.QUERIES.items() if f.__module__ in OWN}
ORACLES = {k: registry.ORACLES[k] for k in QUERIES if k in registry.ORACLES}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES or name in WITHOUT_SQL, "every query needs SQL"
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry_registers_all(spark):
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
