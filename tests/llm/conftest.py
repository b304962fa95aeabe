import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __doc string, root string, set string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or (id, text, lang) rows, with further columns whose names the operators use inside."""

    def make(rows, **more):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
