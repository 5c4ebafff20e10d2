"""Every registered query with a DuckDB twin, both on the smallest tables; and the plans' shape."""

import glob
import os

import duckdb
import pytest

from cuespan.plans import all_queries  # noqa: F401
from cuespan.plans.registry import ORACLES, QUERIES
from tools.compare import canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


#: Queries that rightly find nothing in the smallest tables; tests/test_loops.py has cases for them.
NOTHING = {"concurrent_subjects"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))
    assert len(want) or name in NOTHING


@pytest.mark.parametrize("name", ["scene_words", "match_any_key", "caption_at", "scan_secrets", "pack_words", "score_rules"])
def test_no_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
