"""Every registered query against its SQL in DuckDB, on the smallest data."""

import os
import re
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql
from brightloom.plans.registry import QUERIES
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    """Equal rows, and no join without an equality key anywhere in the plan."""
    frames = []

    def remembered(session, folder):
        frames.append(QUERIES[name](session, folder))
        return frames[-1]

    verdict, _ = compare(spark, con, FOLDER, name, remembered, oracle_sql().get(name))
    assert verdict in ("", "equal but empty")
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry(spark).count() > 0


def test_filters_and_columns_reach_the_files(spark):
    plan = QUERIES["events_per_day"](spark, FOLDER)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(ts" in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", plan)


def test_queries_are_there_without_the_training_text_operators(tmp_path):
    """Neither the subpackage nor what it imports has to be installed."""
    code = (
        "import sys; sys.modules['{}'] = None\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) == len(e.oracle_sql()) == len(e.registry.QUERIES) > 100"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module in ("brightloom.llm", "public_tokenizers", "xxhash", "corpus_pipeline"):
        subprocess.run([sys.executable, "-W", "ignore", "-c", code.format(module)], cwd=root, check=True)
