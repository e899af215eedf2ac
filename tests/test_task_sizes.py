"""Rows of facts and trades are dealt to tasks by their number, so that a task's memory doesn't grow with the input."""

import re

import pytest

from tidepanel.plans.all import QUERIES
from tidepanel.sources import panels

SMALL = "/root/testdata/sf0.001"
#: Query: the shuffles by number that it has at least.
SHUFFLES = {
    "join_05_version_snapshot": 3, "dq_06_reconciliation": 3, "ca_02_dated_splits": 1, "ca_03_dividend_claims": 1, "dq_06_expected_facts": 3, "dq_04_causality_contract": 5, "fd_07_08_derived_fields": 2, "fd_09_transformation_log": 2,
}


@pytest.mark.parametrize("name", SHUFFLES)
def test_more_rows_get_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(panels, "TASK_ROWS", 100)
    n = -(-panels.read(spark, SMALL, "lineitem").count() // 100)
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"Exchange hashpartitioning\([^\n]*, {n}\), REPARTITION_BY_NUM", plan)) >= SHUFFLES[name]
