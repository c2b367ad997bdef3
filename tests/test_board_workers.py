"""Python workers of the linked boards' queries: a task starts one for each Python step of its stage, so these are what an executor's Python memory goes by."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR
from snapledger.plans.source_queries import QUERIES


def _most_steps(node) -> tuple[int, int]:
    """Python steps from a node of a plan down to where its stage begins, and the most of any stage below."""
    below = [_most_steps(node.children().apply(i)) for i in range(node.children().size())]
    here, other = sum(b[0] for b in below), max((b[1] for b in below), default=0)
    here += node.nodeName() == "ArrowEvalPython"
    return (0, max(here, other)) if node.nodeName().endswith("Exchange") else (here, other)


@pytest.mark.parametrize("name", ["board_jobvite", "board_teamtailor", "board_icims"])
def test_a_task_has_two_python_workers_at_most(spark, name):
    plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan()
    assert plan.nodeName() == "AdaptiveSparkPlan"
    assert 1 <= max(_most_steps(plan.initialPlan())) <= 2
