"""Edges, reports and rules on their snapshots give the rows that their authors expect."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from codeloom.operators import rules
from codeloom.plans import engine_cases


@pytest.mark.parametrize("group", ["edge_", "report_", "rule_"])
def test_cases(spark, group):
    def run(name):
        return name, sorted(tuple(r) for r in engine_cases.QUERIES[name](spark, "").collect())

    with ThreadPoolExecutor(6) as threads:
        got = dict(threads.map(run, [n for n in engine_cases.QUERIES if n.startswith(group)]))
    want = {n: sorted(duckdb.connect().execute(engine_cases.ORACLES[n]).fetchall()) for n in got}
    assert {n: r for n, r in got.items() if r != want[n]} == {}


def test_every_rule_has_a_case(spark):
    rules.register_repeats()
    assert set(rules.RULES) - set(engine_cases.RULE_CASES) == {"shellcheck-runner"}  # a program that isn't here
