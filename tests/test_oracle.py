"""Every registered query with SQL must give the rows that SQL gives."""

import pytest
from harness import DATA, compare

from tessera import plans
from tessera.plans.registry import ORACLE, QUERIES

plans.load()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(name, spark, duck):
    problem = compare(QUERIES[name](spark, DATA), duck, ORACLE[name])
    assert problem is None, f"{name}: {problem}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0
