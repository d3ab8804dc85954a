"""Every registered query of the reference's operators against its SQL in DuckDB."""

import pytest
from compare import connect, difference

from quarry.plans import registry
from quarry.plans.common import REGISTRY

registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_matches_sql(name, spark, sf_dir, con):
    f, sql = REGISTRY[name]
    assert difference(spark, con, f, sql, sf_dir) == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if not sql))
def test_runs(name, spark, sf_dir):
    assert REGISTRY[name][0](spark, sf_dir).count() > 0
