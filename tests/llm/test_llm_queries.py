"""Every query of the subpackage against its SQL where it has one; all must run."""

import pytest
from conftest import same

from graphweir.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, small, name):
    same(QUERIES[name](spark, small), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "graphweir"
    assert not [p for p in root.rglob("*.py") if root / "llm" not in p.parents and "graphweir.llm" in p.read_text()]
