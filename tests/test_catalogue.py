import pytest

from compare import same
from semloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    same(catalogue.queries()[name](spark, sf), sf, catalogue.oracle_sql()[name])


def test_policies_choose_different_plans(spark, sf):
    costs = {name: plan.cost for name, _, plan in catalogue.chosen_plans(spark, sf)}
    assert costs["min_cost"].cost < costs["max_quality"].cost and costs["max_quality"].quality > costs["min_cost"].quality
    assert len({(c.cost, c.quality) for c in costs.values()}) > 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
