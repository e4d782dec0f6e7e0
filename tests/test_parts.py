"""Work is dealt to so many tasks that none grows with the input, and nothing is shuffled more often than needed."""

from sparkloom.operators import graphs as G
from sparkloom.plans import adapter, catalog


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(adapter, "TASK_ROWS", 10)
    assert adapter.parts(spark.range(95), spark.range(3)) == 10 and adapter.parts(spark.range(0)) == 1


def test_cost_by_feature_is_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    plan = catalog.queries()["cost_by_feature"](spark, sf)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_lines_are_not_expanded(spark, sf):
    plan = catalog.queries()["decision_quality"](spark, sf)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_communities_in_many_parts(spark, monkeypatch):
    """The labels do not depend on the parts."""
    edges = spark.createDataFrame([(i, (i * 7 + k) % 40, float(1 + (i + k) % 3)) for i in range(40) for k in range(3)], "src bigint, dst bigint, weight double")
    want = sorted(map(tuple, G.communities(edges).collect()))
    monkeypatch.setattr(G, "TASK_ROWS", 11)
    assert sorted(map(tuple, G.communities(edges).collect())) == want and len(want) == 40
