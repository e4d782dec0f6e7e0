"""Graph operators read the edges that they are given once, not in every round."""

import pytest

from sparkloom.operators import graphs as G


@pytest.mark.parametrize("name", ["pagerank", "connected", "reachable", "shortest_paths"])
def test_edges_are_made_once(spark, name):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src bigint, dst bigint, weight double").mapInPandas(count, "src bigint, dst bigint, weight double")
    start = spark.createDataFrame([(0,)], "node bigint")
    found = getattr(G, name)(edges, start) if name in ("reachable", "shortest_paths") else getattr(G, name)(edges)
    assert found.count() == 13
    assert seen.value <= 4 * 12
