"""Groups that items connect: only shared items enter the rounds, and what they connect stays one."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import components


def test_items_of_one_group_enter_no_round(spark, monkeypatch):
    entered = []
    monkeypatch.setattr(components, "connected_components", lambda edges: entered.append(edges.count()) or edges.select(F.col("a").alias("node"), F.col("b").alias("component")))
    own = spark.range(50).select((F.col("id") % 5).alias("a"), (F.col("id") + 1000).alias("b"))
    components.linked_groups(own)
    components.linked_groups(own.union(spark.createDataFrame([(3, 1001)], "a bigint, b bigint")))
    assert entered[0] == 0 and entered[1] == 2


def test_shared_items_connect(spark):
    pairs = spark.createDataFrame([(1, 70), (2, 70), (2, 71), (9, 71), (4, 80), (4, 81), (5, 90), (6, 90), (9, 9), (12, 9)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.linked_groups(pairs).collect()}
    assert {n: c for n, c in found.items() if n != c} == {2: 1, 9: 1, 12: 1, 6: 5}
