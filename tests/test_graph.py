"""Rules that raise, and graphs that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from pointloom.functions.cameras import eye_and_up
from pointloom.functions.columns import aggregate
from pointloom.operators import checks, graph, profile


def test_a_diamond_is_visited_once_and_a_cycle_ends(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    edges = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1), (5, 6), (6, 5), (7, 5)], "id int, parent int")
    got = sorted(tuple(r) for r in graph.closure(nodes, edges).where("node in (4, 5)").collect())
    assert got == [(4, 1, 2), (4, 2, 1), (4, 3, 1), (4, 4, 0), (5, 5, 0), (5, 6, 1)]
    assert {r.id for r in graph.cyclic(edges).collect()} == {5, 6, 7} and graph.cyclic(edges.where("id < 5")).count() == 0
    assert graph.closure(nodes.limit(0), edges).count() == 0 and graph.cyclic(edges.limit(0)).count() == 0


def test_rules_of_a_graph(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1)], "id int, frame int")
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 9), (1, 1)], "id int, parent int")
    got = {(r.id, r.rule) for r in graph.violations(nodes, edges, "frame").collect()}
    assert got == {(2, "repeated_id"), (3, "other_frame"), (3, "missing_parent"), (3, "many_parents"), (1, "cycle"), (2, "cycle"), (3, "cycle")}


def test_a_missing_quality_raises(spark):
    facts = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.1), (2, 0, 0.9), (2, 2, 0.1)], "view int, quality int, mse double")
    whole = profile.gains(facts.where("view = 1"), ["view"], "quality", "mse", [0, 1, 2])
    assert sorted((r.quality_from, r.quality_to, round(r.gain, 6)) for r in whole.collect()) == [(0, 1, 0.4), (1, 2, 0.4)]
    with pytest.raises(Exception, match="lacks a quality"):
        profile.gains(facts, ["view"], "quality", "mse", [0, 1, 2]).collect()
    assert [tuple(r) for r in profile.missing_qualities(facts, ["view"], "quality", [0, 1, 2]).collect()] == [(2, 1)]


def test_a_negative_weight_raises(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (4.0, 0.0), (3.0, 2.0)], "x double, w double")
    mean = aggregate("weighted_mean", F.col("x"), F.col("w"))
    assert rows.agg(mean.alias("m")).first().m == 2.0
    with pytest.raises(Exception, match="negative weight"):
        rows.withColumn("w", F.col("w") - 1).agg(mean.alias("m")).collect()


def test_ids_that_do_not_rise_raise(spark):
    row = spark.createDataFrame([("ids", 5, [1, 1], [0])], "kind string, n bigint, ids array<bigint>, mask array<int>")
    with pytest.raises(Exception, match="rise"):
        row.select(checks.decoded_index(F.col("kind"), F.col("n"), F.col("ids"), F.col("mask"))).collect()
    none = spark.createDataFrame([("dense", 0, [], [])], "kind string, n bigint, ids array<bigint>, mask array<int>")
    assert none.select(checks.decoded_index(F.col("kind"), F.col("n"), F.col("ids"), F.col("mask")).alias("x")).first().x == []


def test_columns_of_a_camera_matrix(spark):
    m = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0], [9.0, 10.0, 11.0, 12.0], [0.0, 0.0, 0.0, 1.0]],)], "m array<array<double>>")
    row = m.select(*(x.alias(n) for n, x in eye_and_up(F.col("m")).items())).first()
    assert (row.eye, row.up, row.forward) == ([4.0, 8.0, 12.0], [2.0, 6.0, 10.0], [3.0, 7.0, 11.0])
