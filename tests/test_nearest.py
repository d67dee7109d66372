import math
import random

import pytest

from pointloom.operators.scenes import nearest_scale


def test_nearest_neighbours_however_far(spark):
    pick = random.Random(1)
    rows = [(i, *(pick.uniform(-1, 1) for _ in range(3))) for i in range(60)] + [(60, 900.0, -3.0, 4.0), (61, 0.0, 0.0, 77.0), (62, 0.05, 0.05, 0.05), (63, 0.05, 0.05, 0.05)]
    got = {r.id: (r.found, r.log_scale) for r in nearest_scale(spark.createDataFrame(rows, "id bigint, x double, y double, z double"), "id", ["x", "y", "z"], 0.1).collect()}
    for i, *a in rows:
        near = sorted(sum((p - q) ** 2 for p, q in zip(a, b)) for j, *b in rows if j != i)[:3]
        assert got[i] == (3, pytest.approx(math.log(math.sqrt(max(sum(near) / 3, 1e-7)))))
    two = nearest_scale(spark.createDataFrame(rows[:2], "id bigint, x double, y double, z double"), "id", ["x", "y", "z"], 0.1).collect()
    assert sorted((r.id, r.found) for r in two) == [(0, 1), (1, 1)]


def test_copies_of_a_place_count_without_pairs(spark):
    places = [(0.0, 0.0, 0.0)] * 40 + [(1.0, 0.0, 0.0)] * 2 + [(1.0, 2.0, 0.0), (9.0, 9.0, 9.0), (-0.0, 0.0, 0.5)]
    rows = [(i, *p) for i, p in enumerate(places)] + [(98, None, 0.0, 0.0), (99, float("inf"), 0.0, 0.0)]
    own = lambda some: spark.createDataFrame(some, "id bigint, x double, y double, z double")
    got = {r.id: (r.found, r.log_scale) for r in nearest_scale(own(rows), "id", ["x", "y", "z"], 0.1).collect()}
    assert len(got) == len(places)
    for i, a in enumerate(places):
        near = sorted(sum((p - q) ** 2 for p, q in zip(a, b)) for j, b in enumerate(places) if j != i)[:3]
        assert got[i] == (3, pytest.approx(math.log(math.sqrt(max(sum(near) / 3, 1e-7)))))
    twins = nearest_scale(own(rows[:2]), "id", ["x", "y", "z"], 0.1).collect()
    assert [r.found for r in twins] == [1, 1]
    assert not nearest_scale(own(rows[:1]), "id", ["x", "y", "z"], 0.1).collect() and not nearest_scale(own([]), "id", ["x", "y", "z"], 0.1).collect()
