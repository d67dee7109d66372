"""Queries that give every row or key its result, against brute force."""

import pytest

from pointloom.plans.registry import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "value").collect())


def test_closed_loop_of_all_users(spark, events):
    got = {(r.user_id, r.event_id): (r.q, r.decoded) for r in queries()["closed_loop_temporal"](spark, SF).collect()}
    want, user, decoded = {}, None, 0.0
    for u, e, value in events:
        decoded = 0.0 if u != user else decoded
        q = round((value - decoded) / 0.5)
        user, decoded = u, decoded + q * 0.5
        want[u, e] = (q, decoded)
    assert got == want and max(u for u, _ in got) > 20


def test_moving_average_of_all_users(spark, events):
    want = {}
    for u, _, value in events:
        want[u] = 0.4 * value + 0.6 * want.get(u, 0.0)
    got = {r.user_id: r.average for r in queries()["ema_fold"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(got) >= 30


def test_learning_rate_of_all_events(spark, events):
    assert sorted(r.event_id for r in queries()["learning_rate"](spark, SF).collect()) == sorted(e for _, e, _ in events)
