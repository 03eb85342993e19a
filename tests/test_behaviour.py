"""Window boundaries, ties and defaults of the behavioural features, and brute force on skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.behaviour import behaviour

HOUR, DAY = 3600, 86400


def one(df, txn):
    return df.where(F.col("txn_id") == txn).first()


@pytest.mark.parametrize(
    "gap, v1, v24, seconds",
    [
        (HOUR, 2, 2, 3600.0),
        (HOUR + 1e-6, 1, 2, 3600.0),
        (DAY, 1, 1, 86400.0),
        (DAY - 1e-6, 1, 2, 86400.0),
        (86_700, 1, 1, 86700.0),
        (86_700 + 1e-6, 1, 1, -1.0),
    ],
)
def test_window_edges(make_txns, gap, v1, v24, seconds):
    row = one(behaviour(make_txns([("a", "u", 0), ("b", "u", gap)])), "b")
    assert (row.txn_velocity_1h, row.txn_velocity_24h, row.seconds_since_last_txn) == (v1, v24, seconds)


def test_first_transaction(make_txns):
    row = one(behaviour(make_txns([("a", "u", 0)])), "a")
    assert (row.txn_velocity_1h, row.txn_velocity_24h, row.amount_mean_24h, row.amount_std_24h) == (1, 1, 0.0, 0.0)
    assert (row.amount_zscore, row.distinct_merchants_1h, row.distinct_merchants_24h) == (0.0, 1, 1)
    assert (row.seconds_since_last_txn, row.impossible_travel_flag) == (-1.0, 0)


@pytest.mark.parametrize(
    "amounts, mean, std, z", [((10, 20), 10.0, 0.0, 0.0), ((10, 20, 40), 15.0, 5.0, 5.0), ((0.1, 0.1, 0.1, 99), 0.1, 0.0, 0.0)]
)
def test_amounts(make_txns, amounts, mean, std, z):
    rows = [(f"t{i}", "u", i * 60, a) for i, a in enumerate(amounts)]
    row = one(behaviour(make_txns([r + ("m1", "IN", "d") for r in rows])), f"t{len(amounts) - 1}")
    assert (row.amount_mean_24h, row.amount_std_24h, row.amount_zscore) == (mean, std, z)


def test_merchants(make_txns):
    rows = [("a", "u", 0, 1, "m1", "IN", "d"), ("b", "u", 60, 1, "m1", "IN", "d"), ("c", "u", 120, 1, "m2", "IN", "d")]
    assert one(behaviour(make_txns(rows)), "c").distinct_merchants_1h == 2


@pytest.mark.parametrize("gap, flag", [(HOUR, 1), (HOUR + 1e-6, 0)])
def test_travel_edge(make_txns, gap, flag):
    rows = [("a", "u", 0, 1, "m1", "IN", "d"), ("b", "u", gap, 1, "m1", "US", "d")]
    assert one(behaviour(make_txns(rows)), "b").impossible_travel_flag == flag


def test_same_instant(make_txns):
    df = behaviour(make_txns([("a", "u", 0), ("b", "u", 0)]))
    a, b = one(df, "a"), one(df, "b")
    assert (a.txn_velocity_24h, b.txn_velocity_24h) == (1, 1)
    assert (a.seconds_since_last_txn, b.seconds_since_last_txn) == (-1.0, 0.0)


def brute_force(rows):
    out = {}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for i, (t, u, s, a, m, c, _) in enumerate(ordered):
        past = [r for r in ordered if r[1] == u and s - DAY < r[2] < s]
        hour = [r for r in past if r[2] >= s - HOUR]
        amounts = [r[3] for r in past]
        mean = sum(amounts) / len(amounts) if amounts else 0.0
        std = (sum((x - mean) ** 2 for x in amounts) / len(amounts)) ** 0.5 if len(amounts) > 1 else 0.0
        last = [r for r in ordered[:i] if r[1] == u]
        gap = s - last[-1][2] if last and s - last[-1][2] <= 86_700 else -1
        travel = int(gap >= 0 and last[-1][5] != c and gap <= HOUR)
        out[t] = (
            len(hour) + 1, len(past) + 1, round(mean, 4), round(std, 4),
            len({r[4] for r in hour} | {m}), len({r[4] for r in past} | {m}), float(gap), travel,
        )
    return out


@pytest.mark.parametrize("segment_rows", [10**9, 20])
def test_hot_user_equals_brute_force(make_txns, segment_rows):
    """A third of the rows are one user's; with ``segment_rows`` 20 that user is cut into segments."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(25)}"
        second = rng.randrange(0, 4 * DAY, 600)  # many ties and exact window edges
        rows.append((f"t{i:03d}", user, second, rng.randrange(1, 50) / 4, f"m{rng.randrange(6)}", rng.choice(["IN", "US"]), "d"))
    got = {
        r.txn_id: (
            r.txn_velocity_1h, r.txn_velocity_24h, round(r.amount_mean_24h, 4), round(r.amount_std_24h, 4),
            r.distinct_merchants_1h, r.distinct_merchants_24h, r.seconds_since_last_txn, r.impossible_travel_flag,
        )
        for r in behaviour(make_txns(rows), segment_rows=segment_rows).collect()
    }
    assert got == brute_force(rows)
