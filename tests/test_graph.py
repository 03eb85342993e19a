"""Graph features against brute force, with and without busy entities."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import graph
from ledgerwatch.operators.behaviour import behaviour
from tests.conftest import BASE_US


def make_rows(n=300, seed=3):
    """A third of the rows on one device, another busy device, and small shared ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = f"u{rng.randrange(30)}"
        device = "hub" if i % 3 == 0 else rng.choice(["hub2"] * 2 + [f"s{rng.randrange(12)}", f"own_{user}"])
        rows.append((f"t{i:03d}", user, rng.randrange(0, 5000), 10.0, f"m{rng.randrange(8)}", "IN", device))
    return rows


def device_neighbours(rows, user, until=None):
    seen = [r for r in rows if until is None or r[2] <= until]
    mine = {r[6] for r in seen if r[1] == user}
    return {r[1] for r in seen if r[6] in mine} - {user}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_shared_devices(make_txns, seed):
    rows = make_rows(seed=seed)
    got = graph.shared_device_count(graph.build_edges(make_txns(rows))).collect()
    assert {r.user_id: r.shared_device_count for r in got} == {u: len(device_neighbours(rows, u)) for u in {r[1] for r in rows}}


def test_few_rows_per_edge_on_busy_devices(spark):
    """1,500 users on seven devices, all 127 sets of them: fewer than ten rows per edge, where pairs would be 1,500."""
    edges = spark.range(1500).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"), F.lit("USED_DEVICE").alias("etype"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: F.pmod(F.floor((F.col("id") % 127 + 1) / F.pow(F.lit(2.0), d)), F.lit(2)) == 1)).alias("d"),
    ).select("user_id", "etype", F.concat(F.lit("d"), F.col("d").cast("string")).alias("entity_id"), F.lit(0).cast("long").alias("first_seen"), F.lit(1).cast("long").alias("txns"))
    shared = edges.select("user_id", F.col("entity_id").alias("device"))
    rows, n = graph.set_cells(shared, graph._alike(shared)).count(), edges.count()
    assert n > 5000 and rows < 10 * n
    held = {}
    for r in edges.collect():
        held.setdefault(r.user_id, set()).add(r.entity_id)
    got = {r.user_id: r.shared_device_count for r in graph.shared_device_count(edges).collect()}
    for user in ("u0", "u5", "u126", "u1499"):
        assert got[user] == sum(bool(held[user] & d) for d in held.values()) - 1


@pytest.mark.parametrize("wide", [0, 2, 8])
def test_shared_devices_by_subsets_and_bits(make_txns, monkeypatch, wide):
    """Two users of the same three devices and others of one or two: counts by subsets, and by bits beyond the limit."""
    monkeypatch.setattr(graph, "WIDE", wide)
    rows = make_rows()
    got = graph.shared_device_count(graph.build_edges(make_txns(rows))).collect()
    assert {r.user_id: r.shared_device_count for r in got} == {u: len(device_neighbours(rows, u)) for u in {r[1] for r in rows}}


def test_few_devices_make_no_cells(make_txns, monkeypatch):
    """Cells per set and device grow with the users of the device; users of few devices need none."""
    monkeypatch.setattr(graph, "device_cells", None)
    rows = make_rows()
    got = graph.shared_device_count(graph.build_edges(make_txns(rows))).collect()
    assert {r.user_id: r.shared_device_count for r in got} == {u: len(device_neighbours(rows, u)) for u in {r[1] for r in rows}}


@pytest.mark.parametrize("limit", [1000, 3, 1])
def test_shared_devices_asof(make_txns, limit):
    rows = make_rows()
    txns = make_txns(rows)
    events, arrivals = graph.shared_device_events(graph.build_edges(txns), limit)
    df = behaviour(txns, user_events=events, event_totals=["devices_met"], event_lasts=["busy_set"])
    if arrivals is not None:
        df = graph.add_busy_members(df, arrivals)
    got = {r.txn_id: r.devices_met for r in df.select("txn_id", "devices_met").collect()}
    assert got == {r[0]: len(device_neighbours(rows, r[1], r[2])) for r in rows}


def met_rows(users, devices, each, seed):
    rng = random.Random(seed)
    return [
        (f"t{u}-{i}", f"u{u}", rng.randrange(0, 3000), 1.0, "m", "IN", f"d{rng.randrange(devices)}") for u in range(users) for i in range(each)
    ]


@pytest.mark.parametrize("wide", [0, 2, 8])
@pytest.mark.parametrize("users, devices, each, segment_rows", [(30, 6, 5, 10**9), (30, 6, 5, 20), (40, 3, 9, 20)])
def test_busy_devices_by_subsets_sets_and_pairs(make_txns, monkeypatch, wide, users, devices, each, segment_rows):
    """Users of few, many and, with few devices, the same busy devices."""
    monkeypatch.setattr(graph, "WIDE", wide)
    rows = met_rows(users, devices, each, wide)
    txns = make_txns(rows)
    events, busy = graph.shared_device_events(graph.build_edges(txns), 1)
    df = behaviour(txns, user_events=events.drop("busy_set"), event_totals=["devices_met"])
    df = graph.add_busy_members(df, busy, segment_rows, txns)
    got = {r.txn_id: r.devices_met for r in df.select("txn_id", "devices_met").collect()}
    assert got == {r[0]: len(device_neighbours(rows, r[1], r[2])) for r in rows}


def test_busy_devices_take_rows_by_edges_and_questions(make_txns, monkeypatch):
    """600 users with three of 30 busy devices, nearly each with a set of its own: sets times members were some 60,000 rows."""
    rows = met_rows(600, 30, 3, 1)
    txns = make_txns(rows)
    kept, persist = {}, graph.persist_table
    monkeypatch.setattr(graph, "persist_table", lambda df, label: kept.setdefault(label, persist(df, label)))
    events, busy = graph.shared_device_events(graph.build_edges(txns), 10)
    assert busy.count() <= 1800
    graph.add_busy_members(behaviour(txns, user_events=events.drop("busy_set"), event_totals=["devices_met"]), busy).count()
    # At most seven subsets for each user and, on the way, one, three and seven for the three questions.
    assert kept["busy_moves"].count() <= 600 * (7 + 1 + 3 + 7)


@pytest.mark.parametrize("task_pairs", [10**9, 100])
def test_pairs_of_users_of_many_devices_by_parts(make_txns, monkeypatch, task_pairs):
    """Users of some ten busy devices and others of two, with one part and with many."""
    monkeypatch.setattr(graph, "TASK_PAIRS", task_pairs)
    rows = met_rows(25, 14, 16, 2) + [(f"n{r[0]}", f"n{r[1]}", *r[2:]) for r in met_rows(25, 14, 2, 3)]
    txns = make_txns(rows)
    events, busy = graph.shared_device_events(graph.build_edges(txns), 1)
    df = behaviour(txns, user_events=events.drop("busy_set"), event_totals=["devices_met"])
    got = {r.txn_id: r.devices_met for r in graph.add_busy_members(df, busy, times=txns).select("txn_id", "devices_met").collect()}
    assert got == {r[0]: len(device_neighbours(rows, r[1], r[2])) for r in rows}


def test_pairs_of_users_of_many_devices_fill_no_task(spark, monkeypatch):
    """200 users, all on the same ten devices: 2,000 edges make 398,000 pairs, which one task used to make."""
    monkeypatch.setattr(graph, "TASK_PAIRS", 20_000)
    entry = F.struct(F.concat(F.lit("d"), F.col("d").cast("string")).alias("device"), F.col("id").alias("first_seen"), F.lit(200).cast("long").alias("users"))
    mine = (
        spark.range(200).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9)))).groupBy(F.concat(F.lit("u"), "id").alias("user_id"))
        .agg(F.sort_array(F.collect_list(entry)).alias("busy")).withColumn("wide", F.lit(True))
    )
    found = graph._wide_pairs(mine, 400_000).withColumn("task", F.spark_partition_id())
    tasks = found.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.collect_set("user_id").alias("users")).collect()
    assert sum(r.n for r in tasks) == 200 * 199 * 10
    assert len(tasks) > 8 and max(r.n for r in tasks) < 100_000
    # All devices of a user in one task.
    assert sum(len(r.users) for r in tasks) == 200


def hops(rows, flagged, user, until):
    """Breadth-first search from the user over devices and merchants seen by then."""
    by_entity, by_user = defaultdict(set), defaultdict(set)
    for r in rows:
        if r[2] <= until:
            for entity in (("d", r[6]), ("m", r[4])):
                by_entity[entity].add(r[1])
                by_user[r[1]].add(entity)
    targets = {u for u, at in flagged.items() if at <= until} - {user}
    reached, frontier = {user}, {user}
    for distance in (2, 4):
        frontier = {o for u in frontier for e in by_user[u] for o in by_entity[e]} - reached
        reached |= frontier
        if frontier & targets:
            return distance
    return 0


def sparse_rows(seed):
    rng = random.Random(seed)
    return [
        (f"t{i:02d}", f"u{rng.randrange(25)}", rng.randrange(0, 1000), 1.0, f"m{rng.randrange(40)}", "IN", f"d{rng.randrange(40)}")
        for i in range(60)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hop_distance_asof(spark, make_txns, seed):
    rows = sparse_rows(seed)
    flagged = {"u1": 200, "u7": 0, "u12": 600}
    users = spark.createDataFrame([(u, BASE_US + at * 1_000_000) for u, at in flagged.items()], "user_id string, flagged_at long")
    txns = make_txns(rows)
    ready = graph.hop_ready(graph.build_edges(txns), users, ["USED_DEVICE", "TRANSACTED_AT"])
    df = behaviour(txns, user_events=graph.hop_events(ready), event_totals=["two_hops", "four_hops"])
    got = df.select("txn_id", graph.hops(F.col("two_hops") > 0, F.col("four_hops") > 0).alias("h")).collect()
    expected = {r[0]: hops(rows, flagged, r[1], r[2]) for r in rows}
    assert {r.txn_id: r.h for r in got} == expected
    assert {0, 2, 4} <= set(expected.values())


def test_flagged_alone_and_together(spark, make_txns):
    rows = [("a", "u1", 0, 1, "m1", "IN", "d1"), ("b", "u2", 0, 1, "m2", "IN", "d2"), ("c", "u3", 0, 1, "m3", "IN", "d2")]
    edges = graph.build_edges(make_txns(rows))
    users = spark.createDataFrame([("u1", 0), ("u2", 0), ("u3", 0)], "user_id string, flagged_at long")
    got = graph.hop_distance(edges, users, ["USED_DEVICE"]).collect()
    assert {r.user_id: r.hop_distance_to_fraud for r in got} == {"u1": 0, "u2": 2, "u3": 2}


@pytest.mark.parametrize("segment_rows", [10**9, 20])
def test_merchant_exposure_asof(spark, make_txns, segment_rows):
    rows = make_rows()
    flagged = {f"u{i}": i * 200 for i in range(0, 30, 4)}
    users = spark.createDataFrame([(u, BASE_US + at * 1_000_000) for u, at in flagged.items()], "user_id string, flagged_at long")
    txns = make_txns(rows)
    df = graph.merchant_fraud_asof(txns, graph.build_edges(txns), users, segment_rows)
    got = {r.txn_id: r.shared_merchant_fraud_count for r in df.collect()}
    expected = {
        r[0]: len({o[1] for o in rows if o[4] == r[4] and o[2] <= r[2] and flagged.get(o[1], 10**9) <= r[2]}) for r in rows
    }
    assert got == expected


def test_min_labels(spark, make_txns):
    txns = make_txns([("a", "u1", 0), ("b", "u1", 10), ("c", "u2", 0)])
    labels = txns.select("txn_id", F.lit(True).alias("is_fraud"), F.col("txn_timestamp").alias("confirmed_at"))
    got = graph.flagged_users(labels, txns, min_labels=2).collect()
    assert [(r.user_id, r.flagged_at) for r in got] == [("u1", BASE_US + 10_000_000)]
