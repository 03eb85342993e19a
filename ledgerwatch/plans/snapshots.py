"""The full feature snapshot: behaviour, direct signals and point-in-time graph features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from ledgerwatch.operators import graph
from ledgerwatch.operators.behaviour import behaviour, snapshot_columns, snapshot_input
from ledgerwatch.operators.segments import SEGMENT_ROWS
from ledgerwatch.schema import EDGE_TYPES
from ledgerwatch.session import persist_table


def feature_snapshots(
    txns: DataFrame,
    labels: DataFrame,
    etypes: list[str] = EDGE_TYPES,
    segment_rows: int = SEGMENT_ROWS,
    pair_limit: int = graph.PAIR_LIMIT,
) -> DataFrame:
    """One snapshot per transaction, as it could have been known at that instant.

    Device and distance facts are dated per user and ride on the shuffle of the
    behavioural features; merchant exposure needs one more, by merchant.
    """
    # Several features read the graph; it is stored once instead of being derived from the
    # raw rows each time. The two tables do not depend on each other.
    with ThreadPoolExecutor(2) as pool:
        stored = pool.submit(persist_table, graph.build_edges(txns), "edges")
        flagged = persist_table(graph.flagged_users(labels, txns), "flagged_users")
        edges = stored.result()
    device_events, arrivals = graph.shared_device_events(edges, pair_limit)
    hop_events = graph.hop_events(graph.hop_ready(edges, flagged, etypes))
    events = device_events.unionByName(hop_events, allowMissingColumns=True)
    rows = behaviour(
        snapshot_input(txns),
        segment_rows=segment_rows,
        user_events=events.drop("busy_set"),
        event_totals=["devices_met", "two_hops", "four_hops"],
    )
    if arrivals is not None:
        rows = graph.add_busy_members(rows, arrivals, segment_rows, txns)
    rows = graph.merchant_fraud_asof(rows, edges, flagged, segment_rows, txns)
    rows = rows.withColumns(
        {
            "shared_device_count": F.col("devices_met"),
            "hop_distance_to_fraud": graph.hops(F.col("two_hops") > 0, F.col("four_hops") > 0),
        }
    )
    return snapshot_columns(rows)
