"""Features of the user / device / merchant / country graph.

The graph is an edge table, one row per user and entity. No operator lists the
pairs of users that share a busy entity: its members are counted, as bits or as
dated arrivals. Only the point-in-time form joins entities with few members with
themselves, and pairs up users of very many busy entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.functions.signals import micros
from ledgerwatch.operators.segments import SEGMENT_ROWS, cut_points, prefix_scan
from ledgerwatch.schema import EDGE_TYPES
from ledgerwatch.session import persist_table

# Devices with more users than this are counted as a whole instead of paired up.
PAIR_LIMIT = 100
# Users of more busy devices than this are paired up: the subsets of so many devices are too many.
WIDE = 8
# Pairs that a task makes of such users, once per device.
TASK_PAIRS = 1_000_000

_ENTITY = ["etype", "entity_id"]


def build_edges(txns: DataFrame) -> DataFrame:
    """One edge per user, type and entity with its first instant and its number of transactions."""
    ends = dict(zip(EDGE_TYPES, ["device_id", "merchant_id", "ip_country"]))
    links = F.array(*[F.struct(F.lit(t).alias("etype"), F.col(c).alias("entity_id")) for t, c in ends.items()])
    rows = txns.select("user_id", micros("txn_timestamp").alias("us"), F.explode(links).alias("link"))
    return rows.groupBy("user_id", "link.etype", "link.entity_id").agg(
        F.min("us").alias("first_seen"), F.count(F.lit(1)).alias("txns")
    )


def of_type(edges: DataFrame, *etypes: str) -> DataFrame:
    return edges.where(F.col("etype").isin(*etypes))


def flagged_users(labels: DataFrame, txns: DataFrame, as_of=None, min_labels: int = 1) -> DataFrame:
    """Users with at least ``min_labels`` confirmed fraud labels, and when they got there."""
    frauds = labels.where("is_fraud")
    if as_of is not None:
        frauds = frauds.where(F.col("confirmed_at") <= F.lit(as_of))
    dated = frauds.select("txn_id", micros("confirmed_at").alias("flagged_at")).join(
        txns.select("txn_id", "user_id"), "txn_id"
    )
    if min_labels == 1:
        return dated.groupBy("user_id").agg(F.min("flagged_at").alias("flagged_at"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("flagged_at", "txn_id"))
    ranked = dated.withColumn("nth", nth).where(F.col("nth") <= min_labels)
    return ranked.where(F.col("nth") == min_labels).select("user_id", "flagged_at")


# -- shared devices ----------------------------------------------------------------------


def _split_devices(edges: DataFrame, pair_limit: int) -> tuple[DataFrame, DataFrame]:
    """Device edges of devices with few users, and, with ``users``, of those with many."""
    devices = of_type(edges, "USED_DEVICE").select("user_id", F.col("entity_id").alias("device"), "first_seen")
    degree = devices.groupBy("device").agg(F.count(F.lit(1)).alias("users"))
    return (
        devices.join(degree.where(F.col("users") <= pair_limit).select("device"), "device"),
        devices.join(degree.where(F.col("users") > pair_limit), "device"),
    )


def _pairs(quiet: DataFrame) -> DataFrame:
    """Ordered pairs of users on the same quiet device: at most ``pair_limit`` per edge."""
    other = quiet.select("device", F.col("user_id").alias("other"), F.col("first_seen").alias("other_seen"))
    return (
        quiet.join(other, "device")
        .where(F.col("user_id") != F.col("other"))
        .groupBy("user_id", "other")
        .agg(F.min(F.greatest("first_seen", "other_seen")).alias("ready"))
    )


def _busy_of_user(busy: DataFrame) -> DataFrame:
    """The busy devices of each user, with the instant of first use."""
    entry = F.struct(F.col("device"), F.col("first_seen"))
    return busy.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("busy"))


def _alike(shared: DataFrame) -> DataFrame:
    """(user_id, rep): users of the same set of devices have the same representative, one of them.

    Sets are told apart by two 64-bit checksums of their devices and their sizes, so that a set of any size is one row.
    """
    marks = shared.groupBy("user_id").agg(
        F.bit_xor(F.xxhash64("device")).alias("a"), F.bit_xor(F.xxhash64("device", F.lit("set"))).alias("b"), F.count(F.lit(1)).alias("n")
    )
    reps = marks.groupBy("a", "b", "n").agg(F.min("user_id").alias("rep"))
    return marks.join(reps, ["a", "b", "n"]).select("user_id", "rep")


def device_cells(shared: DataFrame, alike: DataFrame) -> DataFrame:
    """(device, bucket, bits): the members of each device as bits, 64 users to a bucket.

    Users are numbered in the order of their representatives, so that users of the same devices share buckets. A device
    has at most one cell per member, and down to one for 64 members.
    """
    ordered = alike.repartitionByRange("rep", "user_id").sortWithinPartitions("rep", "user_id")
    # Numbers have to be the same for all that reads them: stored.
    numbered = persist_table(ordered.select("user_id", "rep", F.monotonically_increasing_id().alias("number")), "user_numbers")
    members = shared.join(numbered, "user_id")
    bit = F.expr("shiftleft(1L, CAST(number % 64 AS INT))")
    return members.groupBy("device", F.floor(F.col("number") / 64).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def set_cells(shared: DataFrame, alike: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """(rep, bucket, bits) of each device of each set, or of those of ``asking`` alone: what is or-ed to the members of the set."""
    sets = (shared if asking is None else asking).join(alike.where(F.col("user_id") == F.col("rep")).select("rep", "user_id"), "user_id")
    return sets.select("rep", "device").join(device_cells(shared, alike), "device")


def _met_by_subsets(shared: DataFrame) -> DataFrame:
    """(rep, met): for each distinct set of devices, the other users of any of them, by inclusion and exclusion.

    Each set counts its users once at each of its subsets, so there are no more rows than sets times subsets.
    """
    held = shared.groupBy("user_id").agg(F.sort_array(F.collect_list("device")).alias("devices"))
    sets = held.groupBy("devices").agg(F.min("user_id").alias("rep"), F.count(F.lit(1)).alias("users"))
    parts = persist_table(sets.select("rep", "users", F.explode(_subsets("devices")).alias("part")), "device_parts")
    counts = parts.groupBy("part").agg(F.sum("users").alias("n"))
    sign = F.when(F.size("part") % 2 == 1, 1).otherwise(-1)
    return parts.join(counts, "part").groupBy("rep").agg(F.sum(sign * (F.col("n") - 1)).alias("met"))


def shared_device_count(edges: DataFrame) -> DataFrame:
    """Distinct other users on any of the user's devices, for every user of the graph.

    Devices of a single user count for nothing and go first. Users of at most ``WIDE`` devices meet each other by counts
    per subset of devices. For the others the members of each distinct set of devices are or-ed once, 64 of them in a
    number, for all users of the set. No pairs of users are made.
    """
    devices = of_type(edges, "USED_DEVICE").select("user_id", F.col("entity_id").alias("device"), "first_seen")
    several = devices.groupBy("device").agg(F.count(F.lit(1)).alias("users")).where("users > 1").select("device")
    shared = persist_table(devices.join(several, "device").select("user_id", "device"), "shared_devices")
    alike = persist_table(_alike(shared), "alike_users")
    held = shared.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    wide = held.where(F.col("held") > WIDE).select("user_id")
    narrow = shared.join(held.where(F.col("held") <= WIDE).select("user_id"), "user_id")
    counts = _met_by_subsets(narrow)
    if not wide.isEmpty():
        wide = persist_table(shared.join(wide, "user_id"), "wide_users")
        everybody = set_cells(shared, alike, wide)
        # Each set of few devices meets the users of many there; a wide user is no member of it.
        beside = set_cells(wide, alike, narrow).groupBy("rep", "bucket").agg(F.bit_or("bits").alias("bits"))
        everybody = everybody.groupBy("rep", "bucket").agg(F.bit_or("bits").alias("bits"))
        met = F.sum(F.bit_count("bits"))
        counts = counts.unionByName(beside.groupBy("rep").agg(met.alias("met")))
        counts = counts.unionByName(everybody.groupBy("rep").agg((met - 1).alias("met")))
        counts = counts.groupBy("rep").agg(F.sum("met").alias("met"))
    users = edges.select("user_id").distinct()
    return users.join(alike.join(counts, "rep").select("user_id", "met"), "user_id", "left").select(
        "user_id", F.coalesce("met", F.lit(0)).cast("bigint").alias("shared_device_count")
    )


def shared_device_events(edges: DataFrame, pair_limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """What changes a user's shared-device count over time.

    Returns dated events ``(_user, position, devices_met, busy_set)`` and, where busy
    devices exist, their edges ``(device, user_id, first_seen, users)``. At an instant the
    count is the sum of ``devices_met`` so far, plus what :func:`add_busy_members` adds for
    the busy devices. ``busy_set`` is empty.
    """
    quiet, busy = _split_devices(edges, pair_limit)
    pairs = _pairs(quiet)
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string").alias("busy_set")
    busy = persist_table(busy, "busy_devices")
    if busy.isEmpty():
        events = pairs.select(
            F.col("user_id").alias("_user"), F.col("ready").alias("position"), one.alias("devices_met"), none
        )
        return events, None

    mine = _busy_of_user(busy)
    met = pairs.join(mine, "user_id", "left").join(
        mine.select(F.col("user_id").alias("other"), F.map_from_entries("busy").alias("other_busy")), "other", "left"
    )
    # The instant from which both are members of a common busy device: counted there already.
    both = F.filter("busy", lambda d: F.map_contains_key("other_busy", d.device))
    common = F.array_min(F.transform(both, lambda d: F.greatest(d.first_seen, F.try_element_at("other_busy", d.device))))
    met = met.withColumn("common", F.when(F.col("other_busy").isNotNull(), common))
    changes = F.array(
        F.struct(F.col("ready").alias("position"), one.alias("devices_met")),
        F.struct(F.greatest("ready", "common").alias("position"), (-one).alias("devices_met")),
    )
    events = (
        met.select(F.col("user_id").alias("_user"), "common", F.explode(changes).alias("c"))
        .where((F.col("c.devices_met") > 0) | F.col("common").isNotNull())
        .select("_user", "c.position", "c.devices_met", none)
    )
    return events, busy


def _subsets(items: str) -> Column:
    """All subsets of an array but the empty one, in the array's order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 1).cast("int"))
    return F.transform(masks, lambda m: F.filter(items, lambda _, i: F.getbit(m, i) == 1))


def _wide_pairs(mine: DataFrame, many: int) -> DataFrame:
    """Users of many busy devices with each user they meet there, once per device; about ``many`` rows.

    Few edges can make many pairs, so tasks are counted by pairs: each part of the users gets the members of the devices
    it has. All devices of a user are in one part, so that a pair is reduced to one row before it is shuffled.
    """
    parts = many // TASK_PAIRS + 1
    met = mine.select("user_id", "wide", F.explode("busy").alias("d"))
    met = met.select("user_id", "wide", F.col("d.device").alias("device"), F.col("d.first_seen").alias("first_seen"))
    part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).alias("_part")
    asking = met.where("wide").select("user_id", "device", "first_seen", part)
    other = met.select(
        "device", F.col("user_id").alias("other"), F.col("wide").alias("other_wide"), F.col("first_seen").alias("other_seen")
    )
    asked = asking.select("device", "_part").distinct()
    return (
        asking.repartition(parts, "_part")
        .join(other.join(asked, "device").repartition(parts, "_part"), ["device", "_part"])
        .where(~F.col("user_id").eqNullSafe(F.col("other")))
        .drop("_part")
    )


def _busy_members(busy: DataFrame, times: DataFrame, segment_rows: int) -> DataFrame:
    """(_asker, _at, _others): users other than the asker on any of the asker's busy devices, at each of the asker's instants.

    The members of a union of devices are counted by inclusion and exclusion: every user with at most ``WIDE`` busy
    devices arrives once at each subset of them, and a question about a set adds and subtracts the arrivals so far at
    its subsets. A set that is asked about more often than it has members, times its subsets, gets arrivals of its own
    instead. The rows grow with the questions and the edges, not with pairs of users or with sets times members. Only
    users with more than ``WIDE`` busy devices are paired up with the users they meet there.
    """
    one = F.lit(1).cast("bigint")
    mine = busy.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("device", "first_seen", "users"))).alias("busy"))
    mine = mine.withColumn("wide", F.size("busy") > WIDE)
    here = F.filter("busy", lambda d: d.first_seen <= F.col("position"))
    asks = (
        times.distinct()
        .join(mine.withColumnRenamed("user_id", "_member"), F.col("user_id").eqNullSafe(F.col("_member")))
        .select("user_id", "position", "wide", here.alias("here"))
        .where(F.size("here") > 0)
        .select(
            "user_id",
            "position",
            "wide",
            # The set itself is of no use where pairs are counted, and may be long.
            F.when(~F.col("wide"), F.col("here.device")).alias("devices"),
            F.aggregate("here", F.lit(0).cast("bigint"), lambda n, d: n + d.users).alias("reach"),
        )
    )
    asks = persist_table(asks, "busy_asks")
    sets = asks.where(~F.col("wide")).groupBy("devices").agg(F.count(F.lit(1)).alias("asked"), F.max("reach").alias("reach"))
    whole = sets.where(F.col("asked") * (F.pow(F.lit(2), F.size("devices")) - 1) > F.col("reach")).select("devices")
    whole = persist_table(whole, "busy_sets")

    def key(kind: str, parts: Column) -> Column:
        return F.concat(F.array(F.lit(kind)), parts).alias("key")

    narrow = asks.where(~F.col("wide")).join(whole.withColumn("whole", F.lit(True)), "devices", "left")
    in_whole = narrow.where("whole").select(
        "user_id", "position", key("set", F.col("devices")), one.alias("sign"), one.alias("less")
    )
    in_parts = narrow.where(F.col("whole").isNull())
    sign = F.when(F.size("part") % 2 == 1, one).otherwise(-one)
    questions = in_whole.unionByName(
        in_parts.select("user_id", "position", F.explode(_subsets("devices")).alias("part")).select(
            "user_id", "position", key("part", F.col("part")), sign.alias("sign"), one.alias("less")
        )
    )
    arrived = (
        whole.select("devices", F.explode("devices").alias("device"))
        .join(busy, "device")
        .groupBy("devices", "user_id")
        .agg(F.min("first_seen").alias("position"))
        .select(key("set", F.col("devices")), "position")
    )
    members = mine.where(~F.col("wide")).select(F.explode(_subsets("busy")).alias("part"))
    arrived = arrived.unionByName(
        members.select(key("part", F.col("part.device")), F.array_max("part.first_seen").alias("position"))
    )
    many = mine.where("wide").agg(F.sum(F.aggregate("busy", F.lit(0).cast("bigint"), lambda n, d: n + d.users))).first()[0]
    if many:
        # Whoever meets a user of many busy devices counts that user as such, and that user everybody.
        pairs = (
            _wide_pairs(mine, many)
            .groupBy("user_id", "other", "other_wide")
            .agg(F.min(F.greatest("first_seen", "other_seen")).alias("position"))
        )
        sides = F.when(F.col("other_wide"), F.array("user_id")).otherwise(F.array("user_id", "other"))
        sided = pairs.select(F.explode(sides).alias("side"), "position")
        arrived = arrived.unionByName(sided.select(key("user", F.array("side")), "position"))
        asking = asks.where("wide").select("user_id", "position").unionByName(in_parts.select("user_id", "position"))
        own = asking.select(
            "user_id", "position", key("user", F.array("user_id")), one.alias("sign"), F.lit(0).cast("bigint").alias("less")
        )
        questions = questions.unionByName(own)

    moves = questions.withColumn("asks", F.lit(True)).unionByName(
        arrived.withColumns({"arrived": one, "asks": F.lit(False)}), allowMissingColumns=True
    )
    moves = persist_table(moves, "busy_moves")
    cuts = cut_points(moves.select("key", "position"), ["key"], "position", segment_rows)
    counted = prefix_scan(moves, ["key"], "position", ["arrived"], inclusive=True, cuts=cuts).where("asks")
    found = F.col("sign") * (F.coalesce("arrived", F.lit(0)) - F.col("less"))
    return counted.groupBy(F.col("user_id").alias("_asker"), F.col("position").alias("_at")).agg(F.sum(found).alias("_others"))


def add_busy_members(
    df: DataFrame, arrivals: DataFrame, segment_rows: int = SEGMENT_ROWS, times: DataFrame | None = None
) -> DataFrame:
    """Adds the users met on the row's busy devices by its ``txn_timestamp`` to ``devices_met``.

    ``times`` has the users and instants of ``df`` where these are cheaper to read elsewhere.
    """
    asked = (df if times is None else times).select("user_id", micros("txn_timestamp").alias("position"))
    others = _busy_members(arrivals, asked, segment_rows)
    rows = df.withColumn("_position", micros("txn_timestamp"))
    found = rows.join(others, F.col("user_id").eqNullSafe(F.col("_asker")) & (F.col("_position") == F.col("_at")), "left")
    return found.select(
        *[c for c in df.columns if c not in ("devices_met", "busy_set")],
        (F.col("devices_met") + F.coalesce("_others", F.lit(0))).alias("devices_met"),
    )


# -- merchants ---------------------------------------------------------------------------


def merchant_fraud_count(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Distinct flagged users per merchant, 0 for merchants without any."""
    visits = of_type(edges, "TRANSACTED_AT").join(flagged.select("user_id", "flagged_at"), "user_id", "left")
    hit = F.count(F.when(F.col("flagged_at").isNotNull(), 1))
    return visits.groupBy(F.col("entity_id").alias("merchant_id")).agg(hit.alias("shared_merchant_fraud_count"))


def merchant_fraud_asof(
    df: DataFrame, edges: DataFrame, flagged: DataFrame, segment_rows: int = SEGMENT_ROWS, times: DataFrame | None = None
) -> DataFrame:
    """Adds the flagged users seen at the row's merchant up to and including its instant.

    ``times`` has the merchants and instants of ``df`` where these are cheaper to read elsewhere.
    """
    exposure = (
        of_type(edges, "TRANSACTED_AT")
        .join(flagged, "user_id")
        .select(
            F.col("entity_id").alias("_merchant"),
            F.greatest("first_seen", "flagged_at").alias("position"),
            F.lit(1).cast("bigint").alias("flagged"),
        )
    )
    queries = df.select(
        F.col("merchant_id").alias("_merchant"),
        micros("txn_timestamp").alias("position"),
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
    )
    times = (df if times is None else times).select(F.col("merchant_id").alias("_merchant"), micros("txn_timestamp").alias("position"))
    cuts = cut_points(times, ["_merchant"], "position", segment_rows)
    moves = queries.unionByName(exposure, allowMissingColumns=True)
    counted = prefix_scan(moves, ["_merchant"], "position", ["flagged"], inclusive=True, cuts=cuts)
    return counted.where(F.col("row").isNotNull()).select(
        "row.*", F.coalesce("flagged", F.lit(0)).cast("bigint").alias("shared_merchant_fraud_count")
    )


# -- distance to fraud -------------------------------------------------------------------


def _two_earliest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the two earliest dates with different sources.

    Two sources suffice to answer "the earliest source other than me" for any member,
    and the property survives merging, so paths never have to be listed. The rank
    filter is applied before the shuffle as well, so a busy key sends few rows.
    """
    earliest = df.groupBy(*keys, "source").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "source"))
    return earliest.withColumn("rank", rank).where("rank <= 2").drop("rank")


def hop_ready(edges: DataFrame, flagged: DataFrame, etypes: list[str] = EDGE_TYPES) -> DataFrame:
    """Per user the instants from which another flagged user is two and four hops away.

    All edges join a user and an entity, so distances between users are even and a
    cap of five hops means two rounds of passing dates through entities.
    """
    links = of_type(edges, *etypes).select("user_id", *_ENTITY, "first_seen")

    def reach_entities(sources: DataFrame) -> DataFrame:
        at = F.greatest("first_seen", "at").alias("at")
        return _two_earliest(links.join(sources, "user_id").select(*_ENTITY, "source", at), _ENTITY)

    def reach_users(entities: DataFrame) -> DataFrame:
        at = F.greatest("first_seen", "at").alias("at")
        return links.join(entities, _ENTITY).select("user_id", "source", at)

    start = flagged.select("user_id", F.col("user_id").alias("source"), F.col("flagged_at").alias("at"))
    # At most two rows per user; read twice, so stored between the rounds.
    near = persist_table(_two_earliest(reach_users(reach_entities(start)), ["user_id"]), "near_fraud")
    far = reach_users(reach_entities(near))

    def ready(found: DataFrame, hops: int) -> DataFrame:
        others = found.where(F.col("source") != F.col("user_id"))
        return others.groupBy("user_id").agg(F.min("at").alias("at")).withColumn("hops", F.lit(hops))

    # Own flag or not: the two earliest sources of a user include one other than the user.
    both = ready(near, 2).unionByName(ready(far, 4))
    return both.groupBy("user_id").agg(
        F.min(F.when(F.col("hops") == 2, F.col("at"))).alias("two_hops_at"),
        F.min(F.when(F.col("hops") == 4, F.col("at"))).alias("four_hops_at"),
    )


def hops(two: Column, four: Column) -> Column:
    return F.when(two, 2).when(four, 4).otherwise(0).cast("bigint")


def hop_distance(edges: DataFrame, flagged: DataFrame, etypes: list[str] = EDGE_TYPES) -> DataFrame:
    """Shortest path to another flagged user for every user: 2, 4, or 0 for none within five hops."""
    users = edges.select("user_id").distinct()
    return users.join(hop_ready(edges, flagged, etypes), "user_id", "left").select(
        "user_id",
        hops(F.col("two_hops_at").isNotNull(), F.col("four_hops_at").isNotNull()).alias("hop_distance_to_fraud"),
    )


def hop_events(ready: DataFrame) -> DataFrame:
    """Dated counts for :func:`ledgerwatch.operators.behaviour.behaviour`."""
    one = F.lit(1).cast("bigint")
    none = F.lit(None).cast("bigint")
    steps = F.array(
        F.struct(F.col("two_hops_at").alias("position"), one.alias("two_hops"), none.alias("four_hops")),
        F.struct(F.col("four_hops_at").alias("position"), none.alias("two_hops"), one.alias("four_hops")),
    )
    events = ready.select(F.col("user_id").alias("_user"), F.explode(steps).alias("s"))
    return events.select("_user", "s.*").where(F.col("position").isNotNull())


# -- all three, for given transactions ---------------------------------------------------


def graph_asof(
    df: DataFrame,
    edges: DataFrame,
    flagged: DataFrame,
    etypes: list[str] = EDGE_TYPES,
    pair_limit: int = PAIR_LIMIT,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds the three graph features of the transactions in ``df`` at their instants.

    ``edges`` and ``flagged`` may know more than ``df``, as in a stream, where ``df`` is a batch: only the users of
    ``df`` are scanned.
    """
    events, arrivals = shared_device_events(edges, pair_limit)
    events = events.unionByName(hop_events(hop_ready(edges, flagged, etypes)), allowMissingColumns=True)
    users = df.select(F.col("user_id").alias("_user")).distinct()
    events = events.join(users, "_user", "left_semi").withColumn("position", F.col("position") - 1)
    queries = df.select(
        F.col("user_id").alias("_user"),
        F.col("txn_id").alias("_txn"),
        micros("txn_timestamp").alias("position"),
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
    )
    moves = queries.unionByName(events, allowMissingColumns=True)
    cuts = cut_points(queries, ["_user"], "position", segment_rows)
    counts = ["devices_met", "two_hops", "four_hops"]
    rows = prefix_scan(moves, ["_user"], "position", counts, tie="_txn", cuts=cuts).where(F.col("row").isNotNull())
    rows = rows.select("row.*", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    if arrivals is not None:
        rows = add_busy_members(rows, arrivals, segment_rows, df)
    rows = merchant_fraud_asof(rows, edges, flagged, segment_rows, df)
    rows = rows.withColumns(
        {
            "shared_device_count": F.col("devices_met"),
            "hop_distance_to_fraud": hops(F.col("two_hops") > 0, F.col("four_hops") > 0),
        }
    )
    return rows.drop(*counts)
