"""Shards by balanced label propagation: linked documents move together, sizes stay even.

Links are memberships (node, group): documents of a group are neighbours. Linked nodes
start dealt out evenly. In each round a group's members see how many of them each shard
holds and wish to move to the fullest one; the wishes are counted by (from, to, gain),
quotas are set so that no shard leaves its capacity, and the moves of greatest gain are
made. Nodes without links fill every shard up to its exact size afterwards. So the
law ``rows`` holds at every step: counts of shards are at most one apart.

The rounds end by themselves, after two in a row without a gain: one that fills roomy
shards and one among all. What must grow is the sum, over groups and shards, of the squares of a
group's members in a shard, a whole number that is bounded; so there is no set number of
rounds. Where a node has one group, every move that is made adds to it. Where nodes have
several, a round may lose; the best state met is the result.

To the driver come only counts by shard pair and class of gain: at most shards squared
times 64 rows. A group of any size is counted before it is shuffled, and its one row of
counts is joined back, so that a hot group's rows can be split among tasks.

Defined results: a null text has size 1 and no links, empty texts are equal texts. Equal rows are placed each for themselves,
as are rows without an id. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import materialize, ranked, table

SHARDS = 16


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def quotas(wishes: list[tuple[int, int, int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """How many of each (from, to, class) may move, given (from, to, class, n).

    Moves both ways between two shards cancel out and need no room; the others share the
    room of their shard. Higher classes of gain go first.
    """
    demand: dict[tuple[int, int], int] = defaultdict(int)
    for i, j, _, n in wishes:
        demand[i, j] += n
    allowed = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    left = list(room)
    for i, j, _, n in sorted(wishes, key=lambda w: (-w[2], w[0], w[1])):
        more = min(left[j], n, demand[i, j] - allowed[i, j])
        allowed[i, j] += more
        left[j] -= more
    out = []
    for i, j, c, n in sorted(wishes, key=lambda w: -w[2]):
        if m := min(n, allowed[i, j]):
            out.append((i, j, c, m))
            allowed[i, j] -= m
    return out


def counted(links: DataFrame, state: DataFrame) -> DataFrame:
    """(group, shard, n): members of each group in each shard."""
    return materialize(links.join(state, "node").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")


def together(counts: DataFrame) -> int:
    """Ordered pairs of a group's members in one shard, each with itself among them."""
    n = F.col("n").cast("decimal(19,0)")
    return int(counts.agg(F.sum((n * n).cast("decimal(38,0)")).alias("t")).first().t or 0)


def wishes(links: DataFrame, state: DataFrame, counts: DataFrame, open_shards: list[int], salt: int) -> DataFrame:
    """(node, shard, to, class): nodes with more neighbours in another open shard."""
    order = lambda: F.struct("n", F.xxhash64("group", "shard", F.lit(salt)), "shard")
    best = counts.groupBy("group").agg(
        F.max(F.when(F.col("shard").isin(open_shards), order())).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("each"),
    )
    gain = F.col("best.n") - F.element_at("each", F.col("shard"))
    moves = (
        links.join(state, "node")
        .join(best, "group")
        .select("node", "shard", F.col("best.shard").alias("to"), gain.alias("gain"))
        .where("to <> shard and gain >= 0")
    )
    # An even split moves one way only: towards the shard that all members agree on.
    strongest = moves.groupBy("node", "shard").agg(F.max(F.struct("gain", "to")).alias("m"))
    return strongest.select("node", "shard", F.col("m.to").alias("to"), F.floor(F.log2(F.col("m.gain") + 1)).cast("int").alias("class"))


def propagate(links: DataFrame, shards: int, capacity: list[int]) -> DataFrame:
    """(node, shard) of all linked nodes. ``links`` (node, group) should be a written table."""
    spark = links.sparkSession
    nodes = materialize(links.select("node").distinct(), "nodes")
    state = ranked(nodes, [], ["node"], "place").select("node", F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    state = materialize(state, "state")
    counts = counted(links, state)
    found, most, turn, idle = state, together(counts), 0, 0
    while idle < 2:
        held = dict(map(tuple, state.groupBy("shard").count().collect()))
        room = [c - held.get(j, 0) for j, c in enumerate(capacity)]
        roomy = [j for j, r in enumerate(room) if r > 0]
        open_shards = roomy if roomy and turn % 2 == 0 else list(range(shards))
        moves = materialize(wishes(links, state, counts, open_shards, turn // 2), "wishes")
        asked = [tuple(r) for r in moves.groupBy("shard", "to", "class").count().collect()]
        granted = quotas(asked, room)
        turn, idle = turn + 1, idle + 1
        if not granted:
            continue
        # At most shards * shards * 64 rows.
        limits = F.broadcast(spark.createDataFrame(granted, "shard int, to int, class int, most long"))
        chosen = ranked(moves, ["shard", "to", "class"], ["node"], "place").join(limits, ["shard", "to", "class"])
        going = chosen.where("place < most").select("node", "to")
        state = materialize(state.join(going, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "state")
        counts = counted(links, state)
        if (now := together(counts)) > most:
            found, most, idle = state, now, 0
    return found


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``nodes`` (with ``node``, unique) with ``shard`` and ``slot``, its place there from 0."""
    capacity = capacities(nodes.count(), shards)
    linked = propagate(links, shards, capacity)
    held = dict(map(tuple, linked.groupBy("shard").count().collect()))
    free = nodes.join(linked, "node", "left_anti").select("node")
    ends, end = [], 0
    for j, c in enumerate(capacity):
        end += c - held.get(j, 0)
        ends.append(end)
    filled = ranked(materialize(free, "free"), [], ["node"], "place").select("node", _shard_of(F.col("place"), ends).alias("shard"))
    placed = materialize(nodes.join(linked.unionByName(filled), "node"), "placed")
    return ranked(placed, ["shard"], ["node"], "slot")


def _shard_of(place: Column, ends: list[int]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= place))


def cut_edges(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: pairs of neighbours, and those of them in different shards."""
    each = links.join(placed, "node").groupBy("group", "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    group = each.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return group.agg(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("edges"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("cut"))


def equal_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, doc_id, size, text_crc32), and links between documents of equal texts."""
    text = F.col("text").cast("string")
    nodes = materialize(
        documents.select(
            F.monotonically_increasing_id().alias("node"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("hash"),
        ),
        "documents",
    )
    group = F.struct("hash", "text_crc32", "size")
    several = nodes.where("hash is not null").groupBy(group.alias("group")).count().where("count > 1").select("group")
    links = nodes.where("hash is not null").select("node", group.alias("group")).join(several, "group", "left_semi")
    return nodes.drop("hash"), materialize(links.select("node", F.xxhash64("group").alias("group")), "links")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts are at most one apart."""
    placed = balanced_shards(*equal_texts(table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
