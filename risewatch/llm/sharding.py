"""Shards of equal size that keep linked documents together, by balanced label propagation.

A label stands for documents that will share a shard, at first one document each.  In each round every label
asks for the neighbour that it has most links with; whoever is asked and does not move itself takes in those
that come, in a random order, as long as all of them fit into a shard.  Labels that came to a full one stay
together in labels of their own, so a group larger than a shard falls into as few pieces as there can be.
Links between labels are added up, and rounds go on until nothing moves.  All of it are joins and
aggregations over links and labels; the driver sees sums.

Labels then go into shards as a whole, the largest first.  What is linked with nothing fills the shards up, and
all of them end with as many rows, one at most apart.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.llm.common import ranked, stage, utf8
from risewatch.llm.runs import join_hot, placed

LAW = "rows"


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """(a, b): each of the rows with one text, by its 128-bit mark, linked with the first of them."""
    first = nodes.groupBy("mark").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "a")
    return join_hot(nodes, first, "mark").where("node <> a").select("a", F.col("node").alias("b"))


def propagate(edges: DataFrame, places: int, rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes of `edges` (a, b): equal labels go together, at most `places` nodes each.

    Repeated links count once.  `rounds` is a bound against endless work; propagation ends by itself when no
    label fits to one that it is linked with.
    """
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage(_both_ways(one.withColumn("w", F.lit(1).cast("long"))), "shard-links")
    sizes = stage(links.select(F.col("a").alias("label")).distinct().withColumn("size", F.lit(1).cast("long")), "shard-sizes")
    nodes, moves = sizes.select(F.col("label").alias("node")), []
    for turn in range(rounds):
        if links.isEmpty():
            break
        asks = _asks(links, sizes, places, turn)
        if asks.isEmpty():  # no label fits to one that it is linked with
            break
        moved = _moves(asks, places, turn)
        moves.append(moved.select("node", "to"))
        to = moved.select(F.col("node").alias("a"), F.col("to").alias("new"))
        renamed = join_hot(links, to, "a", "left").select(F.coalesce("new", "a").alias("a"), "b", "w")
        renamed = join_hot(renamed, to.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("new", "b").alias("b"), "w")
        links = stage(renamed.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")), "shard-links")
        gone = sizes.join(moved.select(F.col("node").alias("label"), "to"), "label", "left")
        sizes = stage(gone.groupBy(F.coalesce("to", "label").alias("label")).agg(F.sum("size").alias("size")), "shard-sizes")
    return _ends(nodes, moves)


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _asks(links: DataFrame, sizes: DataFrame, places: int, turn: int) -> DataFrame:
    """(node, size, to, held): the label that each label asks for, and how large both are.

    Of two labels that would ask for each other, the one with fewer links asks; ties are drawn anew every round.
    """
    degree = links.groupBy("a").agg(F.sum("w").alias("degree"))
    info = degree.join(sizes.withColumnRenamed("label", "a"), "a")
    info = stage(info.select(F.col("a").alias("label"), "size", F.struct("degree", F.xxhash64("a", F.lit(turn)).alias("draw"), F.col("a").alias("id")).alias("rank")), "shard-turn")
    named = lambda side, *columns: info.select(F.col("label").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
    near = join_hot(join_hot(links, named("b", "size", "rank"), "b"), named("a", "size"), "a")
    near = near.where(F.col("size_a") + F.col("size_b") <= places) if turn else near
    best = near.groupBy("a").agg(F.max(F.struct("w", "rank_b", "b", "size_b")).alias("best"))
    asks = best.join(named("a", "size", "rank"), "a").where(F.col("best.rank_b") > F.col("rank_a"))
    asks = stage(asks.select(F.col("a").alias("node"), F.col("size_a").alias("size"), F.col("best.b").alias("to"), F.col("best.size_b").alias("held")), "shard-asks")
    return asks


def _moves(asks: DataFrame, places: int, turn: int) -> DataFrame:
    """(node, to): the labels that move in this round and what they become."""
    # Who is asked and asks itself moves or takes in by the toss of a coin.
    asked = asks.select(F.col("to").alias("node")).distinct().withColumn("asked", F.lit(True))
    tails = F.pmod(F.xxhash64("node", F.lit(-turn - 1)), F.lit(2)) == 1
    going = asks.join(asked, "node", "left").where(F.col("asked").isNull() | tails)
    busy = going.where("asked").select(F.col("node").alias("to"), F.lit(True).alias("busy"))
    going = join_hot(going.drop("asked"), busy, "to", "left").where("busy IS NULL").drop("busy")
    lined = placed(going.withColumn("draw", F.xxhash64("node")), "to", F.col("to"), [F.col("draw"), F.col("node")], "size", "shard-line").rows
    # What does not fit into the label that was asked falls into pieces of a shard's places.
    at = F.col("_run") + F.col("held")
    piece = F.expr("(_run + held) DIV CAST({} AS BIGINT)".format(places))
    lined = stage(lined.withColumn("piece", piece).where(at + F.col("size") <= (F.col("piece") + 1) * places).select("node", "to", "piece"), "shard-line")
    heads = lined.where("piece > 0").groupBy("to", "piece").agg(F.min("node").alias("head"))
    full = lined.where("piece > 0").join(F.broadcast(heads), ["to", "piece"])  # a piece is a whole shard: few
    found = lined.where("piece = 0").select("node", "to").unionByName(full.select("node", F.col("head").alias("to")))
    return stage(found.where("node <> to"), "shard-moves")


def _ends(nodes: DataFrame, moves: list[DataFrame]) -> DataFrame:
    """Where each node is after all moves.  A label moves once at most, so the moves are pointers in a forest,
    which are doubled until all of them show to a root."""
    now = nodes.select("node", F.col("node").alias("label"))
    if not moves:
        return stage(now, "shard-voted")
    every = moves[0]
    for more in moves[1:]:
        every = every.unionByName(more)
    now = stage(now.join(every, "node", "left").select("node", F.coalesce("to", "label").alias("label")), "shard-voted")
    far = 1
    while far < len(moves):
        beyond = now.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = stage(join_hot(now, beyond, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "shard-voted")
        far *= 2
    return now


def cut_links(links: DataFrame, shards: DataFrame) -> DataFrame:
    """(links, cut): how many of the links (a, b) there are, and how many lie between shards (node, shard)."""
    for side in "ab":
        links = join_hot(links, shards.select(F.col("node").alias(side), F.col("shard").alias(f"shard_{side}")), side)
    return links.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("shard_a") != F.col("shard_b")).alias("cut"))


def shard(docs: DataFrame, shards: int = 8, links=equal_text_links, rounds: int = 60) -> DataFrame:
    """Per row of (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's bytes in UTF-8 plus 1, a null text counting as empty.  The law is `rows`: the shards'
    numbers of rows are one apart at most.  slot counts the rows of a shard from 0 without gaps;
    grown_shard is null, as this law moves rows when shards are added.  `links` gives the edges between
    rows (a, b) from (node, doc_id, mark), by default between equal texts.  Groups are placed by size, the
    largest first; one is split only where no shard has room left for all of it.  Every row has a place of its own, repeated rows and null ids included;
    other columns are left out; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = utf8("text")
    nodes = stage(
        docs.select(
            F.monotonically_increasing_id().alias("node"), "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("mark"),
        ),
        "shard-rows",
    )
    total = nodes.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(links(nodes.select("node", "doc_id", "mark")), max(1, total // shards), rounds)
    groups = stage(labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "shard-groups")
    rows = nodes.drop("mark").join(join_hot(labels, groups, "label"), "node", "left").select(
        "node", "doc_id", "size", "text_crc32",
        F.coalesce("members", F.lit(1).cast("long")).alias("members"), F.coalesce("label", "node").alias("label"),
    )
    # In order: the largest groups first, each in one piece, what is linked with nothing at the end.
    rows = ranked(rows, [F.col("members").desc(), F.col("label"), F.col("node")], "shard-ranks")
    # One row per size of a group; sizes that differ add up to the rows, so they number no more than the root of
    # twice the rows: half a million for a hundred billion.
    kinds = rows.groupBy("members").count().collect()
    kinds = sorted(((r["members"], r["count"] // r["members"]) for r in kinds), reverse=True)
    rows = rows.join(F.broadcast(_by_kind(docs.sparkSession, kinds, _pack(kinds, targets))), "members")
    cut = F.element_at(F.filter("cuts", lambda c: c["start"] <= F.col("rank")), -1)
    return rows.withColumn("cut", cut).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("cut.shard").alias("shard"),
        (F.col("cut.slot") + F.col("rank") - F.col("cut.start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _pack(kinds: list[tuple[int, int]], targets: list[int]) -> list[tuple[int, int, int]]:
    """(first rank, shard, first slot) of consecutive rows.

    `kinds` are (members, groups) in the order of ranks.  The largest groups go first, each whole into the
    shard it leaves the least room in.  Only a group that no shard has room for fills the emptiest one, and
    what is left of it goes on as a smaller group.
    """
    waiting, start = [], 0
    for members, groups in kinds:
        waiting.append((-members, start, groups))
        start += members * groups
    heapq.heapify(waiting)
    free, cuts = list(targets), []

    def put(start: int, rows: int, s: int) -> int:
        cuts.append((start, s, targets[s] - free[s]))
        free[s] -= rows
        return start + rows

    while waiting:
        members, start, groups = heapq.heappop(waiting)
        members = -members
        for s in sorted(range(len(free)), key=free.__getitem__):
            n = min(groups, free[s] // members)
            if n:
                start, groups = put(start, n * members, s), groups - n
        if groups:
            s = max(range(len(free)), key=free.__getitem__)
            if groups > 1:
                heapq.heappush(waiting, (-members, start + members, groups - 1))
            heapq.heappush(waiting, (free[s] - members, start + free[s], 1))
            put(start, free[s], s)
    return sorted(cuts)


def _by_kind(spark: SparkSession, kinds: list[tuple[int, int]], cuts: list[tuple[int, int, int]]) -> DataFrame:
    """(members, cuts): the pieces of each kind, none of which reaches over its end."""
    rows, start = [], 0
    for members, groups in kinds:
        end = start + members * groups
        low, high = (bisect.bisect_left(cuts, (rank,)) for rank in (start, end))
        rows.append((members, cuts[low:high]))
        start = end
    return spark.createDataFrame(rows, "members bigint, cuts array<struct<start: bigint, shard: int, slot: bigint>>")
