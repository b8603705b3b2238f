"""Sharding by balanced label propagation over linked documents; DataFrame functions only.

Documents with equal texts are one node, weighted by their number.  Nodes that share a line of at least
``min_words`` words are linked through that line.  Each round is a pair of joins: a line takes the shard with
most weight of its nodes, votes counting less the fuller a shard is (and a line that is split over full shards
takes a roomy one), a node wishes for the shard that most of its lines are in.  What a shard takes in
is a quota: the weight that leaves it in the same round plus the room left under its capacity, shared in
proportion by those who wish to come; a hash of node and round decides who goes when wishes exceed it.

The law is ``rows``: shards' row counts differ by one at most.  Rows are put in order of their node's shard,
its heaviest line, and the node, and the order is cut into equal parts, so that what the quotas leave uneven is
settled at the fewest possible places and equal or linked texts stay together.

Defined results: a null text has size 1, CRC 0 and a node of its own kind; ids may be null or repeated; an
empty table gives no rows; a group larger than a shard is spread over neighbouring shards.  Nodes are told
apart by a 64-bit hash of the text, so two texts may at worst share a node, which costs nothing but the choice
of their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch

LOW_BITS = (1 << 33) - 1


def line_links(nodes: DataFrame, work: Scratch) -> DataFrame:
    """(node, line): the lines of each node that two nodes have at least.  ``nodes``: node, lines (hashes)."""
    pairs = nodes.select("node", F.explode("lines").alias("line"))
    shared = work.put(pairs.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "shared-lines")
    links = work.put(pairs.join(shared, "line"), "links")
    work.drop(shared)
    return links


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int, rounds: int, work: Scratch, slack: float = 0.1) -> DataFrame:
    """(node, weight, label, line): labels of linked nodes after ``rounds`` rounds under capacity quotas.

    ``nodes``: node, weight.  ``links``: node, line.  Nodes without links keep ``start_label``.  What changes from
    round to round reaches the plans as tables of a row a shard or pair of shards, so every round runs the same code.
    """
    spark = nodes.sparkSession
    loads = {r["label"]: r["load"] for r in nodes.groupBy(start_label(n_shards).alias("label")).agg(F.sum("weight").alias("load")).collect()}  # a row a shard
    capacity = sum(loads.values()) / n_shards * (1 + slack)
    before = work.put(links.select("node").distinct().join(nodes.select("node", "weight"), "node"), "linked")
    state = before.select("node", "weight", start_label(n_shards).alias("label"), F.lit(None).cast("bigint").alias("line"))
    for k in range(rounds):
        spare = {t: 0.1 + max(0.0, 1 - loads.get(t, 0) / max(capacity, 1)) for t in range(n_shards)}
        roomy = sorted(range(n_shards), key=lambda t: (-spare[t], t))[: max(1, n_shards // 4)]
        room = F.broadcast(values(spark, [(t, x, k, len(roomy)) for t, x in spare.items()], "label, spare, round, n_roomy"))  # a row a shard
        refuges = F.broadcast(values(spark, [(i, t, spare[t]) for i, t in enumerate(roomy)], "pick, refuge, refuge_spare"))
        votes = links.join(state.select("node", "weight", "label"), "node").groupBy("line", "label").agg(F.sum("weight").alias("votes"))
        scored = votes.join(room, "label").select("line", "round", "n_roomy", F.struct((F.col("votes") * F.col("spare")).alias("score"), (-F.col("label")).alias("l"), "votes").alias("s"))
        best = scored.groupBy("line").agg(F.max("s").alias("b"), F.count("*").alias("labels"), F.max("round").alias("round"), F.max("n_roomy").alias("n_roomy"))
        placed = best.withColumn("pick", F.pmod(F.xxhash64("line", "round"), F.col("n_roomy")).cast("int")).join(refuges, "pick")
        flees = (F.col("labels") > 1) & (F.col("b.score") < 0.5 * F.col("refuge_spare"))
        leads = work.put(placed.select("line", F.when(flees, F.col("refuge")).otherwise(-F.col("b.l")).alias("lead"), F.col("b.votes").alias("votes")), "leads")
        offers = links.join(leads, "line").groupBy("node", "lead").agg(F.count("*").alias("n"), F.max(F.struct("votes", "line")).alias("top"))
        wants = offers.groupBy("node").agg(F.max(F.struct("n", F.col("top.votes"), (-F.col("lead")).alias("l"), F.col("top.line"))).alias("b")).select("node", (-F.col("b.l")).alias("want"), F.col("b.line").alias("heavy"))
        wishes = work.put(state.select("node", "weight", "label").join(wants, "node"), "wishes")
        work.drop(before, leads)
        before = wishes
        flows = {(r["label"], r["want"]): r["w"] for r in wishes.where((F.col("label") != F.col("want")) & (F.col("weight") <= capacity)).groupBy("label", "want").agg(F.sum("weight").alias("w")).collect()}  # n_shards squared at most
        share = quotas(flows, {t: max(0.0, capacity - loads.get(t, 0)) for t in range(n_shards)})
        allowed = F.broadcast(values(spark, [(a, b, p, k) for (a, b), p in share.items()] + [(-1, -1, 0.0, k)], "label, want, share, round"))  # n_shards squared at most
        dice = F.pmod(F.xxhash64("node", "round"), F.lit(1 << 20)) / (1 << 20)
        goes = F.coalesce((dice < F.col("share")) & (F.col("weight") <= F.lit(float(capacity))), F.lit(False))
        moved = wishes.join(allowed, ["label", "want"], "left").withColumn("to", F.when(goes, F.col("want")).otherwise(F.col("label")))
        for r in moved.where("label <> to").groupBy("label", "to").agg(F.sum("weight").alias("w")).collect():  # n_shards squared at most
            loads[r["label"]] = loads.get(r["label"], 0) - r["w"]
            loads[r["to"]] = loads.get(r["to"], 0) + r["w"]
        state = moved.select("node", "weight", F.col("to").alias("label"), F.col("heavy").alias("line"))
    return state


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of numbers, as SQL values."""
    body = ", ".join("(" + ", ".join(f"{x!r}D" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def quotas(flows: dict[tuple[int, int], int], room: dict[int, float], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The share of each wished flow that may go: a shard takes in what leaves it and what it has room for."""
    take = dict.fromkeys(room, 1.0)
    for _ in range(rounds):
        into, out = dict.fromkeys(room, 0.0), dict.fromkeys(room, 0.0)
        for (a, b), w in flows.items():
            into[b] += w
            out[a] += w * take[b]
        take = {t: min(1.0, (out[t] + room[t]) / into[t]) if into[t] else 1.0 for t in room}
    return {(a, b): take[b] for a, b in flows}


def start_label(n_shards: int) -> Column:
    return F.pmod(F.col("node"), F.lit(n_shards)).cast("int")


def numbered(df: DataFrame, work: Scratch, *order: str) -> DataFrame:
    """``df`` with ``position`` (gapless from 0 in ``order``) and ``total``: a range sort, then one count a partition."""
    placed = work.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"), F.sum("__n").over(W.partitionBy()).alias("total"))
    # a row for each partition of the range sort
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("position", F.col("__before") + F.col("__at").bitwiseAND(F.lit(LOW_BITS))).drop("__part", "__at", "__before")


def shard(docs: DataFrame, n_shards: int = 16, rounds: int = 6, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard, label (the shard
    that propagation chose), node."""
    work = Scratch(docs.sparkSession)
    text = F.col("text")
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.size(F.split(x, " ")) >= min_words), lambda x: F.xxhash64(x)))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = work.put(read.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("node"), keys.alias("lines")), "rows")
    nodes = work.put(rows.groupBy("node").agg(F.count("*").alias("weight"), F.first("lines").alias("lines")), "nodes")
    links = line_links(nodes, work)
    state = work.put(propagate(nodes, links, n_shards, rounds, work).select("node", "label", "line"), "labels")
    work.keep(rows, state)
    named = rows.drop("lines").join(state, "node", "left").select("id", "size", "text_crc32", "node", F.coalesce("label", start_label(n_shards)).alias("label"), F.coalesce("line", "node").alias("line"))
    at = numbered(named, work, "label", "line", "node", "id")
    work.drop(rows, state)
    base, more = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    large = more * (base + 1)
    early = F.col("position") < large
    late = F.greatest(base, F.lit(1))
    place = F.when(early, F.floor(F.col("position") / (base + 1))).otherwise(more + F.floor((F.col("position") - large) / late))
    slot = F.when(early, F.col("position") % (base + 1)).otherwise((F.col("position") - large) % late)
    return at.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), place.cast("int").alias("shard"), slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "label", "node")


def cut_weight(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: lines, and how many (line, shard) meetings exceed one a line; ``assigned`` has node and shard."""
    met = links.join(assigned.select("node", "shard").distinct(), "node").select("line", "shard").distinct()
    return met.groupBy("line").agg(F.count("*").alias("n")).agg(F.count("*").alias("lines"), F.sum(F.col("n") - 1).alias("cut"))
