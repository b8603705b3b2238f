"""Unbranched paths taken out of graphs, so that rounds of an iteration need not follow a path's length.

A node that one edge enters and one leaves is spliced: its path becomes one edge from the node before it to the node
after it, with the path's weight.  Parallel edges are then one (of least or most weight), so a bubble becomes a plain
edge, which may lie on an unbranched path in turn: levels follow how deep bubbles are nested, and a level's rounds
the logarithm of its longest path.  Edges: graph_id, src, dst, weight.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.loops import Scratch

G = "graph_id"
NODE = [G, "node"]
SPLICED = f"{G}, node, first, before, after, off, tail".split(", ")


def places(heads: DataFrame, going: DataFrame, work: Scratch, key: tuple[str, ...] = (G,)) -> tuple[DataFrame, DataFrame | None]:
    """(key, node, head, step) by pointer jumping over ``going`` (key, node, to, step) towards ``heads`` (key, node, head,
    step), and the rows that no head leads to (circles), if any.  A round doubles the reach; rows that have met their
    head leave, and a round in which none does ends it."""
    k, done = list(key), heads
    last = going = work.put(going.select(*k, "node", "to", "step"), "going")
    while not going.isEmpty():
        side = lambda df, to, met: df.select(*k, F.col("node").alias("to"), F.col(to).alias("further"), F.col("step").alias("more"), F.lit(met).alias("met"))
        ahead = side(done, "head", True).unionByName(side(going, "to", False))
        new = work.put(going.join(ahead, [*k, "to"]).select(*k, "node", F.col("further").alias("to"), (F.col("step") + F.col("more")).alias("step"), "met"), "going")
        arrived = work.put(new.where("met").select(*k, "node", F.col("to").alias("head"), "step"), "arrived")
        if arrived.isEmpty():
            return done, going
        done = done.unionByName(arrived)
        work.drop(last)
        last, going = new, new.where("not met").select(*k, "node", "to", "step")
    return done, None


def least_on_circles(prior: DataFrame, work: Scratch) -> DataFrame:
    """(graph_id, node, low): the least node of each node's circle.  ``prior``: graph_id, node, to, circles only."""
    low = work.put(prior.select(*NODE, "to", F.least("node", "to").alias("low")), "low")
    while True:
        ahead = low.select(G, F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("other"))
        new = work.put(low.join(ahead, [G, "to"]).select(*NODE, F.col("further").alias("to"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved")), "low")
        low = new.drop("moved")
        if new.where("moved").isEmpty():
            return low.select(*NODE, "low")


class Level(NamedTuple):
    """spliced: graph_id, node, first (of its path), before, after (the nodes that stay), off (weight from before to the
    node), tail (from it to after); edges: what is left; circles: graph_id, node, low of pure circles, or None."""

    spliced: DataFrame
    edges: DataFrame
    circles: DataFrame | None


def splice(edges: DataFrame, work: Scratch, keep: DataFrame | None = None, best=F.min) -> Level | None:
    """One level of ``edges`` (stored, distinct by ends), or None if there is nothing to splice.  ``keep`` (graph_id,
    node) stays; pure circles stay as they are."""
    into = edges.groupBy(G, F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("prior"), F.first("weight").alias("pw"))
    out = edges.groupBy(G, F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("next"), F.first("weight").alias("nw"))
    inner = into.where("i = 1").join(out.where("o = 1"), NODE).where("prior <> node").drop("i", "o")
    inner = work.put(inner if keep is None else inner.join(keep.select(*NODE), NODE, "left_anti"), "inner")
    if inner.isEmpty():
        return None
    flag = lambda c, name: inner.select(G, F.col("node").alias(c), F.lit(True).alias(name))
    flagged = work.put(inner.join(flag("prior", "p"), [G, "prior"], "left").join(flag("next", "n"), [G, "next"], "left"), "flagged")
    heads = flagged.where("p is null").select(*NODE, F.col("node").alias("head"), F.lit(0).cast("bigint").alias("step"))
    going = flagged.where("p").select(*NODE, F.col("prior").alias("to"), F.col("pw").cast("bigint").alias("step"))
    placed, left = places(heads, going, work)
    placed = work.put(placed, "placed")
    starts = flagged.where("p is null").select(G, F.col("node").alias("head"), F.col("prior").alias("before"), "pw")
    ends = flagged.where("n is null").join(placed, NODE).select(G, "head", F.col("next").alias("after"), (F.col("step") + F.col("nw")).alias("rest"))
    paths = work.put(starts.join(ends, [G, "head"]).select(G, "head", "before", "after", "pw", (F.col("pw") + F.col("rest")).alias("span")), "paths")
    spliced = work.put(placed.join(paths, [G, "head"]).select(*NODE, F.col("head").alias("first"), "before", "after", (F.col("pw") + F.col("step")).alias("off"), (F.col("span") - F.col("pw") - F.col("step")).alias("tail")), "spliced")
    gone = spliced.select(*NODE)
    rest = edges.join(gone.withColumnRenamed("node", "src"), [G, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [G, "dst"], "left_anti")
    new = rest.select(G, "src", "dst", "weight").unionByName(paths.select(G, F.col("before").alias("src"), F.col("after").alias("dst"), F.col("span").alias("weight")))
    new = work.put(new.groupBy(G, "src", "dst").agg(best("weight").alias("weight")), "edges")
    circles = None if left is None else least_on_circles(left.select(*NODE).join(flagged.select(*NODE, F.col("prior").alias("to")), NODE), work)
    return Level(spliced, new, circles)


def levels(edges: DataFrame, work: Scratch, keep: DataFrame | None = None, best=F.min, worth: float = 0.05) -> tuple[list[DataFrame], DataFrame]:
    """(spliced of each level, what is left): levels until one would take out less than ``worth`` of the edges.  Of each
    pure circle the least node stays."""
    out: list[DataFrame] = []
    while True:
        n = edges.count()
        level = splice(edges, work, keep, best) if n else None
        if level is None:
            return out, edges
        if level.circles is not None:
            least = level.circles.where("node = low").select(*NODE)
            keep = least if keep is None else keep.select(*NODE).unionByName(least)
        out.append(level.spliced)
        edges = level.edges
        if level.circles is None and n - edges.count() < worth * n:
            return out, edges
