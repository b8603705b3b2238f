"""Graph operators, keyed by graph_id: one job serves many graphs.

Tables: links (graph_id, src, dst, src_orient, dst_orient, line_no), edges (graph_id, src, dst; distinct), nodes
(graph_id, node).  Loops end by a count or a digest and keep their state in checkpoints; work of a round
follows what changed in the one before where that can be had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import small_graphs, splice
from strandloom.operators.loops import Scratch, cut, fingerprint, table_of

EDGE = ["graph_id", "src", "dst"]
NODE = ["graph_id", "node"]
STATS = ("nodes", "edges", "self_loops", "wcc", "largest_wcc", "scc", "largest_scc", "has_cycle")


def simple_edges(links: DataFrame) -> DataFrame:
    """One edge for parallel links, with the orientations of the last."""
    return links.groupBy(*EDGE).agg(F.max_by(F.struct("src_orient", "dst_orient"), "line_no").alias("o")).select(*EDGE, "o.*")


def all_nodes(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Declared segments and the ends of links."""
    end = lambda c: links.select("graph_id", F.col(c).alias("node"))
    return segments.select(*NODE).unionByName(end("src")).unionByName(end("dst")).distinct()


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, in_degree, out_degree, degree over distinct edges; one shuffle."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("graph_id", "e.*")
    return ends.groupBy(*NODE).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def branching_nodes(degree: DataFrame) -> DataFrame:
    return degree.where("in_degree > 1 or out_degree > 1")


def minus(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select(*EDGE), EDGE, "left_anti")


def add_if_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` that they lack; synthetic tells them apart."""
    flag = lambda df, v: df.select(*EDGE, F.lit(v).alias("synthetic"))
    return flag(edges, False).unionByName(flag(new.join(edges.select(*EDGE), EDGE, "left_anti").select(*EDGE).distinct(), True))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(nodes.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_semi")
    return kept.select(*edges.columns)


def top_degree_nodes(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of each graph of highest degree, ties to the smaller name."""
    w = W.partitionBy("graph_id").orderBy(F.desc("degree"), "node")
    return degrees(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_degree_subgraph(edges: DataFrame, k: int = 400) -> DataFrame:
    return induced(edges, top_degree_nodes(edges, k))


def each_graph(edges: DataFrame, solve: Callable, names: tuple[str, ...], types: tuple[str, ...], rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """graph_id and ``names``: small graphs by ``solve``, all in one shuffle, others by ``rounds`` over their edges.  The
    edges are written first, as they are read twice."""
    work = Scratch(edges.sparkSession)
    small, large = small_graphs.parted(work.put(edges.select(*EDGE), "edges"), work)
    found = small_graphs.solved(small, solve, names, types)
    return found if large is None else found.unionByName(rounds(large))


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(graph_id, node, component): the smallest node reachable over undirected edges; alternating star rounds,
    about as many as the logarithm of a component's size; more than ``max_rounds`` are an error.  The join that
    brings a hub's root to its neighbours has a stored table of one row a node on its other side."""
    nodes = edge_nodes(edges) if nodes is None else nodes
    g = "graph_id"
    star = table_of(edges.select(g, F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct(), "star")
    for _ in range(max_rounds):
        both = star.select(g, F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(star.select(g, F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = table_of(both.groupBy(g, "n").agg(F.min("m").alias("m0")).select(g, "n", F.least("n", "m0").alias("root")), "least")
        large = both.where("m > n").join(least, [g, "n"]).select(g, F.col("m").alias("hi"), F.col("root").alias("lo")).distinct()
        roots = large.groupBy(g, "hi").agg(F.min("lo").alias("root"))
        lower = large.join(roots, [g, "hi"]).select(g, F.col("lo").alias("hi"), F.col("root").alias("lo")).where("hi <> lo")
        new = table_of(lower.unionByName(roots.select(g, "hi", F.col("root").alias("lo"))).distinct(), "star")
        done = fingerprint(new, g, "hi", "lo") == fingerprint(star, g, "hi", "lo")
        star = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.select(*NODE).join(star.select(g, F.col("hi").alias("node"), "lo"), NODE, "left").select(*NODE, F.coalesce("lo", "node").alias("component"))


#: Rounds of plain expansion or peeling before a graph counts as deep and its paths are contracted.
SHALLOW = 8


def hop_distance(edges: DataFrame, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(graph_id, src, dst, hops): least number of edges from each source (all nodes unless given), itself at 0;
    pairs without a path have no row.  A round extends only the pairs found in the one before.

    All pairs of small graphs are found in one shuffle.  Graphs that eight rounds do not settle are contracted first:
    unbranched paths and bubbles become weighted edges, rounds run over what is left, and distances to and from the
    nodes taken out follow from those of the nodes beside them.
    """
    if sources is None and max_hops is None:
        small, large = small_graphs.parted(edges, Scratch(edges.sparkSession))
        found = small_graphs.solved(small, small_graphs.distances, ("src", "dst", "hops"), ("node", "node", "int"))
        return found if large is None else found.unionByName(_hops_in_rounds(large, None, None))
    return _hops_in_rounds(edges, sources, max_hops)


def _hops_in_rounds(edges: DataFrame, sources: DataFrame | None, max_hops: int | None) -> DataFrame:
    start = (edge_nodes(edges) if sources is None else sources).select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops")).distinct()
    step = cut(edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("next")).distinct())
    known = delta = cut(start)
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        reached = delta.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("next").alias("dst")).distinct()
        delta = cut(reached.join(known, EDGE, "left_anti").withColumn("hops", F.lit(hops)))
        if delta.isEmpty():
            break
        known = cut(known.unionByName(delta)) if hops % 8 == 0 else known.unionByName(delta)
        if hops == SHALLOW and (max_hops is None or max_hops > 4 * SHALLOW):
            return _deep_hops(step.select("graph_id", F.col("dst").alias("src"), F.col("next").alias("dst")), start.select("graph_id", F.col("src").alias("node")), sources is None, max_hops)
    return known


def _deep_hops(edges: DataFrame, sources: DataFrame, every: bool, max_hops: int | None) -> DataFrame:
    """``hop_distance`` over contracted graphs; ``sources`` stay, unless they are all nodes (``every``)."""
    g, work = "graph_id", Scratch(edges.sparkSession)
    weighted = work.put(edges.where("src <> dst").select(*EDGE, F.lit(1).cast("bigint").alias("weight")), "weighted")
    taken, left = splice.levels(weighted, work, None if every else sources)
    start = sources
    for t in taken if every else []:
        start = start.join(t.select(*NODE), NODE, "left_anti")
    known = work.put(start.select(g, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("bigint").alias("hops")), "known")
    delta = known
    while not delta.isEmpty():  # a round sends on the distances that the last one lowered
        offers = delta.join(left.select(g, F.col("src").alias("dst"), F.col("dst").alias("next"), "weight"), [g, "dst"]).groupBy(g, "src", F.col("next").alias("dst")).agg(F.min(F.col("hops") + F.col("weight")).alias("offer"))
        if max_hops is not None:
            offers = offers.where(F.col("offer") <= max_hops)
        new = work.put(known.join(offers, EDGE, "full_outer").select(*EDGE, F.least("hops", "offer").alias("hops"), (F.col("offer") < F.coalesce("hops", F.lit(1 << 62))).alias("moved")), "known")
        known, delta = new.drop("moved"), new.where("moved").drop("moved")
    for t in reversed(taken):  # each level's nodes from the nodes beside their paths
        enter = t.select(g, F.col("before").alias("dst"), F.col("node").alias("inner"), "off")
        reached = known.unionByName(known.join(enter, [g, "dst"]).select(g, "src", F.col("inner").alias("dst"), (F.col("hops") + F.col("off")).alias("hops")))
        if every:
            leave = t.select(g, F.col("after").alias("src"), F.col("node").alias("inner"), "tail")
            ahead = t.select(g, "first", F.col("node").alias("src"), F.col("off").alias("a")).join(t.select(g, "first", F.col("node").alias("dst"), F.col("off").alias("b")), [g, "first"]).where("a <= b").select(*EDGE, (F.col("b") - F.col("a")).alias("hops"))
            reached = reached.unionByName(reached.join(leave, [g, "src"]).select(g, F.col("inner").alias("src"), "dst", (F.col("hops") + F.col("tail")).alias("hops"))).unionByName(ahead)
            reached = reached.groupBy(*EDGE).agg(F.min("hops").alias("hops"))
        known = work.put(reached if max_hops is None else reached.where(F.col("hops") <= max_hops), "known")
    work.keep(known)
    return known.withColumn("hops", F.col("hops").cast("int"))


def reachability(edges: DataFrame, sources: DataFrame | None = None, reflexive: bool = True) -> DataFrame:
    """(graph_id, src, dst) of reachable pairs; without ``reflexive``, a node's own pair needs a cycle."""
    pairs = hop_distance(edges, sources)
    if reflexive:
        return pairs.select(*EDGE)
    onward = edges.select("graph_id", F.col("src").alias("first"), F.col("dst").alias("src"))
    return onward.join(pairs, ["graph_id", "src"]).select("graph_id", F.col("first").alias("src"), "dst").distinct()


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, scc): scc is the smallest node of the component.

    Small graphs are solved in one shuffle.  In others a round trims nodes that no edge enters or none leaves; then unbranched
    paths and bubbles are spliced, or in every other round (and where there are none) each node points at one node before it (at
    one that it also leads to, if any), and the circles of these pointers, all at once, become single nodes.  A spliced node belongs to a component if the nodes on both sides
    of its path do, which is read back in the end, last round first.  Each round takes out nodes of every part that is
    left, so it needs no bound; what is left of a graph leaves the rounds as soon as one task can hold it.
    """
    nodes = edge_nodes(edges) if nodes is None else nodes
    work = Scratch(edges.sparkSession)
    small, large = small_graphs.parted(edges.where("src <> dst").select(*EDGE).distinct(), work)
    named = small_graphs.solved(small, small_graphs.components, ("node", "least"), ("node", "node"))
    if large is not None:
        named = named.unionByName(_components_in_rounds(large, work))
    named = work.put(named, "named")
    work.keep(named)
    return nodes.select(*NODE).join(named, NODE, "left").select(*NODE, F.coalesce("least", "node").alias("scc"))


def _components_in_rounds(edges: DataFrame, work: Scratch) -> DataFrame:
    """(graph_id, node, least) of the nodes in components of several, by rounds over all graphs of ``edges``."""
    g = "graph_id"
    left = work.put(edges.select(*EDGE, F.lit(1).cast("bigint").alias("weight")), "left")
    undo, turn = [], 0
    while True:
        left = _trimmed(left, work)
        if left.isEmpty():
            break
        few, left = small_graphs.parted(left, work, small_graphs.LINEAR * small_graphs.SMALL)
        ended = work.put(small_graphs.components_in_turn(few), "ended")
        undo.append(ended.where("node <> least").select(*NODE, F.col("least").alias("before"), F.col("least").alias("after")))
        if left is None:
            break
        turn += 1
        if turn % 2 and (level := splice.splice(left, work)) is not None:  # the turns between merge circles
            undo.append(level.spliced.select(*NODE, "before", "after"))
            left = level.edges
            if level.circles is not None:  # a component of its own
                undo.append(level.circles.where("node <> low").select(*NODE, F.col("low").alias("before"), F.col("low").alias("after")))
                left = left.join(level.circles.select(g, F.col("node").alias("src")), [g, "src"], "left_anti")
            left = work.put(left.where("src <> dst"), "left")
            continue
        merged = _pointer_circles(left, work, turn)
        undo.append(merged.select(*NODE, F.col("low").alias("before"), F.col("low").alias("after")))
        name = lambda end: merged.select(g, F.col("node").alias(end), F.col("low").alias(f"{end}_low"))
        moved = left.join(name("src"), [g, "src"], "left").join(name("dst"), [g, "dst"], "left").select(g, F.coalesce("src_low", "src").alias("src"), F.coalesce("dst_low", "dst").alias("dst"), F.lit(1).cast("bigint").alias("weight"))
        left = work.put(moved.where("src <> dst").distinct(), "left")
    # names of components by node, for nodes that were merged or spliced; the rest stand for themselves
    found = None
    for u in reversed(undo):
        if found is None:
            found = work.put(u.where("before = after").select(*NODE, F.col("before").alias("scc")), "found")
            continue
        side = lambda end, name: found.select(g, F.col("node").alias(end), F.col("scc").alias(name))  # noqa: B023, E731
        both = u.join(side("before", "a"), [g, "before"], "left").join(side("after", "b"), [g, "after"], "left").select(*NODE, F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
        found = work.put(found.unionByName(both.where("a = b").select(*NODE, F.col("a").alias("scc"))), "found")
    if found is None:
        return edges.select(g, F.col("src").alias("node"), F.col("src").alias("least")).limit(0)
    least = found.groupBy(g, "scc").agg(F.min("node").alias("m")).select(g, "scc", F.least("m", "scc").alias("least"))
    return found.join(least, [g, "scc"]).select(*NODE, "least").unionByName(least.select(g, F.col("scc").alias("node"), "least"))


def _trimmed(edges: DataFrame, work: Scratch, rounds: int = 2) -> DataFrame:
    """``edges`` less those at nodes that no edge enters or none leaves, a few layers deep."""
    trimmed = edges
    for _ in range(rounds):
        into = trimmed.select("graph_id", F.col("dst").alias("src"))
        out = trimmed.select("graph_id", F.col("src").alias("dst"))
        trimmed = trimmed.join(into, ["graph_id", "src"], "left_semi").join(out, ["graph_id", "dst"], "left_semi").select(*EDGE, "weight")
    return work.put(trimmed, "left")


def _pointer_circles(edges: DataFrame, work: Scratch, turn: int) -> DataFrame:
    """(graph_id, node, low) of the nodes of circles, other than the least of each, among one pointer a node.  Where the
    ends of pointers of length n and of length 2 n are the same set, all of them are on circles."""
    g = "graph_id"
    back = edges.select(g, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("far"))
    choice = F.min(F.struct(F.coalesce("far", F.lit(1)), F.xxhash64("src", F.lit(turn)), F.col("src"))).alias("c")
    at = edges.join(back, EDGE, "left").groupBy(g, F.col("dst").alias("node")).agg(choice).select(*NODE, F.col("c.src").alias("to"))
    # a node that no edge enters has no pointer, and pointers that end there leave
    at = work.put(at.select(*NODE, "to", F.least("node", "to").alias("low")), "pointers")
    ends = -1
    while True:
        ahead = at.select(g, F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("other"))
        at = work.put(at.join(ahead, [g, "to"]).select(*NODE, F.col("further").alias("to"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved")), "pointers")
        n, moved = at.agg(F.count_distinct(F.struct(g, "to")), F.coalesce(F.max("moved"), F.lit(False))).first()
        if n == ends and not moved:
            break
        ends = n
    on = at.select(g, F.col("to").alias("node")).distinct()
    return work.put(at.join(on, NODE, "left_semi").where("node <> low").select(*NODE, "low"), "circles")


def cyclic_nodes(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node): in a component of several nodes, or with an edge to itself."""
    large = scc.groupBy("graph_id", "scc").agg(F.count("*").alias("n")).where("n > 1")
    loops = edges.where("src = dst").select("graph_id", F.col("src").alias("node"))
    return scc.join(large, ["graph_id", "scc"], "left_semi").select(*NODE).unionByName(loops).distinct()


def has_cycle(edges: DataFrame) -> DataFrame:
    """(graph_id, has_cycle) of every graph with an edge."""
    cyclic = cyclic_nodes(strong_components(edges), edges).select("graph_id").distinct().withColumn("has_cycle", F.lit(True))
    return edges.select("graph_id").distinct().join(cyclic, "graph_id", "left").select("graph_id", F.coalesce("has_cycle", F.lit(False)).alias("has_cycle"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: nodes, edges, self_loops, weak and strong components, the largest of each, has_cycle."""
    rows = edges.select(*EDGE).where("dst is not null").unionByName(nodes.select("graph_id", F.col("node").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")))
    own = lambda df: df.where("dst is null").select("graph_id", F.col("src").alias("node"))
    return each_graph(rows, small_graphs.stats, STATS, ("bigint",) * 7 + ("boolean",), lambda r: _stats_in_rounds(own(r), r.where("dst is not null")))


def _stats_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    weak, strong = weak_components(edges, nodes), strong_components(edges, nodes)

    def sizes(df: DataFrame, key: str, many: str, largest: str) -> DataFrame:
        return df.groupBy("graph_id", key).agg(F.count("*").alias("n")).groupBy("graph_id").agg(F.count("*").alias(many), F.max("n").alias(largest))

    counts = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    links = edges.groupBy("graph_id").agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    out = counts.join(links, "graph_id", "left").join(sizes(weak, "component", "wcc", "largest_wcc"), "graph_id").join(sizes(strong, "scc", "scc", "largest_scc"), "graph_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("graph_id", "nodes", zero("edges"), zero("self_loops"), "wcc", "largest_wcc", "scc", "largest_scc", ((F.col("largest_scc") > 1) | (F.coalesce("self_loops", F.lit(0)) > 0)).alias("has_cycle"))


def back_edges(edges: DataFrame) -> DataFrame:
    """Edges whose removal leaves no cycle: within a strong component, those that do not climb (depth, node), depth
    being the hops from its smallest node; self-loops always, edges between components never."""
    scc = strong_components(edges)
    a = scc.select("graph_id", F.col("node").alias("src"), F.col("scc").alias("a"))
    b = scc.select("graph_id", F.col("node").alias("dst"), F.col("scc").alias("b"))
    inside = cut(edges.select(*EDGE).join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("a = b").select(*EDGE, F.col("a").alias("scc")))
    depth = hop_distance(inside, inside.select("graph_id", F.col("scc").alias("node")).distinct())
    d = lambda end, name: depth.select("graph_id", F.col("src").alias("scc"), F.col("dst").alias(end), F.col("hops").alias(name))
    ranked = inside.join(d("src", "hs"), ["graph_id", "scc", "src"]).join(d("dst", "hd"), ["graph_id", "scc", "dst"])
    return ranked.where(F.struct("hs", "src") >= F.struct("hd", "dst")).select(*EDGE)


def to_dag(edges: DataFrame) -> DataFrame:
    """``edges`` without the back edges; an error if a cycle were left."""
    dag = cut(minus(edges, back_edges(edges)))
    if not dag.isEmpty() and has_cycle(dag).where("has_cycle").count():
        raise RuntimeError("a cycle is left")
    return dag


def topological_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, layer, is_dag): layer is the most edges on a path that ends in the node.  Nodes of graphs
    with a cycle have layer 0, so that (layer, node) is the order by name there.

    Peels nodes that no edge enters.  What eight rounds leave is contracted first, with the longest of parallel paths
    as weight, and peeled by weights; layers of the nodes taken out follow from those before them.
    """
    g, work = "graph_id", Scratch(edges.sparkSession)
    nodes = work.put(edge_nodes(edges) if nodes is None else nodes.select(*NODE).distinct(), "nodes")
    left = work.put(edges.select(*EDGE, F.lit(1).cast("bigint").alias("weight")).distinct(), "left")
    state = work.put(nodes.withColumn("layer", F.lit(0).cast("bigint")), "state")  # the layer as far as known
    rest, peeled, taken, turn = state, [], [], 0
    while True:
        entered = left.select(g, F.col("dst").alias("node")).distinct()
        free = work.put(rest.join(entered, NODE, "left_anti"), "free")
        if free.isEmpty():
            break
        peeled.append(free)
        gone = left.join(free.select(g, F.col("node").alias("src"), "layer"), [g, "src"])
        raised = gone.groupBy(g, F.col("dst").alias("node")).agg(F.max(F.col("layer") + F.col("weight")).alias("offer"))
        rest = work.put(rest.join(free.select(*NODE), NODE, "left_anti").join(raised, NODE, "left").select(*NODE, F.greatest("layer", F.coalesce("offer", "layer")).alias("layer")), "rest")
        left = work.put(left.join(free.select(g, F.col("node").alias("src")), [g, "src"], "left_anti"), "left")
        turn += 1
        if turn == SHALLOW and not left.isEmpty():
            # nodes that a peeled node led to keep what it gave them, so they stay
            taken, left = splice.levels(left, work, rest.where("layer > 0"), best=F.max)
            for t in taken:
                rest = rest.join(t.select(*NODE), NODE, "left_anti")
            rest = work.put(rest, "rest")
    placed = peeled[0] if peeled else rest.limit(0)
    for x in peeled[1:]:
        placed = placed.unionByName(x)
    placed, cyclic = work.put(placed, "placed"), [rest.select(g)]
    for t in reversed(taken):
        inner = t.join(placed.select(g, F.col("node").alias("before"), "layer"), [g, "before"], "left")
        cyclic.append(inner.where("layer is null").select(g))
        placed = work.put(placed.unionByName(inner.where("layer is not null").select(*NODE, (F.col("layer") + F.col("off")).alias("layer"))), "placed")
    bad = cyclic[0]
    for c in cyclic[1:]:
        bad = bad.unionByName(c)
    bad = bad.distinct().withColumn("cyclic", F.lit(True))
    out = work.put(nodes.join(placed, NODE, "left").join(bad, g, "left").select(*NODE, F.when(F.col("cyclic"), 0).otherwise(F.col("layer")).cast("int").alias("layer"), F.col("cyclic").isNull().alias("is_dag")), "order")
    work.keep(out)
    return out


def path_cover(dag: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, path, step): node-disjoint paths that cover all nodes, each step an edge; path is the name
    of its first node, step counts from 0.

    Rounds of proposals: each node without a successor offers itself to its free successor of least (layer,
    name), and each such successor takes the offer of least (layer, name).  Pointer jumping then numbers the paths.
    """
    order = cut(topological_order(dag, nodes))
    rank = lambda end, name: order.select("graph_id", F.col("node").alias(end), F.struct("layer", "node").alias(name))
    free = cut(dag.select(*EDGE).distinct().join(rank("src", "rs"), ["graph_id", "src"]).join(rank("dst", "rd"), ["graph_id", "dst"]))
    chosen = None
    while not free.isEmpty():
        offers = free.groupBy("graph_id", "src").agg(F.min(F.struct("rd", "dst", "rs")).alias("o")).select("graph_id", "src", "o.dst", "o.rs")
        taken = cut(offers.groupBy("graph_id", "dst").agg(F.min(F.struct("rs", "src")).alias("o")).select("graph_id", "o.src", "dst"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        free = cut(free.join(taken.select("graph_id", "src"), ["graph_id", "src"], "left_anti").join(taken.select("graph_id", "dst"), ["graph_id", "dst"], "left_anti"))
    every = order.select(*NODE)
    if chosen is None:
        return every.select(*NODE, F.col("node").alias("path"), F.lit(0).alias("step"))
    # each node points at an earlier node of its path and knows how many steps away that is
    at = cut(every.join(chosen.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("to")), NODE, "left").select(*NODE, F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("step")))
    while True:
        ahead = at.select("graph_id", F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("step").alias("more"))
        new = cut(at.join(ahead, ["graph_id", "to"]).select(*NODE, F.col("beyond").alias("to"), (F.col("step") + F.col("more")).alias("step"), (F.col("more") > 0).alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").count():
            return at.select(*NODE, F.col("to").alias("path"), "step")


def covers(cover: DataFrame, nodes: DataFrame) -> bool:
    """Whether the cover's nodes are the graph's nodes, each once."""
    a, b = cover.select(*NODE), nodes.select(*NODE).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def add_cycles(edges: DataFrame) -> DataFrame:
    """``edges`` with a synthetic flag: acyclic graphs of four nodes or more gain (last, second) and (last but one,
    first) in topological order, unless present."""
    order = topological_order(edges).where("is_dag")
    ends = order.groupBy("graph_id").agg(F.count("*").alias("n"), F.min(F.struct("layer", "node")).alias("first"), F.max(F.struct("layer", "node")).alias("last")).where("n >= 4")
    inner = order.join(ends, "graph_id").where((F.struct("layer", "node") != F.col("first")) & (F.struct("layer", "node") != F.col("last")))
    seconds = inner.groupBy("graph_id").agg(F.min(F.struct("layer", "node")).alias("second"), F.max(F.struct("layer", "node")).alias("before"))
    both = ends.join(seconds, "graph_id").select("graph_id", F.explode(F.array(F.struct(F.col("last.node").alias("src"), F.col("second.node").alias("dst")), F.struct(F.col("before.node").alias("src"), F.col("first.node").alias("dst")))).alias("e")).select("graph_id", "e.*")
    return add_if_absent(edges, both)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(graph_id, src, dst, path): a path of fewest edges (of ``max_hops`` at most, if given) for each wanted pair that
    has one, the least by names.

    Rounds go back from each dst and note for every node reached the least of the nodes after it (one pointer a node
    and dst), until all of the dst's sources are found; the paths are then read off the pointers from their sources.
    """
    g, work = "graph_id", Scratch(edges.sparkSession)
    want = work.put(pairs.select(*EDGE).distinct(), "want")
    back = work.put(edges.select(g, F.col("dst").alias("node"), F.col("src").alias("prior")).distinct(), "back")
    known = front = work.put(want.select(g, "dst", F.col("dst").alias("node"), F.col("dst").alias("next")).distinct(), "front")
    hops, open_ = 0, want.where("src <> dst")
    while max_hops is None or hops < max_hops:
        hops += 1
        front = front.join(open_.select(g, "dst").distinct(), [g, "dst"], "left_semi")
        new = front.join(back, [g, "node"]).groupBy(g, "dst", F.col("prior").alias("node")).agg(F.min("node").alias("next"))
        front = work.put(new.join(known, [g, "dst", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
        known = work.put(known, "known") if hops % SHALLOW == 0 else known
        open_ = work.put(open_.join(front.select(g, "dst", F.col("node").alias("src")), EDGE, "left_anti"), "open")
    at = work.put(want.join(known.select(g, "dst", F.col("node").alias("src")), EDGE, "left_semi").select(*EDGE, F.col("src").alias("node"), F.lit(0).alias("pos")), "walk")
    walked = at
    while not at.isEmpty():
        at = work.put(at.where("node <> dst").join(known, [g, "dst", "node"]).select(*EDGE, F.col("next").alias("node"), (F.col("pos") + 1).alias("pos")), "walk")
        walked = walked.unionByName(at)
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    paths = work.put(walked.groupBy(*EDGE).agg(names.alias("path")), "paths")
    work.keep(paths)
    return pairs.join(paths, EDGE).select(*EDGE, "path")


def representative_nodes(edges: DataFrame, limit: int = 18, hubs: int = 6) -> DataFrame:
    """(graph_id, node): all nodes of graphs within ``limit``; else hubs by degree, the shortest paths between
    consecutive hubs (by name order of their ranks), and further nodes in topological order, up to ``limit``."""
    one = lambda es: [(n,) for n in small_graphs.representatives(es, limit, hubs)]
    return each_graph(edges, one, ("node",), ("node",), lambda e: _representatives_in_rounds(e, limit, hubs))


def _representatives_in_rounds(edges: DataFrame, limit: int, hubs: int) -> DataFrame:
    order = topological_order(edges)
    size = order.groupBy("graph_id").agg(F.count("*").alias("n"))
    top = top_degree_nodes(edges, min(hubs, limit))
    w = W.partitionBy("graph_id").orderBy("rank")
    pairs = top.withColumn("dst", F.lead("node").over(w)).where("dst is not null").select("graph_id", F.col("node").alias("src"), "dst")
    links = shortest_paths(edges, pairs).select("graph_id", F.explode("path").alias("node"))
    want = top.select(*NODE, F.lit(0).alias("class")).unionByName(links.select(*NODE, F.lit(1).alias("class"))).groupBy(*NODE).agg(F.min("class").alias("class"))
    every = order.join(want, NODE, "left").join(size, "graph_id")
    pick = F.row_number().over(W.partitionBy("graph_id").orderBy(F.coalesce("class", F.lit(2)), "layer", "node"))
    return every.withColumn("pick", pick).where((F.col("n") <= limit) | (F.col("pick") <= limit)).select(*NODE)


def representative_subgraph(edges: DataFrame, limit: int = 18, hubs: int = 6) -> DataFrame:
    return induced(edges, representative_nodes(edges, limit, hubs))


def sample_walk(edges: DataFrame, max_steps: int = 8) -> DataFrame:
    """(graph_id, pos, node): a shortest cycle through the least cyclic node, closed, of max_steps + 1 nodes at most;
    in acyclic graphs the first ``max_steps`` nodes in topological order."""
    return each_graph(edges, small_graphs.walk(max_steps), ("pos", "node"), ("int", "node"), lambda e: _walk_in_rounds(e, max_steps))


def _walk_in_rounds(edges: DataFrame, max_steps: int) -> DataFrame:
    cyclic = cyclic_nodes(strong_components(edges), edges)
    start = cyclic.groupBy("graph_id").agg(F.min("node").alias("src"))
    first = start.join(edges, ["graph_id", "src"]).select("graph_id", F.col("src").alias("home"), F.col("dst").alias("src"))
    back = shortest_paths(edges, first.select("graph_id", "src", F.col("home").alias("dst"))).withColumnRenamed("dst", "home")
    loop = back.groupBy("graph_id", "home").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select("graph_id", F.posexplode(F.slice(F.concat(F.array("home"), F.col("p.path")), 1, max_steps + 1)).alias("pos", "node"))
    order = topological_order(edges).where("is_dag")
    w = W.partitionBy("graph_id").orderBy("layer", "node")
    line = order.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < max_steps).select("graph_id", "pos", "node")
    return loop.unionByName(line)


def walk_sequence(walk: DataFrame, segments: DataFrame, seg: int = 10) -> DataFrame:
    """(graph_id, sequence): the first ``seg`` bases of each node of the walk, N after even places but the last;
    A for a walk without bases."""
    rows = walk.join(segments.select(*NODE, F.substring("sequence", 1, seg).alias("s")), NODE, "left")
    pieces = rows.groupBy("graph_id").agg(F.collect_list(F.struct("pos", F.coalesce("s", F.lit("")).alias("s"))).alias("p"), F.max("pos").alias("last"))
    text = F.array_join(F.transform(F.array_sort("p"), lambda x: F.concat(x["s"], F.when((x["pos"] % 2 == 0) & (x["pos"] < F.col("last")), "N").otherwise(""))), "")
    return pieces.select("graph_id", text.alias("t")).select("graph_id", F.when(F.col("t") == "", "A").otherwise(F.col("t")).alias("sequence"))


def context_snapshot(edges: DataFrame, limit: int = 18, hubs: int = 6) -> DataFrame:
    """(graph_id, stage, nodes, edges, node_list): the graph, its representative part, and that with cycles added."""
    return each_graph(edges, small_graphs.snapshot(limit, hubs), ("stage", "nodes", "edges", "node_list"), ("string", "bigint", "bigint", "nodes"), lambda e: _snapshot_in_rounds(e, limit, hubs))


def _snapshot_in_rounds(edges: DataFrame, limit: int, hubs: int) -> DataFrame:
    part = cut(induced(edges, _representatives_in_rounds(edges, limit, hubs)))
    stages = {"original": edges.select(*EDGE), "representative": part.select(*EDGE), "cyclic": add_cycles(part).select(*EDGE)}
    out = None
    for name, e in stages.items():
        n = edge_nodes(e).groupBy("graph_id").agg(F.count("*").alias("nodes"), F.sort_array(F.collect_list("node")).alias("node_list"))
        row = e.groupBy("graph_id").agg(F.count("*").alias("edges")).join(n, "graph_id").select("graph_id", F.lit(name).alias("stage"), "nodes", "edges", "node_list")
        out = row if out is None else out.unionByName(row)
    return out
