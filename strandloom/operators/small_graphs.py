"""Graphs of few edges, each solved by itself in one row: a shuffle in place of rounds of jobs.

Bounded by ``SMALL`` edges a graph; larger graphs are left to the loops of ``graphs``.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.loops import Scratch, importable, small_join

#: Edges of the largest graph that counts as small.
SMALL = 2_000
#: Where work and memory follow the number of edges alone, a task takes graphs of so many times ``SMALL`` (200,000 edges).
LINEAR = 100
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def parted(edges: DataFrame, work: Scratch, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges of small graphs, edges of the other ones or None)."""
    sizes = edges.groupBy("graph_id").count()
    large = work.put(sizes.where(F.col("count") > (SMALL if most is None else most)).select("graph_id"), "large")
    if large.isEmpty():
        return edges, None
    return small_join(edges, large, ["graph_id"], "left_anti"), small_join(edges, large, ["graph_id"], "left_semi")


def solved(edges: DataFrame, solve: Callable[[list[tuple]], list[tuple]], names: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """graph_id and ``names`` of what ``solve`` makes of the (src, dst) of each graph of ``edges``; the type "node" is that of
    its nodes, "nodes" an array of them."""
    importable(edges.sparkSession)
    rows = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.schema.field("edges").type.value_type.field("src").type
            kinds = [{"node": own, "nodes": pa.list_(own)}.get(t) or KINDS[t] for t in types]
            for k in range(0, len(b), 200):
                part = b.slice(k, 200)
                at, out = [], []
                for i, es in enumerate(part.column(1).to_pylist()):
                    made = solve([(e["src"], e["dst"]) for e in es])
                    at += [i] * len(made)
                    out += made
                columns = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["graph_id", *names])

    kind = edges.schema["src"].dataType.simpleString()
    fields = ", ".join(f"{n} {({'node': kind, 'nodes': f'array<{kind}>'}).get(t, t)}" for n, t in zip(names, types, strict=True))
    return rows.mapInArrow(fn, f"graph_id {edges.schema['graph_id'].dataType.simpleString()}, {fields}")


def components_in_turn(edges: DataFrame) -> DataFrame:
    """(graph_id, node, least) of all nodes as ``components`` finds them; a task holds one graph at a time."""
    importable(edges.sparkSession)

    def fn(table: pa.Table) -> pa.Table:
        found = components(list(zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True)))
        node, least = zip(*found, strict=True)
        own = table.column("src").type
        return pa.table({"graph_id": table.column("graph_id").slice(0, 1).take(pa.array([0] * len(node))), "node": pa.array(node, own), "least": pa.array(least, own)})

    kind = lambda c: edges.schema[c].dataType.simpleString()
    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInArrow(fn, f"graph_id {kind('graph_id')}, node {kind('src')}, least {kind('src')}")


def neighbours(edges: list[tuple]) -> dict:
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    return after


def components(edges: list[tuple]) -> list[tuple]:
    """(node, least node of its strong component): nodes in order of when a search leaves them, then searches against the
    edges from the last one on."""
    after, against = neighbours(edges), neighbours([(b, a) for a, b in edges])
    order, seen = [], set()
    for root in after:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(after[root]))]
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(after[n])))
                    break
            else:
                order.append(node)
                stack.pop()
    out, placed = [], set()
    for root in reversed(order):
        if root in placed:
            continue
        placed.add(root)
        group, open_ = [root], [root]
        while open_:
            for n in against[open_.pop()]:
                if n not in placed:
                    placed.add(n)
                    group.append(n)
                    open_.append(n)
        least = min(group)
        out += [(n, least) for n in group]
    return out


def distances(edges: list[tuple]) -> list[tuple]:
    """(src, dst, least number of edges) of all pairs with a path, each node with itself at 0."""
    after, out = neighbours(edges), []
    for source in after:
        seen, queue = {source: 0}, deque([source])
        while queue:
            node = queue.popleft()
            for n in after[node]:
                if n not in seen:
                    seen[n] = seen[node] + 1
                    queue.append(n)
        out += [(source, n, d) for n, d in seen.items()]
    return out


def layers(edges: list[tuple]) -> dict | None:
    """Each node's most edges on a path that ends in it; None in a graph with a cycle."""
    after = neighbours(set(edges))
    open_ = dict.fromkeys(after, 0)
    for ends in after.values():
        for n in ends:
            open_[n] += 1
    layer = {n: 0 for n, k in open_.items() if not k}
    free = list(layer)
    while free:
        node = free.pop()
        for n in after[node]:
            layer[n] = max(layer.get(n, 0), layer[node] + 1)
            open_[n] -= 1
            if not open_[n]:
                free.append(n)
    return layer if not any(open_.values()) else None


def onward(edges: list[tuple], goal) -> dict:
    """(edges to ``goal``, next node) of every node that leads there: the least of the next nodes on shortest paths."""
    against = neighbours([(b, a) for a, b in edges])
    found, front, hops = {goal: (0, goal)}, [goal], 0
    while front:
        hops += 1
        new: dict = {}
        for node in front:
            for n in against.get(node, ()):
                if n not in found and (n not in new or node < new[n]):
                    new[n] = node
        found.update((n, (hops, to)) for n, to in new.items())
        front = list(new)
    return found


def path_to(found: dict, node, goal) -> list:
    out = [node]
    while node != goal:
        node = found[node][1]
        out.append(node)
    return out


def walk(max_steps: int) -> Callable[[list[tuple]], list[tuple]]:
    """(pos, node) as ``graphs.sample_walk``."""

    def solve(edges: list[tuple]) -> list[tuple]:
        layer = layers(edges)
        if layer is not None:
            return list(enumerate(sorted(layer, key=lambda n: (layer[n], n))[:max_steps]))
        least = components(edges)
        many = Counter(low for _, low in least)
        home = min([n for n, low in least if many[low] > 1] + [a for a, b in edges if a == b])
        found = onward(edges, home)
        firsts = [(found[b][0], path_to(found, b, home)) for b in {b for a, b in edges if a == home} if b in found]
        return list(enumerate([home, *min(firsts)[1]][: max_steps + 1]))

    return solve


def representatives(edges: list[tuple], limit: int, hubs: int) -> list:
    """Nodes as ``graphs.representative_nodes``."""
    degree = Counter(n for e in edges for n in e)
    if len(degree) <= limit:
        return list(degree)
    layer = layers(edges) or {}
    top = sorted(degree, key=lambda n: (-degree[n], n))[: min(hubs, limit)]
    kind = {}
    for a, b in zip(top, top[1:], strict=False):
        found = onward(edges, b)
        if a in found:
            kind.update(dict.fromkeys(path_to(found, a, b), 1))
    kind.update(dict.fromkeys(top, 0))
    return sorted(degree, key=lambda n: (kind.get(n, 2), layer.get(n, 0), n))[:limit]


def cycles_added(edges: list[tuple]) -> list[tuple]:
    """``edges`` and the synthetic ones of ``graphs.add_cycles``."""
    layer = layers(edges)
    if layer is None or len(layer) < 4:
        return edges
    order = sorted(layer, key=lambda n: (layer[n], n))
    return edges + sorted({(order[-1], order[1]), (order[-2], order[0])} - set(edges))


def snapshot(limit: int, hubs: int) -> Callable[[list[tuple]], list[tuple]]:
    """(stage, nodes, edges, node_list) as ``graphs.context_snapshot``."""

    def solve(edges: list[tuple]) -> list[tuple]:
        kept = set(representatives(edges, limit, hubs))
        part = [e for e in edges if e[0] in kept and e[1] in kept]
        out = []
        for stage, es in (("original", edges), ("representative", part), ("cyclic", cycles_added(part))):
            if es:
                nodes = sorted({n for e in es for n in e})
                out.append((stage, len(nodes), len(es), nodes))
        return out

    return solve


def weak(edges: list[tuple]) -> dict:
    """Each node's least node reachable over undirected edges."""
    beside, low = neighbours([*edges, *((b, a) for a, b in edges)]), {}
    for root in sorted(beside):
        if root in low:
            continue
        low[root], open_ = root, [root]
        while open_:
            for n in beside[open_.pop()]:
                if n not in low:
                    low[n] = root
                    open_.append(n)
    return low


def stats(rows: list[tuple]) -> list[tuple]:
    """One row as ``graphs.graph_stats``; rows without dst are the graph's nodes."""
    nodes, edges = [a for a, b in rows if b is None], [e for e in rows if e[1] is not None]
    if not nodes:
        return []
    loops = sum(a == b for a, b in edges)
    w, s = weak(edges), dict(components(list({e for e in edges if e[0] != e[1]})))
    parts, strong = Counter(w.get(n, n) for n in nodes), Counter(s.get(n, n) for n in nodes)
    largest = max(strong.values())
    return [(len(nodes), len(edges), loops, len(parts), max(parts.values()), len(strong), largest, largest > 1 or loops > 0)]
