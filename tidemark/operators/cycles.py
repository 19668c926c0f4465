"""Strongly connected components and cycles of any length.

Components by colours: every node takes the largest of the (hashed) names of all nodes that reach it; what
reaches the node of its own colour again inside that colour is its component. Components found, edges that
leave a colour go, and the rest is coloured anew. Hashed names leave a logarithm of rounds even on long
chains, and every node keeps one far ancestor whose colour it takes too and whose ancestor it then follows, so a
ring of n nodes is coloured in log n rounds and not n. Every round is a written table. Once no more than
``SMALL`` edges are left, one task ends the work.

Cycles: each edge inside a component lies on one, and each gets one: from the component's smallest node a
breadth-first way leads to the edge, another one back; the two are cut where they meet.

Defined cases: nulls at either end of an edge and repeated edges are ignored. An edge from a node to itself makes
no component but a cycle of one node. Nodes without edges are not known here.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.shipping import ship
from tidemark.plans.staging import stage
from tidemark.plans.tables import table

#: Edges up to which a graph's components, and a component's cycles, are found inside one task; beyond that by
#: joins, with the same results.
SMALL = 50_000


def _name(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest name among the node and all that reach it."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.max(_name("src")).alias("far"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = stage(nodes.join(into, "node", "left").select("node", _name("node").alias("colour"), F.col("far.node").alias("far")), "colours")
    before = None
    while True:
        seen = state.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
        if seen == before:
            return state.select("node", "colour")
        before = seen
        offered = edges.join(state.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("edge"))
        above = state.select(F.col("node").alias("far"), F.col("colour").alias("up"), F.col("far").alias("next"))
        joined = state.join(offered, "node", "left").join(above, "far", "left")
        state = stage(joined.select("node", F.greatest("colour", "edge", "up").alias("colour"), F.coalesce("next", "far").alias("far")), "colours")


def _back(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, root): nodes that reach the node of their colour through their colour (``edges`` stay inside one)."""
    onto = edges.groupBy(F.col("src").alias("node")).agg(F.max(_name("dst")).alias("far"))
    state = colours.join(onto, "node", "left").select("node", F.col("colour.node").alias("root"), F.col("far.node").alias("far"))
    state = stage(state.withColumn("on", F.col("node") == F.col("root")), "back")
    before = None
    while True:
        seen = state.where("on").count()
        if seen == before:
            return state.where("on").select("node", "root")
        before = seen
        offered = edges.join(state.where("on").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().withColumn("edge", F.lit(True))
        below = state.select(F.col("node").alias("far"), F.col("on").alias("down"), F.col("far").alias("next"))
        joined = state.join(offered, "node", "left").join(below, "far", "left")
        on = F.col("on") | F.coalesce("edge", F.lit(False)) | F.coalesce("down", F.lit(False))
        state = stage(joined.select("node", "root", F.coalesce("next", "far").alias("far"), on.alias("on")), "back")


def _roots(links: array, first: array) -> array:
    """Of each node 0.. the root of its component, in one depth-first pass; node n leads to links[first[n] : first[n + 1]]."""
    at = first[:-1]
    order, low, root = (array("i", [k]) * len(at) for k in (0, 0, -1))
    pending, count = array("i"), 0
    for start in range(len(at)):
        path = array("i", [] if order[start] else [start])
        while path:
            node = path[-1]
            if not order[node]:
                count += 1
                order[node] = low[node] = count
                pending.append(node)
            k = at[node]
            if k < first[node + 1]:
                at[node] = k + 1
                other = links[k]
                if not order[other]:
                    path.append(other)
                elif root[other] < 0 and order[other] < low[node]:
                    low[node] = order[other]
                continue
            path.pop()
            if low[node] == order[node]:
                while root[node] < 0:
                    root[pending.pop()] = node
            elif low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
    return root


def _rooted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of a graph that lies in one part, held in arrays."""
    ends = [(pdf["src"].to_numpy(), pdf["dst"].to_numpy()) for pdf in parts]
    if not ends:
        return
    codes, nodes = pd.factorize(np.concatenate([side for k in (0, 1) for side in (e[k] for e in ends)]))
    del ends
    src, dst = np.split(codes.astype(np.int32), 2)
    first = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=len(nodes)))))
    ints = lambda a: array("i", a.astype(np.int32).tobytes())
    root = np.array(_roots(ints(dst[np.argsort(src, kind="stable")]), ints(first)))
    for k in range(0, len(nodes), 10_000):
        yield pd.DataFrame({"node": nodes[k : k + 10_000], "root": nodes[root[k : k + 10_000]]})


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (src, dst): the smallest node that it reaches and that reaches it."""
    known = components(stage(edges.where("src <> dst").select("src", "dst").distinct(), "left"), SMALL)
    found = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    return found.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(left: DataFrame, small: int) -> DataFrame:
    """(node, component) of nodes on cycles, and of some that are on none, for a written table of different edges between two nodes; up to ``small`` edges one task ends the work."""
    ship(left.sparkSession)
    done = None
    while n := left.count():
        if n <= small:  # what is left fits one task
            kind = dict(left.dtypes)["src"]
            rooted = stage(left.repartition(1).mapInPandas(_rooted, f"node {kind}, root {kind}"), "rooted")
            done = rooted if done is None else done.unionByName(rooted)
            break
        colours = stage(_coloured(left), "coloured")
        of = lambda side: colours.select(F.col("node").alias(side), F.col("colour").alias(f"_{side}"))
        inside = stage(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst"), "inside")
        rooted = stage(_back(inside, colours), "rooted")
        done = rooted if done is None else done.unionByName(rooted)
        gone = rooted.select("node")
        left = stage(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "left")
    if done is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component"))
    smallest = done.groupBy("root").agg(F.min("node").alias("component"))
    return done.join(smallest, "root").select("node", "component")


# --- one cycle for each edge ----------------------------------------------------------------------


def _levels(start: object, onward: dict) -> dict:
    """Of each node the smallest one that is a step nearer to ``start`` (None for itself)."""
    via, level = {start: None}, [start]
    while level:
        after: dict = {}
        for node in level:
            for other in onward.get(node, ()):
                if other not in via and (other not in after or node < after[other]):
                    after[other] = node
        via |= after
        level = list(after)
    return via


def _way(node: object, via: dict) -> list:
    out = []
    while node is not None:
        out.append(node)
        node = via[node]
    return out


def _closed(there: list, back: list) -> list:
    """The cycle of an edge, from the ways start..src and dst..start: cut where they first meet, smallest node first."""
    place = {n: i for i, n in enumerate(there)}
    k = next(i for i, n in enumerate(back) if n in place)
    cycle = there[place[back[k]] :] + back[:k]
    low = cycle.index(min(cycle))
    return cycle[low:] + cycle[:low]


def _walked(pdf: pd.DataFrame) -> pd.DataFrame:
    ahead: dict = {}
    behind: dict = {}
    for u, v in zip(pdf["src"], pdf["dst"], strict=True):
        ahead.setdefault(u, []).append(v)
        behind.setdefault(v, []).append(u)
    start = pdf["component"].iloc[0]
    out_of, into = _levels(start, ahead), _levels(start, behind)
    ways = {u: _way(u, out_of)[::-1] for u in ahead}
    cycles = {tuple(_closed(ways[u], _way(v, into))) for u, vs in ahead.items() for v in vs}
    return pd.DataFrame({"component": [start] * len(cycles), "cycle": [list(c) for c in cycles]})


def _joined(edges: DataFrame) -> DataFrame:
    """The same cycles by joins: ways grow by one level a round."""

    def ways(links: DataFrame) -> DataFrame:
        """(component, node, way): the way from the component's smallest node along ``links`` (component, a, b)."""
        level = links.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("way"))
        found = level = stage(level, "ways")
        while not level.isEmpty():
            step = level.withColumnRenamed("node", "a").join(links, ["component", "a"]).select("component", F.col("b").alias("node"), "a", "way")
            step = step.join(found.select("component", "node"), ["component", "node"], "left_anti").groupBy("component", "node").agg(F.min(F.struct("a", "way")).alias("m"))
            level = stage(step.select("component", "node", F.concat("m.way", F.array("node")).alias("way")), "ways")
            found = found.unionByName(level)
        return found

    there = ways(edges.select("component", F.col("src").alias("a"), F.col("dst").alias("b"))).select("component", F.col("node").alias("src"), F.col("way").alias("there"))
    back = ways(edges.select("component", F.col("dst").alias("a"), F.col("src").alias("b"))).select("component", F.col("node").alias("dst"), F.reverse("way").alias("back"))
    met = edges.join(there, ["component", "src"]).join(back, ["component", "dst"])
    meet = F.get(F.filter("back", lambda n: F.array_contains("there", n)), 0)
    place = F.array_position("there", meet).cast("int")
    cycle = F.concat(F.slice("there", place, F.size("there") - place + 1), F.slice("back", F.lit(1), F.array_position("back", meet).cast("int") - 1))
    low = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", low, F.size("cycle") - low + 1), F.slice("cycle", F.lit(1), low - 1))
    return met.select("component", cycle.alias("cycle")).select("component", turned.alias("cycle")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(component, cycle): closed cycles (the first node again at the end), so that each edge of a component is on one.

    Each starts at its smallest node and is listed once.
    """
    ship(edges.sparkSession)
    own = edges.where("src = dst").select(F.col("src").alias("component"), F.array("src").alias("cycle")).distinct()
    links = edges.where("src <> dst").select("src", "dst").distinct()
    c = stage(strong_components(links), "components")
    of = lambda side: c.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    inner = stage(links.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select(F.col("_src").alias("component"), "src", "dst"), "inner")
    sizes = inner.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = inner.join(sizes.where(F.col("n") <= SMALL), "component", "left_semi")
    large = stage(inner.join(sizes.where(F.col("n") > SMALL), "component", "left_semi"), "large")
    kind = dict(edges.dtypes)["src"]
    found = small.groupBy("component").applyInPandas(_walked, f"component {kind}, cycle array<{kind}>").unionByName(own)
    if not large.isEmpty():
        found = found.unionByName(_joined(large))
    return found.select("component", F.concat("cycle", F.slice("cycle", 1, 1)).alias("cycle"))


# --- queries --------------------------------------------------------------------------------------


def handovers(spark, sf_dir) -> DataFrame:
    """Who orders after whom: consecutive urgent orders of one day."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    after = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").alias("src"), after.alias("dst")).where("src <> dst").distinct()


HANDOVERS_SQL = "edges as (select distinct src, dst from (select o_custkey as src, lead(o_custkey) over (partition by o_orderdate order by o_orderkey) as dst from orders where o_orderpriority = '1-URGENT') where src <> dst)"


def component_sizes(spark, sf_dir):
    """Each customer's component, and how many it holds."""
    c = strong_components(handovers(spark, sf_dir))
    return c.withColumn("nodes", F.count(F.lit(1)).over(Window.partitionBy("component")))


def handover_cycles(spark, sf_dir):
    """A closed cycle through every edge that lies on one, its length and its nodes."""
    return cycles(handovers(spark, sf_dir)).select("component", (F.size("cycle") - 1).cast("long").alias("length"), F.array_join("cycle", ">").alias("cycle"))


QUERIES = {
    "strong_components": (component_sizes, f"with recursive {HANDOVERS_SQL}, w as (select src as a, dst as b from edges union select w.a, e.dst from w join edges e on w.b = e.src), n as (select src as node from edges union select dst from edges), c as (select node, least(node, coalesce(min(f.b), node)) as component from n left join (select f.a, f.b from w f join w g on f.a = g.b and f.b = g.a) f on f.a = node group by node) select *, count(*) over (partition by component) as nodes from c"),
    "closed_cycles": (handover_cycles, None),
}
