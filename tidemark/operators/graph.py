"""Closures, paths, cycles and fan-in over edge tables.

Iteration is over joins of frontier and edges; each round is a written table, so
lineage stays short and a lost executor costs one round. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cycles import components
from tidemark.plans.staging import stage
from tidemark.plans.tables import table

#: Edges whose components one task finds for ``reach``, held in arrays of 4 and 8 bytes; beyond that by joins, with the same results.
IN_TASK = 2_000_000
#: Rows of either side that meet in one block of ``_blocks``, and pairs a task.
SOURCES, TARGETS, PAIRS = 2_000, 500, 1_000_000


def edges(spark, sf_dir) -> DataFrame:
    """Who follows whom: distinct pairs of users with consecutive purchases, within blocks of a thousand events."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    w = Window.partitionBy(F.floor(F.col("event_id") / 1000)).orderBy("event_id")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("src <> dst").select("src", "dst").distinct()


EDGES_SQL = """edges as (select distinct src, dst from (select user_id as src, lead(user_id) over (partition by event_id // 1000 order by event_id) as dst from events where event_type = 'purchase') where src <> dst)"""


def closure(edges: DataFrame, depth: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): every node that each source reaches, with the fewest hops.

    Walks until nothing is new, or for ``depth`` rounds; ``seeds`` (src) bounds the sources. One written table a
    round. The result is as large as its pairs, so over large graphs give seeds.
    """
    edges = stage(edges.select("src", "dst").distinct(), "edges")
    start = edges if seeds is None else edges.join(seeds.select("src").distinct(), "src", "left_semi")
    found = frontier = stage(start.select("src", "dst", F.lit(1).alias("hops")), "closure")
    hops = 1
    while depth is None or hops < depth:
        hops += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src <> dst").distinct()
        frontier = stage(step.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _ways(edges: DataFrame, seeds: str | DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, at) the component of each seed; (at, of) each component that those reach, themselves too; (node, of) all nodes."""
    edges = stage(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    members = stage(nodes.join(components(edges, IN_TASK), "node", "left").select("node", F.coalesce("component", "node").alias("of")), "members")
    of = lambda side, name: members.select(F.col("node").alias(side), F.col("of").alias(name))
    starts = of("src", "at")
    if isinstance(seeds, DataFrame):
        starts = stage(starts.join(seeds.select("src").distinct(), "src", "left_semi"), "starts")
    elif seeds is not None:
        starts = starts.where(seeds)
    own = starts.select("at").distinct()
    between = edges.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    beyond = closure(between, seeds=own.withColumnRenamed("at", "src"))
    return starts, beyond.select(F.col("src").alias("at"), F.col("dst").alias("of")).unionByName(own.select("at", F.col("at").alias("of"))), members


def _blocks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(l, r) of all rows of ``left`` (key, l) and ``right`` (key, r) with one key, in blocks that many tasks share however large a key is."""
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
    n = stage(n.select(key, F.ceil(F.col("_l") / SOURCES).alias("_rows"), F.ceil(F.col("_r") / TARGETS).alias("_cols"), (F.col("_l") * F.col("_r")).alias("_pairs")), "blocks")
    tasks = max(1, (n.agg(F.sum("_pairs")).first()[0] or 0) // PAIRS)
    one = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    l_side = left.join(n, key).select(key, "l", one("l", "_rows").alias("_row"), every("_cols").alias("_col"))
    r_side = right.join(n, key).select(key, "r", every("_rows").alias("_row"), one("r", "_cols").alias("_col"))
    by = [key, "_row", "_col"]
    return l_side.repartition(tasks, *by).join(r_side.repartition(tasks, *by), by).select("l", "r")


def reach(edges: DataFrame, seeds: str | DataFrame | None = None) -> DataFrame:
    """(src, dst): every node that each source reaches, however far; the pairs of ``closure`` without their hops.

    All nodes of a strongly connected component reach the same ones, so only ways between components are walked and
    pairs are made once, for the result. ``seeds``: a condition on src, or a table of them. Nulls and edges from a node
    to itself count for nothing.
    """
    starts, ways, members = _ways(edges, seeds)
    reached = stage(_blocks(ways.select("of", F.col("at").alias("l")), members.select("of", F.col("node").alias("r")), "of"), "reached")
    pairs = _blocks(starts.select("at", F.col("src").alias("l")), reached.select(F.col("l").alias("at"), "r"), "at")
    return pairs.select(F.col("l").alias("src"), F.col("r").alias("dst")).where("src <> dst")


def reach_counts(edges: DataFrame, seeds: str | DataFrame | None = None) -> DataFrame:
    """(src, n): how many other nodes each source of ``reach`` reaches, from the sizes of components and without their pairs."""
    starts, ways, members = _ways(edges, seeds)
    whole = ways.join(members.groupBy("of").agg(F.count(F.lit(1)).alias("_n")), "of").groupBy("at").agg(F.sum("_n").alias("_n"))
    return starts.join(whole, "at").select("src", (F.col("_n") - 1).alias("n")).where("n > 0")


def reachable(spark, sf_dir):
    """What every 50th node reaches, however far."""
    return reach(edges(spark, sf_dir), "src % 50 = 0")


def blast(edges: DataFrame, seeds: str | DataFrame | None = None, depth: int | None = None, few: int = 5) -> DataFrame:
    """Transitive dependents of each node (against the arrows) and the risk they mean; ``seeds``: a condition on src, or a table of them."""
    back = reversed_edges(edges)
    if depth is None:
        c = reach_counts(back, seeds)
    else:
        c = closure(back, depth, back.select("src").where(seeds) if isinstance(seeds, str) else seeds).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumnRenamed("n", "dependents").select(F.col("src").alias("node"), "dependents", F.when(F.col("dependents") == 0, "low").when(F.col("dependents") <= few, "medium").otherwise("high").alias("risk"))


def blast_radius(spark, sf_dir):
    """Dependents of every 20th node, however far."""
    return blast(edges(spark, sf_dir), "src % 20 = 0")


def symbol_risk(edges: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """Risk of changing each symbol (id, coverage, criticality): dependents up to ``depth``, coverage of both, criticality.

    score = 0.4 min(n / 50, 1) + 0.3 (1 - mean of own and dependents' coverage) + 0.3 criticality; cut at 0.3, 0.6, 0.85.
    """
    c = closure(reversed_edges(edges), depth, symbols.select(F.col("id").alias("src")))
    below = c.join(symbols.select(F.col("id").alias("dst"), F.col("coverage").alias("_c")), "dst", "left").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_c", F.lit(0.0))).alias("_below"))
    j = symbols.join(below, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tested = (F.coalesce("coverage", F.lit(0.5)) + F.coalesce("_below", F.lit(0.0))) / 2
    score = F.round(F.least(0.4 * F.least(F.col("n") / 50, F.lit(1.0)) + 0.3 * (1 - tested) + 0.3 * F.least("criticality", F.lit(1.0)), F.lit(1.0)), 6)
    level = F.when(F.col("score") > 0.85, "critical").when(F.col("score") > 0.6, "high").when(F.col("score") > 0.3, "medium").otherwise("low")
    return j.select("id", F.col("n").alias("dependents"), score.alias("score")).withColumn("risk", level)


def symbol_blast(spark, sf_dir):
    """Users as symbols: coverage and criticality from their ids, dependents within two hops."""
    e = edges(spark, sf_dir)
    ids = e.select(F.col("dst").alias("id")).where("id % 10 = 0").distinct()
    s = ids.select("id", (F.col("id") % 7 / 7.0).alias("coverage"), F.when(F.col("id") % 3 == 0, 0.8).otherwise(0.3).alias("criticality"))
    return symbol_risk(e, s, 2)


def symbol_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("file", "name", "line")) -> DataFrame:
    """Symbols (keys, hash) of two versions: added, removed, modified or unchanged."""
    a, b = old.withColumnRenamed("hash", "_old"), new.withColumnRenamed("hash", "_new")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def diff_impact(diff: DataFrame, risks: DataFrame) -> DataFrame:
    """Changed symbols of each file (file, state) with the widest reach of its symbols (file, dependents), as a level."""
    g = diff.where("state <> 'unchanged'").groupBy("file").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "modified")], F.count(F.lit(1)).alias("_n"))
    wide = risks.groupBy("file").agg(F.max("dependents").alias("reach"))
    j = g.join(wide, "file", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    n, r = F.col("_n"), F.col("reach")
    level = F.when(((n >= 3) & (r >= 5)) | (r >= 20), "critical").when(((n >= 2) & (r >= 3)) | (r >= 10), "high").when(r >= 1, "medium").otherwise("low")
    return j.select("file", "added", "removed", "modified", "reach", level.alias("risk"))


def changed_symbols(spark, sf_dir):
    """Lines of even and odd suppliers as two versions of a part's symbols, by order as file."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select((F.col("l_orderkey") % 500).alias("file"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("hash"))
    side = lambda k: li.where(f"s % 2 = {k}").groupBy("file", "name", "line").agg(F.min("hash").alias("hash"))
    diff = symbol_diff(side(0), side(1))
    reach = li.groupBy("file").agg((F.count(F.lit(1)) % 25).alias("dependents"))
    return diff_impact(diff, reach)


def linked_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, depends_on) by name and file, over edges of symbol ids."""
    s = lambda side, name: symbols.select(F.col("id").alias(side), F.struct("name", "file").alias(name))
    return edges.join(s("src", "symbol"), "src").join(s("dst", "depends_on"), "dst").select("symbol", "depends_on")


def fan_in(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in")).orderBy(F.desc("fan_in"), "node").limit(20)


def roots(spark, sf_dir):
    """Nodes that nothing points to."""
    e = edges(spark, sf_dir)
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")


def cycles(spark, sf_dir):
    """Simple cycles of at most four nodes, each once, starting at its smallest node."""
    e = edges(spark, sf_dir)
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    out = None
    for _ in range(3):
        step = paths.join(e.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at")
        closed = step.where("next = start").select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"))
        out = closed if out is None else out.unionByName(closed)
        paths = step.where(F.col("next") > F.col("start")).where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
    return out


def chains(spark, sf_dir):
    """Paths of three to four nodes from an entry (multiple of 9) to an impact (multiple of 5), scored by length."""
    e = edges(spark, sf_dir)
    paths = e.where("src % 9 = 0").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = None
    for _ in range(2):
        paths = paths.join(e.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").where(~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
        out = paths if out is None else out.unionByName(paths)
    hit = out.where("at % 5 = 0").select(F.array_join("path", ">").alias("chain"), F.size("path").cast("long").alias("length"))
    return hit.withColumn("severity", F.when(F.col("length") >= 4, "critical").otherwise("high"))


def neighbours(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    return both.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


def boundary_violations(spark, sf_dir):
    """Edges that a charter forbids, by conditions on both ends."""
    e = edges(spark, sf_dir)
    rule = F.when((F.col("src") < 50) & (F.col("dst") >= 100), "core must not use edge").when((F.col("src") % 2 == 0) & (F.col("dst") % 7 == 0), "even must not use seventh")
    return e.select("src", "dst", rule.alias("violation")).where("violation is not null")


def subsystems(spark, sf_dir):
    """Edges rolled up to groups of ten nodes, without loops."""
    e = edges(spark, sf_dir).select(F.floor(F.col("src") / 10).alias("from_group"), F.floor(F.col("dst") / 10).alias("to_group"))
    return e.where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark, sf_dir):
    """Link targets in pages and how many pages have them."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", href.alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("pages"))


def _q(body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}{EDGES_SQL}{body}"


QUERIES = {
    "graph_reachable": (reachable, _q(", w as (select src, dst from edges where src % 50 = 0 union select w.src, e.dst from w join edges e on w.dst = e.src) select src, dst from w where src <> dst", True)),
    "graph_blast_radius": (blast_radius, _q(", w as (select dst as node, src as dep from edges where dst % 20 = 0 union select w.node, e.src from w join edges e on w.dep = e.dst) select node, count(*) as dependents, case when count(*) = 0 then 'low' when count(*) <= 5 then 'medium' else 'high' end as risk from w where node <> dep group by node", True)),
    "symbol_risk": (symbol_blast, _q(", s as (select distinct dst as id, dst % 7 / 7.0::double as coverage, case when dst % 3 = 0 then 0.8::double else 0.3::double end as criticality from edges where dst % 10 = 0), one as (select distinct dst as id, src as dep from edges where dst % 10 = 0), two as (select * from one union select o.id, e.src from one o join edges e on o.dep = e.dst), g as (select two.id, count(*) as n, avg(coalesce(s.coverage, 0)) as below from two left join s on s.id = two.dep where two.id <> two.dep group by 1), x as (select s.id, coalesce(n, 0) as dependents, round(least(0.4::double * least(coalesce(n, 0) / 50, 1) + 0.3::double * (1 - (coverage + coalesce(below, 0)) / 2) + 0.3::double * criticality, 1), 6) as score from s left join g on g.id = s.id) select *, case when score > 0.85 then 'critical' when score > 0.6 then 'high' when score > 0.3 then 'medium' else 'low' end as risk from x")),
    "diff_impact": (changed_symbols, "with l as (select l_orderkey % 500 as file, l_partkey as name, l_linenumber as line, l_suppkey as s, l_returnflag as hash from lineitem where l_linenumber <= 2), a as (select file, name, line, min(hash) as h from l where s % 2 = 0 group by 1, 2, 3), b as (select file, name, line, min(hash) as h from l where s % 2 = 1 group by 1, 2, 3), d as (select coalesce(a.file, b.file) as file, case when a.h is null then 'added' when b.h is null then 'removed' when a.h <> b.h then 'modified' end as state from a full join b on a.file = b.file and a.name = b.name and a.line = b.line), g as (select file, count(*) filter (state = 'added') as added, count(*) filter (state = 'removed') as removed, count(*) filter (state = 'modified') as modified, count(*) as n from d where state is not null group by 1), r as (select file, count(*) % 25 as reach from l group by 1) select file, added, removed, modified, reach, case when n >= 3 and reach >= 5 or reach >= 20 then 'critical' when n >= 2 and reach >= 3 or reach >= 10 then 'high' when reach >= 1 then 'medium' else 'low' end as risk from g join r using (file)"),
    "graph_fan_in": (fan_in, _q(" select dst as node, count(distinct src) as fan_in from edges group by 1 order by 2 desc, 1 limit 20")),
    "graph_roots": (roots, _q(" select distinct src as node from edges where src not in (select dst from edges)")),
    "graph_cycles": (cycles, _q(", w as (select src as start, dst as pos, [src, dst] as path from edges where src < dst union all select w.start, e.dst, list_append(path, e.dst) from w join edges e on w.pos = e.src where e.dst > w.start and not list_contains(path, e.dst) and len(path) < 4) select array_to_string(path, '>') as cycle, len(path) as length from w join edges e on w.pos = e.src and e.dst = w.start", True)),
    "graph_chains": (chains, _q(", w as (select dst as pos, [src, dst] as path from edges where src % 9 = 0 union all select e.dst, list_append(path, e.dst) from w join edges e on w.pos = e.src where not list_contains(path, e.dst) and len(path) < 4) select array_to_string(path, '>') as chain, len(path) as length, case when len(path) >= 4 then 'critical' else 'high' end as severity from w where len(path) >= 3 and pos % 5 = 0", True)),
    "graph_neighbours": (neighbours, _q(", b as (select src as node, dst as other from edges union select dst, src from edges) select node, array_to_string(list_sort(list(other)), ',') as others from b group by node")),
    "graph_boundaries": (boundary_violations, _q(" select * from (select src, dst, case when src < 50 and dst >= 100 then 'core must not use edge' when src % 2 = 0 and dst % 7 = 0 then 'even must not use seventh' end as violation from edges) where violation is not null")),
    "graph_subsystems": (subsystems, _q(" select src // 10 as from_group, dst // 10 as to_group, count(*) as n from edges where src // 10 <> dst // 10 group by all")),
    "page_links": (page_links, "select target, count(*) as pages from (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as target from pages) group by target"),
}
