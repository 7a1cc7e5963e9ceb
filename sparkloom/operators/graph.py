"""Bounded traversal, paths, components and views of the entity graph.

Edges are (src_id, dst_id, type, line, ...); entities have an entity_id. Endpoints
that are no entity are legal everywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..ship import ship

#: Edges up to which cycles are searched in one task; beyond, by distributed colouring.
ONE_TASK_EDGES = 2_000_000
#: Rows of a frontier up to which it is broadcast.
FEW = 100_000


def frontier_expand(edges: DataFrame, seed: str, depth: int, from_col: str, to_col: str, among: DataFrame | None = None) -> DataFrame:
    """(node, dist) of all nodes within `depth` steps of seed; `among` (node) limits which nodes are entered.

    One join a level: the frontier against the edges, without what was visited. Each level reads the edges, so they should be stored.
    """
    spark = edges.sparkSession
    step = edges.select(F.col(from_col).alias("at"), F.col(to_col).alias("node"))
    seen = frontier = spark.createDataFrame([(seed, 0)], "node string, dist int")
    for d in range(1, depth + 1):
        new = step.join(_few(frontier.select(F.col("node").alias("at"))), "at").select("node").distinct()
        if among is not None:
            new = new.join(among, "node", "left_semi")
        frontier = cut(new.join(seen, "node", "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def _few(rows: DataFrame) -> DataFrame:
    """Rows to join edges with: counted, and broadcast up to FEW."""
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def callers(edges: DataFrame, entity_id: str, depth: int = 3) -> DataFrame:
    """Blast radius: (callee, caller, dist) for each caller of a node less than `depth` steps away; pseudo nodes are entered too."""
    calls = edges.where("type = 'calls'")
    if depth <= 0:
        return calls.select(F.col("dst_id").alias("callee"), F.col("src_id").alias("caller"), F.lit(0).alias("dist")).limit(0)
    dist = frontier_expand(calls, entity_id, depth - 1, "dst_id", "src_id")
    return calls.join(dist.withColumnRenamed("node", "dst_id"), "dst_id").select(F.col("dst_id").alias("callee"), F.col("src_id").alias("caller"), (F.col("dist") + 1).alias("dist")).distinct()


def dependencies(edges: DataFrame, entities: DataFrame, entity_id: str, depth: int = 3, types: tuple[str, ...] = ("imports", "calls")) -> DataFrame:
    """(parent, child, type, line, dist, kind) for every out-edge of each entity less than `depth` steps away."""
    own = edges.where(F.col("type").isin(*types))
    known = entities.select(F.col("entity_id").alias("node"))
    dist = frontier_expand(own, entity_id, max(depth - 1, 0), "src_id", "dst_id", known)
    out = own.join(dist.withColumnRenamed("node", "src_id"), "src_id").join(known.select(F.col("node").alias("dst_id"), F.lit(True).alias("real")), "dst_id", "left")
    kind = F.when(F.col("real"), "entity").otherwise(unresolved_kind(F.col("dst_id")))
    out = out.select(F.col("src_id").alias("parent"), F.col("dst_id").alias("child"), "type", "line", (F.col("dist") + 1).alias("dist"), kind.alias("kind"))
    return out if depth > 0 else out.limit(0)


def unresolved_kind(node: Column) -> Column:
    return F.when(node.startswith("wildcard:"), "wildcard").when(node.startswith("external:"), "external").otherwise("unresolved")


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int = 7) -> DataFrame:
    """(path) of the shortest call path, the first in order of ids among equals; no row without one. Unresolved nodes are not entered."""
    spark = edges.sparkSession
    hops = min(max(hops, 1), 20)
    calls = edges.where("type = 'calls'").where(~F.col("dst_id").startswith("external:") & ~F.col("dst_id").contains(":?"))
    calls = calls.select(F.col("src_id").alias("at"), F.col("dst_id").alias("node"))
    seen = frontier = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    for _ in range(hops if start != goal else 0):
        new = calls.join(_few(frontier.withColumnRenamed("node", "at")), "at").join(seen.select("node"), "node", "left_anti")
        frontier = cut(new.groupBy("node").agg(F.min(F.concat("path", F.array("node"))).alias("path")))
        seen = seen.unionAll(frontier)
        if frontier.isEmpty() or not frontier.where(F.col("node") == goal).isEmpty():
            break
    return seen.where(F.col("node") == goal).select("path")


def path_labels(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """(pos, node, label): name (file:line), or the id itself if it is no entity."""
    e = entities.select(F.col("entity_id").alias("node"), F.format_string("%s (%s:%d)", "name", "file", "start_line").alias("text"))
    return paths.select(F.posexplode("path").alias("pos", "node")).join(e, "node", "left").select("pos", "node", F.coalesce("text", "node").alias("label"))


def file_imports(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_file, dst_file): distinct imports between files of the graph, without those of a file by itself."""
    at = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("file").alias(f"{side}_file"))
    return edges.where("type = 'imports'").join(at("src"), "src_id").join(at("dst"), "dst_id").where("src_file != dst_file").select("src_file", "dst_file").distinct()


def strong_components(graph: DataFrame, src: str = "src_file", dst: str = "dst_file", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node of each node's strongly connected component, for components of two nodes or more.

    Nodes without an edge in or out can't be in a cycle and are trimmed away first.
    A graph whose rest is counted as small is searched in one task; a larger one by
    colouring: forward minima give colours, and what a colour's root reaches backward
    within its colour is a component.
    """
    e = cut(graph.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s != d").distinct())
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d"))
        m = e.count()
        if m == n:
            break
        n = m
    kind = "node string, root string"
    if n <= one_task:
        ship(graph.sparkSession)
        return e.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda d: pd.DataFrame(_tarjan(d), columns=["node", "root"]), kind)
    done = e.sparkSession.createDataFrame([], kind)
    while not e.isEmpty():
        colour = _settle(e.select(F.col("s").alias("node")).unionAll(e.select("d")).distinct().withColumn("colour", F.col("node")), e, "s", "d")
        within = e.join(colour.toDF("s", "cs"), "s").join(colour.toDF("d", "cd"), "d").where("cs = cd").select("s", "d", "cs")
        got = colour.where("node = colour").select("node", F.col("colour").alias("root"))
        front = got
        while not front.isEmpty():
            new = within.join(front.select(F.col("node").alias("d"), F.col("root").alias("cs")), ["d", "cs"]).select(F.col("s").alias("node"), F.col("cs").alias("root")).distinct()
            front = cut(new.join(got, "node", "left_anti"))
            got = got.unionAll(front)
        got = cut(got)
        done = done.unionAll(got)
        e = cut(e.join(got.select(F.col("node").alias("s")), "s", "left_anti").join(got.select(F.col("node").alias("d")), "d", "left_anti"))
    many = done.groupBy("root").count().where("count > 1").select("root")
    return done.join(many, "root", "left_semi").select("node", "root")


def _settle(colour: DataFrame, e: DataFrame, s: str, d: str) -> DataFrame:
    """Colours after the smallest one has spread along the edges."""
    while True:
        spread = e.join(colour.withColumnRenamed("node", s), s).select(F.col(d).alias("node"), "colour")
        new = cut(colour.unionAll(spread).groupBy("node").agg(F.min("colour").alias("colour")))
        if new.join(colour, ["node", "colour"], "left_anti").isEmpty():
            return new
        colour = new


def _tarjan(d: pd.DataFrame) -> list[tuple[str, str]]:
    """Components of two nodes or more, without recursion."""
    ways: dict[str, list[str]] = {}
    for s, t in zip(d["s"], d["d"]):
        ways.setdefault(s, []).append(t)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, out = [], set(), []
    for top in sorted(ways):
        if top in index:
            continue
        work = [(top, iter(ways.get(top, ())))]
        index[top] = low[top] = len(index)
        stack.append(top)
        on.add(top)
        while work:
            v, it = work[-1]
            w = next(it, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                        on.discard(own[-1])
                    if len(own) > 1:
                        out += [(x, min(own)) for x in own]
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                on.add(w)
                work.append((w, iter(ways.get(w, ()))))
            elif w in on:
                low[v] = min(low[v], index[w])
    return out


def cycles(graph: DataFrame, least: int = 2) -> DataFrame:
    """(members): sorted members of each cycle of files, of `least` or more."""
    parts = strong_components(graph).groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return parts.where(F.size("members") >= least).select("members").orderBy("members")


def module_graph(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, type) between the modules of files: imports if any edge is one, else calls."""
    e = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("file").alias(f"{side}_file"))
    pairs = edges.where("type in ('imports', 'calls')").join(e("src"), "src_id").join(e("dst"), "dst_id").where("src_file != dst_file")
    pairs = pairs.groupBy("src_file", "dst_file").agg(F.max(F.col("type") == "imports").alias("any"))
    module = entities.where("type = 'module'")
    m = lambda side, name: module.select(F.col("file").alias(f"{side}_file"), F.col("entity_id").alias(name))
    return pairs.join(m("src", "source"), "src_file").join(m("dst", "target"), "dst_file").select("source", "target", F.when(F.col("any"), "imports").otherwise("calls").alias("type"))


def entity_graph(edges: DataFrame, entities: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a file and the edges that begin at them; targets may lie outside."""
    nodes = entities.where(F.col("file") == file).select("entity_id", "type", "name", "start_line")
    return nodes.orderBy("start_line", "entity_id"), edges.join(nodes.select(F.col("entity_id").alias("src_id")), "src_id", "left_semi").orderBy("line", "src_id", "dst_id")


def entity_context(edges: DataFrame, entity_id: str) -> DataFrame:
    """(direction, neighbour): what an entity depends on and what calls it."""
    out = edges.where((F.col("src_id") == entity_id) & F.col("type").isin("calls", "imports")).select(F.lit("depends_on").alias("direction"), F.col("dst_id").alias("neighbour"))
    return out.unionAll(edges.where((F.col("dst_id") == entity_id) & (F.col("type") == "calls")).select(F.lit("called_by"), "src_id")).distinct()


def hot_paths(edges: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """(entity_id, name, file, fan_in) of the targets called most; the limit comes before entities are looked up."""
    own = ~F.col("dst_id").startswith("external:") & ~F.col("dst_id").startswith("route:") & ~F.col("dst_id").startswith("wildcard:")
    top = edges.where("type = 'calls'").where(own).groupBy("dst_id").agg(F.count(F.lit(1)).alias("fan_in")).orderBy(F.desc("fan_in"), "dst_id").limit(most)
    return top.join(entities, top["dst_id"] == entities["entity_id"]).select("entity_id", "name", "file", "fan_in")


def entry_points(edges: DataFrame, most: int = 8) -> DataFrame:
    return edges.where(F.col("src_id").startswith("route:")).select(F.col("src_id").alias("route"), F.col("dst_id").alias("handler")).orderBy("route", "handler").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree) over all edges; a loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_id): entities one step from the seeds (entity_id) over calls and imports, either way."""
    e = edges.where("type in ('calls', 'imports')")
    out = e.join(seeds.select(F.col("entity_id").alias("src_id")), "src_id").select(F.col("dst_id").alias("entity_id"))
    back = e.join(seeds.select(F.col("entity_id").alias("dst_id")), "dst_id").select(F.col("src_id").alias("entity_id"))
    return out.unionAll(back).distinct().join(entities.select("entity_id"), "entity_id", "left_semi")


def outbound(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, targets): called entities in the order of their first line."""
    e = edges.where("type = 'calls'").join(ids.select(F.col("entity_id").alias("src_id")), "src_id", "left_semi")
    first = e.groupBy("src_id", "dst_id").agg(F.min("line").alias("line"))
    listed = first.groupBy(F.col("src_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("line", "dst_id"))).alias("t"))
    return listed.select("entity_id", F.transform("t", lambda x: x["dst_id"]).alias("targets"))


def representatives(edges: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """(dir, entity_id, degree): the entities of highest degree of each top directory ('.' for the root)."""
    d = F.when(F.instr("file", "/") > 0, F.substring_index("file", "/", 1)).otherwise(".")
    e = entities.join(degrees(edges), "entity_id", "left").select(d.alias("dir"), "entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    n = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("degree"), "entity_id"))
    return e.withColumn("n", n).where(F.col("n") <= most).drop("n")
