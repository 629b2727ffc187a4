"""Traversal and centrality.

Frontiers are tables. Each step joins the frontier with the edges, leaves out what has been visited,
and writes the new frontier, so that later steps read it instead of finding it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import degree_all, hub_threshold
from .paths import dependencies
from .scratch import written

IMPACT_RELATIONS = (
    "calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "depends_on",
)


def arcs_of(edges: DataFrame, directed: bool) -> DataFrame:
    """(source, target) as a walk may go; repeated pairs stay, as every step makes its nodes distinct."""
    pairs = edges.select("source", "target")
    return pairs if directed else pairs.union(edges.select("target", "source"))


def both_ways(edges: DataFrame) -> DataFrame:
    return arcs_of(edges, False).distinct()


def neighbors(edges: DataFrame, node: str, directed: bool = True) -> DataFrame:
    """(other) for a node: its targets, and its sources too if undirected."""
    out = successors(edges, node)
    return out if directed else out.union(predecessors(edges, node)).distinct()


def successors(edges: DataFrame, node: str) -> DataFrame:
    """T04."""
    return edges.where(F.col("source") == node).select(F.col("target").alias("other"))


def predecessors(edges: DataFrame, node: str) -> DataFrame:
    """T05."""
    return edges.where(F.col("target") == node).select(F.col("source").alias("other"))


def hub_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the nodes that walks do not go through."""
    degrees = written(degree_all(edges, nodes), "degrees")
    return degrees.join(F.broadcast(hub_threshold(degrees)), F.col("degree") >= F.col("threshold")).select("id")


def bfs(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 3, directed: bool = True) -> DataFrame:
    """(id, depth) of what seeds (id) reach in `depth` steps; a hub that is no seed is not gone through."""
    arcs = arcs_of(edges, directed)
    hubs = hub_ids(edges, nodes)
    seed_ids = seeds.select("id").distinct()
    blocked = written(hubs.join(seed_ids, "id", "left_anti"))
    visited = seed_ids.withColumn("depth", F.lit(0))
    frontier = visited
    for d in range(1, depth + 1):
        go = frontier.join(blocked, "id", "left_anti").select(F.col("id").alias("source"))
        reached = arcs.join(go, "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = written(reached.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
    return visited


def bfs_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges along which a search went on: from a node to one a step deeper."""
    s = reached.select(F.col("id").alias("source"), F.col("depth").alias("_d"))
    t = reached.select(F.col("id").alias("target"), F.col("depth").alias("depth"))
    return edges.select("source", "target").distinct().join(s, "source").join(t, "target").where("depth = _d + 1").select("source", "target", "depth")


def dfs(edges: DataFrame, nodes: DataFrame, seeds: list[str], depth: int = 3, directed: bool = True) -> DataFrame:
    """(id, depth, visit) in depth-first order.

    A node first met deep is not met again nearer the root, so the order matters and the walk is
    sequential. The ball of `depth` steps around the seeds is found by frontier joins, and the walk
    runs in one worker over that ball's edges, neighbours in order of _ord.
    """
    import pandas as pd

    spark = edges.sparkSession
    ball = bfs(edges, nodes, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, directed)
    hubs = hub_ids(edges, nodes)
    arcs = edges.select("source", "target", "_ord") if directed else edges.select("source", "target", "_ord").union(edges.select("target", "source", "_ord"))
    inside = arcs.join(ball.select(F.col("id").alias("source")), "source", "left_semi").join(ball.select(F.col("id").alias("target")), "target", "left_semi")
    marked = inside.join(hubs.select(F.col("id").alias("source"), F.lit(True).alias("hub")), "source", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    # The seeds ride along, so that one without edges is visited too.
    rows = marked.unionByName(spark.createDataFrame([(s, None, -1, False) for s in seeds], "source string, target string, _ord long, hub boolean"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out_of: dict = {}
        closed = set(pdf.loc[pdf["hub"], "source"]) - set(seeds)
        for s, t in pdf[pdf["_ord"] >= 0].sort_values("_ord")[["source", "target"]].itertuples(index=False):
            out_of.setdefault(s, []).append(t)
        order, stack = {}, [(s, 0) for s in reversed(seeds)]
        while stack:
            node, d = stack.pop()
            if node in order or d > depth:
                continue
            order[node] = (d, len(order))
            if node not in closed:
                stack += [(t, d + 1) for t in out_of.get(node, []) if t not in order]
        return pd.DataFrame([(k, d, v) for k, (d, v) in order.items()], columns=["id", "depth", "visit"])

    return rows.groupBy(F.lit("all")).applyInPandas(walk, "id string, depth int, visit int")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """(step, id) along a shortest undirected path, parents being the smallest ids; empty if there is none."""
    spark = edges.sparkSession
    arcs = arcs_of(edges, False)
    visited = spark.createDataFrame([(source, None, 0)], "id string, parent string, depth int")
    frontier = visited
    for d in range(1, max_hops + 1):
        step = arcs.join(frontier.select(F.col("id").alias("source")), "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        frontier = written(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
        if source == target or not frontier.where(F.col("id") == target).isEmpty():
            break
        if frontier.isEmpty():
            return spark.createDataFrame([], "step int, id string")
    path, at = [], target
    while at is not None:  # one lookup per hop of the path
        row = visited.where(F.col("id") == at).select("parent", "depth").first()
        if row is None:
            return spark.createDataFrame([], "step int, id string")
        path.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(sorted(path), "step int, id string")


def affected(edges: DataFrame, seed: str, relations=IMPACT_RELATIONS, depth: int = 3) -> DataFrame:
    """(id, depth, via): what depends on seed or on its own members, which are not reported themselves."""
    spark = edges.sparkSession
    own = edges.where((F.col("source") == seed) & F.col("relation").isin("method", "contains")).select(F.col("target").alias("id"))
    start = own.union(spark.createDataFrame([(seed,)], "id string")).distinct().withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast("string"))
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("target").alias("from"), F.col("source").alias("id"), "relation", "_ord")
    visited = frontier = start
    for d in range(1, depth + 1):
        hit = back.join(frontier.select(F.col("id").alias("from")), "from", "left_semi").groupBy("id").agg(F.min_by("relation", "_ord").alias("via"))
        frontier = written(hit.join(visited.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"))
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def file_graph(edges: DataFrame, nodes: DataFrame, relations=("imports_from", "re_exports", "imports")) -> DataFrame:
    """Distinct (a, b) between files, oriented as the edge's own file imports."""
    e = edges.where(F.col("relation").isin(*relations))
    if "deferred" in edges.columns:
        e = e.where("not coalesce(deferred, false)")
    file = lambda c: nodes.select(F.col("id").alias(c), F.col("source_file").alias(f"_{c}_file"))
    own = e.withColumnRenamed("source_file", "_edge_file") if "source_file" in e.columns else e.withColumn("_edge_file", F.lit(None).cast("string"))
    j = own.join(file("source"), "source").join(file("target"), "target")
    # The importing file is the edge's own; if that is the target's, the edge is stored the other way round.
    turned = F.coalesce((F.col("_edge_file") == F.col("_target_file")) & (F.col("_edge_file") != F.col("_source_file")), F.lit(False))
    a, b = F.when(turned, F.col("_target_file")).otherwise(F.col("_source_file")), F.when(turned, F.col("_source_file")).otherwise(F.col("_target_file"))
    return j.select(a.alias("a"), b.alias("b")).where("coalesce(a, '') <> '' and coalesce(b, '') <> ''").distinct()


def import_cycles(pairs: DataFrame, max_length: int = 5, n: int = 20) -> DataFrame:
    """Simple cycles of (a, b) up to max_length, each once with its smallest file first.

    Paths grow only through files greater than their first one, so a cycle is found from its smallest
    file alone. The shortest n are returned in order of length and names.
    """
    loops = pairs.where("a = b").select(F.array("a").alias("path"))
    arcs = pairs.where("a <> b")
    paths, found = arcs.where("a < b").select(F.array("a", "b").alias("path")), loops
    for length in range(2, max_length + 1):
        last = F.element_at("path", -1)
        closed = paths.join(arcs, (last == F.col("a")) & (F.element_at("path", 1) == F.col("b")), "left_semi")
        found = found.union(closed.select("path"))
        if length < max_length:
            grown = paths.withColumn("_last", last).join(arcs, F.col("_last") == F.col("a")).where((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b")))
            paths = written(grown.select(F.concat("path", F.array("b")).alias("path")))
    return found.select(F.size("path").alias("length"), F.array_join("path", " -> ").alias("cycle")).orderBy("length", "cycle").limit(n)


SOURCES = 100  # whose paths are counted together, a column each


def _counts(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def shortest_path_steps(arcs: DataFrame, sources: list[str]) -> list[DataFrame]:
    """Written tables (v, c0, c1, ...) for distances 0, 1, ...: how many shortest paths from each source end at v there.

    arcs (source, target) holds every pair in both directions, once. A neighbour of a node at
    distance d is at d - 1, d or d + 1, so a step looks back at two tables only.
    """
    spark, names = arcs.sparkSession, _counts(len(sources))
    start = spark.createDataFrame(list(zip(sources, range(len(sources)), strict=True)), "v string, i int")
    steps = [written(start.select("v", *[F.when(F.col("i") == i, 1.0).otherwise(0.0).alias(c) for i, c in enumerate(names)]))]
    while True:
        grown = arcs.join(steps[-1], arcs["source"] == steps[-1]["v"]).groupBy(F.col("target").alias("v")).agg(*[F.sum(c).alias(c) for c in names])
        for before in steps[-2:]:
            had = before.select("v", *[F.col(c).alias(f"_{c}") for c in names])
            grown = grown.join(had, "v", "left").select("v", *[F.when(F.coalesce(f"_{c}", F.lit(0.0)) > 0, 0.0).otherwise(F.col(c)).alias(c) for c in names])
        grown = written(grown.where(F.exists(F.array(*names), lambda x: x > 0)))
        if grown.isEmpty():
            return steps
        steps.append(grown)


def path_shares(arcs: DataFrame, steps: list[DataFrame]) -> list[DataFrame]:
    """Going back over the steps: (v, w, part) for the edges on the shortest paths of all sources."""
    names = steps[0].columns[1:]
    parts = []
    due = None  # per deeper node w and source, (1 + owed) / paths
    for d in range(len(steps) - 1, -1, -1):
        here = steps[d]
        if due is None:
            now = here.select("*", *[F.lit(0.0).alias(f"o_{c}") for c in names])
        else:
            onto = arcs.join(due, arcs["source"] == due["v"]).drop("v")
            back = onto.groupBy(F.col("target").alias("v")).agg(*[F.sum(f"e_{c}").alias(f"o_{c}") for c in names])
            now = here.join(back, "v", "left").select("v", *names, *[(F.col(c) * F.coalesce(f"o_{c}", F.lit(0.0))).alias(f"o_{c}") for c in names])
            total = F.aggregate(F.array(*[F.col(c) * F.col(f"e_{c}") for c in names]), F.lit(0.0), lambda x, y: x + y)
            parts.append(onto.join(here, onto["target"] == here["v"]).select("v", F.col("source").alias("w"), total.alias("part")).where("part > 0"))
        now = written(now)
        due = now.select("v", *[F.when(F.col(c) > 0, (1 + F.col(f"o_{c}")) / F.col(c)).otherwise(0.0).alias(f"e_{c}") for c in names])
    return parts


def pivot_rule(n: int) -> int | None:
    """How many sources betweenness takes: all up to 1000 nodes, else the first 100."""
    return 100 if n > 1000 else None


def _ids(nodes: DataFrame, first: int | None) -> list[str]:
    order = nodes.select("id", "_ord").orderBy("_ord", "id")
    return [r[0] for r in (order.limit(first) if first else order).collect()]  # bounded by pivot_rule or edge_betweenness's limit


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = -1, reference_scale: bool = False) -> DataFrame:
    """(id, betweenness) over shortest paths from all nodes or the first `pivots`; -1 leaves that to pivot_rule.

    A textbook scale unless reference_scale doubles it. Paths are counted on arrays, each task for some of the sources (see paths.py).
    """
    n = nodes.count()
    pivots = pivot_rule(n) if pivots == -1 else pivots
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    scale *= (n / min(pivots, n) if pivots else 1.0) * (2.0 if reference_scale else 1.0)
    owed = dependencies(nodes, edges, _ids(nodes, pivots))
    if owed is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    return owed.select("id", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(nodes: DataFrame, edges: DataFrame, reference_scale: bool = False, limit: int = 5000) -> DataFrame:
    """(source, target, betweenness) of undirected edges; no rows above `limit` nodes, as every node is a source."""
    n = nodes.count()
    if n > limit:
        return edges.select("source", "target", F.lit(0.0).alias("betweenness")).limit(0)
    sources, arcs, parts = _ids(nodes, None), written(both_ways(edges).where("source <> target")), None
    for at in range(0, len(sources), SOURCES):
        for part in path_shares(arcs, shortest_path_steps(arcs, sources[at : at + SOURCES])):
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return edges.select("source", "target", F.lit(0.0).alias("betweenness")).limit(0)
    scale = (1.0 / (n * (n - 1)) if n > 1 else 0.0) * (2.0 if reference_scale else 1.0)
    return parts.groupBy(F.least("v", "w").alias("source"), F.greatest("v", "w").alias("target")).agg((F.sum("part") * scale).alias("betweenness"))


def betweenness_surprises(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n edges most paths go through."""
    return edge_betweenness(nodes, edges).orderBy(F.desc(F.round("betweenness", 12)), "source", "target").limit(n)


def spring_layout(edges: DataFrame, limit: int = 5000, steps: int = 50, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Positions of at most `limit` nodes by attraction along edges and repulsion between nodes."""
    import numpy as np

    # A layout is a picture of a bounded part: the first edges in order of their ends, the same ones each time.
    pairs = [(r[0], r[1]) for r in edges.select("source", "target").distinct().orderBy("source", "target").limit(limit * 4).collect()]
    names = sorted({x for p in pairs for x in p})[:limit]
    index = {x: i for i, x in enumerate(names)}
    e = np.array([(index[a], index[b]) for a, b in pairs if a in index and b in index], int).reshape(-1, 2)
    n = len(names)
    if not n:
        return {}
    at, k = np.random.default_rng(seed).random((n, 2)), 1 / np.sqrt(n)
    for step in range(steps):
        gap = at[:, None] - at[None]
        far = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
        push = (gap * (k * k / far**2)[:, :, None]).sum(axis=1)
        pull = np.zeros_like(at)
        d = at[e[:, 0]] - at[e[:, 1]]
        force = d * (np.linalg.norm(d, axis=1) / k)[:, None]
        np.add.at(pull, e[:, 0], -force)
        np.add.at(pull, e[:, 1], force)
        move = push + pull
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 0.01)
        at += move / size * np.minimum(size, 0.1 * (1 - step / steps))
    return {x: (float(a), float(b)) for x, (a, b) in zip(names, at, strict=True)}
