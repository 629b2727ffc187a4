"""Community detection (T13-T23) and stable labels.

One algorithm at every size. A phase of local moves is a number of rounds in which nodes
move to the community of greatest gain in modularity; a round lets about half of the nodes move, by
a hash, so that neighbours do not swap for ever. With refine, moves within the communities found so
far, from single nodes, give smaller ones (as in Leiden), which are contracted, while the next level
starts from the greater ones. In the end communities fall apart into their connected parts. Levels of
more than LEVEL pairs lie in mapped files and are moved in parts (partitions.py); once a level has at
most so many, one task makes the same moves on it and on all that follow, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

ROUNDS, LEVELS = 6, 6
SETTLED = 0.002  # a phase ends when a round moves a smaller share of the nodes
SMALL = 1_000_000  # pairs that one task joins up; the result is the same either way
LEVEL = 1_000_000  # pairs of a level that one task partitions to the end, in some 60 bytes each; the result is the same either way
SLICE = 200_000  # arcs that a task sorts at a time
COHESION_FLOOR, COHESION_LEAST = 0.05, 50  # fixed values: communities this large and less cohesive are split


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) per unordered pair, the greatest weight (1 where absent)."""
    return _ends(edges).groupBy("a", "b").agg(F.max("weight").alias("weight"))


def induced(pairs: DataFrame, subset: DataFrame) -> DataFrame:
    """The pairs within a set of nodes (id)."""
    ids = subset.select("id").distinct()
    return pairs.join(ids, pairs["a"] == ids["id"], "left_semi").join(ids, pairs["b"] == ids["id"], "left_semi")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component), the smallest id reachable.

    Up to SMALL pairs one task joins them up; beyond, rounds of contraction let every node point at
    its smallest neighbour and go on with the nodes pointed at, which at least halves them.
    """
    left = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops = left.where("a = b").select(F.col("a").alias("id"))
    if left.limit(SMALL + 1).count() <= SMALL:
        return left.groupBy(F.lit("all")).applyInPandas(_join_up, "id string, component string")
    steps, left = [], left.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        steps.append(to)
        one = left.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("p"), "b")
        two = one.join(to.withColumnRenamed("node", "b"), "b").select("p", F.col("to").alias("q")).where("p <> q")
        left = written(two.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    if not steps:
        return loops.select("id", F.col("id").alias("component"))
    out = steps[0].withColumnRenamed("to", "component")
    for to in steps[1:]:
        out = written(out.join(to.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    out = out.withColumnRenamed("node", "id").select("id", "component")
    return out.unionByName(loops.join(out, "id", "left_anti").select("id", F.col("id").alias("component")))


def _join_up(pdf):
    """Components of a bounded table of pairs."""
    import pandas as pd

    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return pd.DataFrame([(x, find(x)) for x in list(root)], columns=["id", "component"])


def local_moves(pairs: DataFrame, start: DataFrame, total: float, resolution: float) -> DataFrame:
    """(v, c, h) after rounds of moves from the communities of start (v, c, h); pairs (a, b, weight) may hold loops (a = b).

    h is a hash whose bit for the round decides which nodes may move; of equal gains the smallest community counts.
    """
    arcs = written(pairs.where("a <> b").select("a", "b", "weight").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "arcs")
    loops = pairs.where("a = b").select("a", (2 * F.col("weight")).alias("weight"))
    strength = written(arcs.select("a", "weight").unionByName(loops).groupBy(F.col("a").alias("v")).agg(F.sum("weight").alias("k")), "strength")
    labels, nodes, quiet = start, strength.count(), 0
    for turn in range(ROUNDS):
        known = labels.join(strength, "v", "left").select("v", "c", "h", F.coalesce("k", F.lit(0.0)).alias("k"))
        mass = known.groupBy("c").agg(F.sum("k").alias("mass"))
        links = arcs.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("weight").alias("link"))
        # Every node also weighs staying where it is, with no links to show for it if need be.
        stay = known.select("v", "c", F.lit(0.0).alias("link"))
        choices = links.unionByName(stay).groupBy("v", "c").agg(F.sum("link").alias("link")).join(mass, "c")
        choices = choices.join(known.select("v", F.col("c").alias("own"), "k", "h"), "v")
        others = F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("link") - F.lit(resolution) * F.col("k") * others / F.lit(2 * total)
        best = choices.groupBy("v").agg(
            F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.round(gain, 9))).alias("now"), F.first("own").alias("own"), F.first("h").alias("h")
        )
        moves = (F.col("best.gain") > F.col("now")) & (F.shiftright("h", turn).bitwiseAND(F.lit(1)) == 0)
        after = written(best.select("v", F.when(moves, -F.col("best.c")).otherwise(F.col("own")).alias("c"), "h", moves.alias("moved")), "labels")
        moved = after.where("moved").count()
        labels = after.select("v", "c", "h")
        quiet = quiet + 1 if moved <= SETTLED * nodes else 0
        if quiet == 2:
            break
    return labels


def contract(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The weights between communities; what lies inside one becomes its loop."""
    side = lambda end: labels.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return written(j.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("weight").alias("weight")), "contracted")


def partition(pairs: DataFrame, resolution: float = 1.0, refine: bool = True, split_of: int | None = None) -> DataFrame:
    """T13 (refine) and T14: (id, community), a community being named after its smallest member.

    With split_of, how many nodes there are in all, the large and loose communities are split as well.
    """
    total = pairs.agg(F.sum("weight")).first()[0]
    if not total:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("community")).limit(0)
    if pairs.count() > LEVEL:
        return _partition_files(pairs, "sum", resolution, refine, split_of)
    # Numbers in the order of ids, so that ties fall alike however the table is partitioned.
    ids = pairs.select("a").union(pairs.select("b")).distinct().orderBy("a")
    ids = written(ids.select(F.col("a").alias("id"), F.monotonically_increasing_id().alias("v")), "ids")
    start = ids.select("v", F.col("v").alias("c"), F.xxhash64("id").alias("h"))
    if start.select("h").distinct().count() != start.count():
        return _partition_files(pairs, "sum", resolution, refine, split_of)
    # No two ids of one hash, so the task finds the numbers of a pair's ends by their hashes.
    hashed = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "weight")
    return by_name(finished(hashed, start, total, resolution, refine, split_of), ids)


def _ends(edges: DataFrame) -> DataFrame:
    """The pairs of undirected_weights() before they are grouped."""
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), w.alias("weight"))


def _partition_files(pairs: DataFrame, how: str, resolution: float, refine: bool, split_of: int | None = None) -> DataFrame:
    from .partitions import Partitioned

    files = Partitioned(pairs, how)
    if files.level is None or not files.level.total:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("community")).limit(0)
    return files.rows(files.partition(resolution, refine, split_of))


def partition_edges(edges: DataFrame, resolution: float = 1.0, refine: bool = True) -> DataFrame:
    """partition() of undirected_weights(); the pairs of many edges are grouped where they are laid out, without a table of their own."""
    if edges.count() > LEVEL:
        return _partition_files(_ends(edges), "max", resolution, refine)
    return partition(written(undirected_weights(edges)), resolution, refine)


def by_name(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, community) of numbers (v, c)."""
    return found.join(ids, "v").select("id", "c").join(ids.select(F.col("v").alias("c"), F.col("id").alias("community")), "c").select("id", "community")


def finished(level: DataFrame, start: DataFrame, total: float, resolution: float, refine: bool, split_of: int | None) -> DataFrame:
    """(v, c) for the nodes of start (v, c, h): the connected part of the last home of each, in one task.

    The ends of pairs are given by h. With split_of the parts are split as split_large and split_loose do.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairs, nodes = [], []
        for batch in batches:
            a, b, w, c, h, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if node.any():
                nodes.append((a[node], c[node], h[node]))
            if not node.all():
                pairs.append((a[~node], b[~node], w[~node]))
        if not nodes:
            return
        v, c, h = (np.concatenate(x) for x in zip(*nodes, strict=True))
        # Numbers without gaps, in the same order.
        names = np.unique(v)
        at = np.searchsorted(names, v)
        community, bits = np.arange(len(names), dtype=np.int32), np.zeros(len(names), np.int64)
        community[at], bits[at] = np.searchsorted(names, c), h
        order = np.argsort(h)
        number = lambda x: at[order[np.searchsorted(h[order], x)]]
        ends = [np.concatenate([number(p[i]).astype(np.int32) for p in pairs]) if pairs else np.zeros(0, np.int32) for i in (0, 1)]
        weights = np.concatenate([p[2] for p in pairs]) if pairs else np.zeros(0)
        del pairs, nodes
        home = _parts(ends[0], ends[1], _levels(ends[0], ends[1], weights, at, community, bits, total, resolution, refine, LEVELS, None))
        if split_of is not None:
            size = np.bincount(home, minlength=len(home))
            home = _split(ends[0], ends[1], weights, home, size > max(10, int(split_of * 0.25)), bits, resolution)
            size = np.bincount(home, minlength=len(home))
            apart = (home[ends[0]] == home[ends[1]]) & (ends[0] != ends[1])
            share = np.bincount(home[ends[0][apart]], minlength=len(home)) / np.maximum(size * (size - 1.0) / 2, 1.0)
            home = _split(ends[0], ends[1], weights, home, (size >= COHESION_LEAST) & (share < COHESION_FLOOR), bits, resolution)
        for i in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000]), pa.array(names[home[at[i : i + 100_000]]])], ["v", "c"])

    none = F.lit(0).cast("long")
    rows = level.select("a", "b", F.col("weight").cast("double").alias("weight"), none.alias("c"), none.alias("h"), F.lit(False).alias("node"))
    rows = rows.unionByName(start.select(F.col("v").alias("a"), none.alias("b"), F.lit(0.0).alias("weight"), "c", "h", F.lit(True).alias("node")))
    return written(rows.coalesce(1).mapInArrow(run, "v long, c long"), "finished")


def _levels(a, b, w, nodes, community, bits, total: float, resolution: float, refine: bool, levels: int, before: int | None):
    """The levels of partition() on arrays: per number its last home. Only `nodes` (numbers) are nodes of the first level."""
    import numpy as np

    n = len(community)
    member, home, real = np.arange(n), community, nodes
    for _ in range(levels):
        found = _moves(a, b, w, community, bits, total, resolution)
        home = found[member]
        size = len(np.unique(home[nodes]))
        if size == before:
            break
        before, parts = size, found
        if refine:
            inside = found[a] == found[b]
            parts = _moves(a[inside], b[inside], w[inside], np.arange(n, dtype=np.int32), bits, total, resolution)
        member = parts[member]
        # The contracted nodes: the least whole and the least hash of their parts.
        whole, least = np.full(n, n, np.int32), np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(whole, parts[real], found[real])
        np.minimum.at(least, parts[real], bits[real])
        real = np.unique(parts[real])
        community, bits = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
        community[real], bits[real] = whole[real], least[real]
        low, high = np.minimum(parts[a], parts[b]).astype(np.int64), np.maximum(parts[a], parts[b])
        key, where = np.unique(low * n + high, return_inverse=True)
        a, b, w = (key // n).astype(np.int32), (key % n).astype(np.int32), np.bincount(where, w, len(key))
    return home


def _moves(a, b, w, community, bits, total: float, resolution: float):
    """local_moves() on arrays, SLICE arcs at a time."""
    import numpy as np

    n, loop = len(community), a == b
    mine, other, link = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), np.concatenate([w[~loop], w[~loop]])
    k = np.bincount(mine, link, n) + np.bincount(a[loop], 2 * w[loop], n)
    there = (np.bincount(mine, minlength=n) + np.bincount(a[loop], minlength=n)) > 0
    order = np.argsort(mine, kind="stable")
    other, link = other[order], link[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=n))])
    del mine, order
    cuts, quiet = [0], 0
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, min(n, int(np.searchsorted(first, first[cuts[-1]] + SLICE, "right")) - 1)))
    for turn in range(ROUNDS):
        mass, after, moved = np.bincount(community, k, n), community.copy(), 0
        may = (bits >> turn) & 1 == 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            # Those that may not move in this round need not be weighed.
            free, arcs = np.arange(lo, hi, dtype=np.int64)[may[lo:hi]], slice(first[lo], first[hi])
            if not len(free):
                continue
            on = np.repeat(may[lo:hi], np.diff(first[lo : hi + 1]))
            v = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(first[lo : hi + 1]))
            go, target = best_moves(free, v[on], other[arcs][on], link[arcs][on], community, k[free], mass, total, resolution)
            after[free[go]] = target[go]
            moved += int((go & there[free]).sum())
        community = after
        quiet = quiet + 1 if moved <= SETTLED * there.sum() else 0
        if quiet == 2:
            break
    return community


def best_moves(nodes, v, other, link, community, k, mass, total: float, resolution: float):
    """Whether each of nodes (in order) gains by a move, and the best community for it: the arcs from v, all of these nodes, to other; k of the nodes."""
    import numpy as np

    # Every node also weighs staying where it is, with no links to show for it if need be.
    key = np.concatenate([v << 32 | community[other], nodes << 32 | community[nodes]])
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    v, c = key[start] >> 32, key[start] & 0xFFFFFFFF
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    at = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(v)))
    own, k = c == community[v], k[at]
    gain = np.round(np.add.reduceat(np.concatenate([link, np.zeros(len(nodes))])[order], start) - resolution * k * (mass[c] - np.where(own, k, 0.0)) / (2 * total), 9)
    best, now = np.maximum.reduceat(gain, heads), gain[own]
    top = np.flatnonzero(gain == best[at])  # in order of v and c, so the first of a node is its smallest
    return best > now, c[top[np.concatenate([[True], at[top[1:]] != at[top[:-1]]])]]


def _split(a, b, w, home, which, bits, resolution: float):
    """split() on arrays: the communities for which `which` holds, partitioned again on their own."""
    import numpy as np

    inside = (home[a] == home[b]) & which[home[a]]
    a, b, w = a[inside], b[inside], w[inside]
    again = np.where(which[home], np.arange(len(home), dtype=np.int32), home)
    if w.sum():
        nodes = np.unique(np.concatenate([a, b]))
        parts = _parts(a, b, _levels(a, b, w, nodes, np.arange(len(home), dtype=np.int32), bits, w.sum(), resolution, True, LEVELS, None))
        again[nodes] = parts[nodes]
    return again


def _parts(a, b, home):
    """The connected parts of communities, named after their smallest number."""
    import numpy as np

    name, inside = np.arange(len(home), dtype=np.int32), home[a] == home[b]
    a, b = a[inside], b[inside]
    while len(a):
        p, q = name[a], name[b]
        np.minimum.at(name, p, q)
        np.minimum.at(name, q, p)
        while (name[name] != name).any():
            name = name[name]
        apart = name[a] != name[b]
        a, b = a[apart], b[apart]
    return name


def total_order(members: DataFrame) -> DataFrame:
    """Community numbers by size, greatest first, then by the smallest member: (cid, node_id)."""
    groups = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    # One row per community.
    ranked = groups.withColumn("cid", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("bigint"))
    return members.join(ranked.select("community", "cid"), "community").select("cid", F.col("id").alias("node_id"))


def reattach_hubs(members: DataFrame, pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Every hub joins the community most of its neighbours are in; the smallest on ties, its own if it has none."""
    arcs = pairs.select("a", "b").union(pairs.select("b", "a"))
    votes = arcs.join(hubs.select(F.col("id").alias("a")), "a", "left_semi").join(members.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("a").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
    placed = hubs.select("id").join(best, hubs["id"] == best["a"], "left").select("id", F.coalesce("community", "id").alias("community"))
    return members.unionByName(placed)


def split(members: DataFrame, pairs: DataFrame, which: DataFrame, resolution: float = 1.0) -> DataFrame:
    """The communities of which (community) are partitioned again on their own; what has no edges inside falls apart."""
    which = written(which.select("community"))
    if which.isEmpty():
        return members.select("id", "community")
    inside = members.join(which, "community", "left_semi")
    side = lambda end: inside.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    own = pairs.join(side("a"), "a").join(side("b"), "b").where("c_a = c_b").select("a", "b", "weight")
    again = written(partition(own, resolution))
    parts = inside.join(again.select("id", F.col("community").alias("part")), "id", "left").select("id", F.concat_ws("/", "community", F.coalesce("part", "id")).alias("community"))
    return members.join(which, "community", "left_anti").select("id", "community").unionByName(parts)


def split_large(members: DataFrame, pairs: DataFrame, share: float = 0.25, least: int = 10, resolution: float = 1.0) -> DataFrame:
    """Communities above max(least, share of all) are split."""
    limit = max(least, int(members.count() * share))
    return split(members, pairs, members.groupBy("community").count().where(F.col("count") > limit), resolution)


def split_loose(members: DataFrame, pairs: DataFrame, floor: float = COHESION_FLOOR, least: int = COHESION_LEAST) -> DataFrame:
    """Communities of `least` members or more whose cohesion is below floor are split."""
    from .aggregate import cohesion

    scores = cohesion(pairs.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")), members.select(F.col("community").alias("cid"), F.col("id").alias("node_id")))
    return split(members, pairs, scores.where((F.col("members") >= least) & (F.col("cohesion") < floor)).select(F.col("cid").alias("community")))


def cluster(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, hub_percentile: float | None = None) -> DataFrame:
    """(cid, node_id): hubs out, partition, isolated nodes alone, hubs back, large and loose ones split, numbered."""
    from .aggregate import degree_endpoints, hub_nodes

    if hub_percentile is None and edges.count() > LEVEL:
        from .partitions import Partitioned

        files = Partitioned(_ends(edges), "max")
        # Spark takes rows read from files for few and would send them all to the driver.
        alone = written(nodes.select("id").join(files.rows().hint("merge"), "id", "left_anti"))
        found = files.rows(files.partition(resolution, True, files.n + alone.count()))
        return total_order(written(found.unionByName(alone.withColumn("community", F.col("id")))))
    pairs = written(undirected_weights(edges))
    if hub_percentile is None:
        ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        alone = nodes.select("id").join(ends, "id", "left_anti")
        found = partition(pairs, resolution, split_of=ends.count() + alone.count())
        known = ends.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
        return total_order(written(known.unionByName(alone.withColumn("community", F.col("id")))))
    hubs, rest = None, pairs
    if hub_percentile is not None:
        hubs = hub_nodes(degree_endpoints(edges, nodes), hub_percentile).select("id")
        rest = pairs.join(hubs, pairs["a"] == hubs["id"], "left_anti").join(hubs, pairs["b"] == hubs["id"], "left_anti")
    found = written(partition(rest, resolution))
    alone = nodes.select("id").join(found, "id", "left_anti").withColumn("community", F.col("id"))
    members = written(found.unionByName(alone) if hubs is None else reattach_hubs(found.unionByName(alone.join(hubs, "id", "left_anti")), pairs, hubs))
    return total_order(written(split_loose(written(split_large(members, pairs)), pairs)))


def overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    """Shared members of new and old communities (new_cid, old_cid, shared)."""
    a, b = new.select("node_id", F.col("cid").alias("new_cid")), old.select("node_id", F.col("cid").alias("old_cid"))
    return a.join(b, "node_id").groupBy("new_cid", "old_cid").agg(F.count(F.lit(1)).alias("shared"))


def keep_labels(new: DataFrame, old: DataFrame) -> DataFrame:
    """New communities take the number of the old one they share most with, each once; others get fresh numbers by size.

    The greedy matching, greatest overlap first, goes on in rounds on tables: a pair that is the best
    one left for both its communities is taken, as nothing can come before it.
    """
    left = written(overlap(new, old))
    taken = None
    while not left.isEmpty():
        rank = [F.desc("shared"), F.col("old_cid"), F.col("new_cid")]
        first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*rank)) == 1
        picked = written(left.select("*", first("old_cid").alias("_o"), first("new_cid").alias("_n")).where("_o and _n").select("old_cid", "new_cid"))
        taken = picked if taken is None else written(taken.unionByName(picked))
        left = written(left.join(picked.select("old_cid"), "old_cid", "left_anti").join(picked.select("new_cid"), "new_cid", "left_anti"))
    none = new.select(F.col("cid").alias("old_cid"), F.col("cid").alias("new_cid")).limit(0)
    mapping = (none if taken is None else taken).select(F.col("new_cid").alias("cid"), F.col("old_cid").alias("to"))
    fresh = new.join(mapping.select("cid"), "cid", "left_anti").groupBy("cid").count()
    # One row per community that has no number yet, and one with the greatest number in use.
    top = old.agg(F.coalesce(F.max("cid"), F.lit(-1)).alias("top"))
    numbered = fresh.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("count"), "cid"))).join(F.broadcast(top)).select("cid", (F.col("top") + F.col("_k")).alias("to"))
    return new.join(mapping.unionByName(numbered), "cid").select(F.col("to").cast("long").alias("cid"), "node_id")


def communities_of(nodes: DataFrame) -> DataFrame:
    """(cid, node_id) from the nodes' own attribute."""
    return nodes.where("community is not null").select(F.col("community").alias("cid"), F.col("id").alias("node_id"))


def renumber(members: DataFrame) -> DataFrame:
    """Dense numbers in order of first appearance (_ord)."""
    first = members.groupBy("community").agg(F.min("_ord").alias("_f"))
    return members.join(first.withColumn("cid", (F.row_number().over(Window.orderBy("_f")) - 1).cast("bigint")), "community").select("cid", "id")


def modularity(pairs: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """The quality of a partition: (id, community) over weighted pairs."""
    side = lambda c: members.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    m = pairs.agg(F.sum("weight")).first()[0]
    inside = j.where("c_a = c_b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = j.select(F.col("c_a").alias("c"), "weight").union(j.select("c_b", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / m - resolution * ends.agg(F.sum(F.pow(F.col("d") / (2 * m), 2))).first()[0]
