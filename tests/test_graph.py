"""Operators on hand-made graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as S
from graphloom.operators import aggregate as A
from graphloom.operators import build as B
from graphloom.operators import communities as C
from graphloom.operators import entity as E
from graphloom.operators import filters as X
from graphloom.operators import incremental as U
from graphloom.operators import rank as W
from graphloom.operators import resolve as R
from graphloom.operators import traverse as T
from graphloom.schema import Graph

EDGE = "source string, target string, relation string, confidence string, weight double, context string, source_file string, _ord long"
NODE = "id string, label string, file_type string, source_file string, source_location string, community long, _ord long"


def edges(spark, rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "calls", r[3] if len(r) > 3 else "EXTRACTED", 1.0, None, "", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EDGE)


def nodes(spark, rows):
    full = [(r[0], r[1] if len(r) > 1 else r[0], r[2] if len(r) > 2 else "code", r[3] if len(r) > 3 else "a.py", "L1", r[4] if len(r) > 4 else None, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def fold_undirected(rows):
    """Insertion in sorted order: the last edge of a pair wins, one that only reverses the survivor's relation is dropped."""
    kept = {}
    for s, t, rel, i in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        key = (min(s, t), max(s, t))
        if key in kept:
            was = kept[key]
            if was[2] == rel and (was[0], was[1]) == (t, s):
                continue
        kept[key] = (s, t, rel, i)
    return kept


def test_undirected_collapse_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [(*rng.sample("abcd", 2), rng.choice(["calls", "uses", "zaps"]), i) for i in range(60)] + [("e", "e", "calls", 60), ("e", "e", "calls", 61), ("e", "e", "uses", 62)]
    rng.shuffle(rows)
    e = spark.createDataFrame([(s, t, r, "EXTRACTED", float(i), None, "", i) for s, t, r, i in rows], EDGE)
    got = {(min(r.source, r.target), max(r.source, r.target)): (r._src, r._tgt, r.relation, r.weight) for r in B.collapse_undirected(e).collect()}
    assert got == {k: (v[0], v[1], v[2], float(v[3])) for k, v in fold_undirected(rows).items()}


def test_directed_collapse_and_dedupe(spark):
    e = edges(spark, [("a", "b", "calls"), ("a", "b", "uses"), ("a", "b", "calls"), ("b", "a", "calls")])
    assert sorted((r.source, r.target, r.relation, r._ord) for r in B.collapse_directed(e).collect()) == [("a", "b", "uses", 0), ("b", "a", "calls", 3)]
    assert B.dedupe_edges(e).count() == 3
    assert all(B.multigraph_probe(spark).values())


def test_degrees_and_hubs(spark):
    e = edges(spark, [("a", "a"), ("a", "b"), ("c", "a")])
    n = nodes(spark, [("a",), ("b",), ("c",), ("d",)])
    assert {r.id: r.degree for r in A.degree_all(e, n).collect()} == {"a": 3, "b": 1, "c": 1, "d": 0}
    assert {r.id: r.degree for r in A.degree_endpoints(e, n).collect()} == {"a": 4, "b": 1, "c": 1, "d": 0}
    assert A.hub_threshold(A.degree_all(e, n)).first()[0] == 50
    assert [r.id for r in A.hub_nodes(A.degree_all(e, n), 50).collect()] == ["a"]


def test_cohesion_of_a_complete_graph(spark):
    e = edges(spark, list(itertools.permutations("0123", 2)))
    c = spark.createDataFrame([(1, x) for x in "0123"] + [(2, "z")], "cid long, node_id string")
    assert {r.cid: r.cohesion for r in A.cohesion(e, c).collect()} == {1: 1.0, 2: 1.0}


def test_endpoints_by_normalised_id(spark):
    n = nodes(spark, [("app_main",), ("x_y",), ("X-Y",)])
    e = edges(spark, [("App.Main", "app_main"), ("app_main", "nowhere"), ("x y", "app_main")])
    assert [(r.source, r.target) for r in B.resolve_endpoints(e, n).collect()] == [("app_main", "app_main")]


def test_language_guard(spark):
    n = nodes(spark, [("p", "p", "code", "a.py"), ("t", "t", "code", "b.ts"), ("y", "y", "document", "c.yaml"), ("o", "o", "concept", "")])
    e = edges(spark, [("p", "t", "calls", "INFERRED"), ("p", "t", "calls", "EXTRACTED"), ("p", "y", "calls", "INFERRED"), ("p", "o", "calls", "INFERRED"), ("p", "t", "imports"), ("p", "y", "imports")])
    assert sorted(r._ord for r in B.guard_languages(e, n).collect()) == [1, 3, 5]


def test_hyperedges(spark):
    n = nodes(spark, [("a",), ("b",)])
    h = spark.createDataFrame([("h1", ["a", "A", "b", "zz"]), ("h2", ["zz"]), ("h1", ["b"])], "id string, members array<string>")
    assert [(r.id, r.nodes) for r in B.attach_hyperedges(h, n).collect()] == [("h1", ["a", "b"])]


def test_build_merges_ghosts_and_twins(spark):
    n = spark.createDataFrame(
        [("lib_run", "run", "code", "src/lib.py", "ast", 1), ("ghost", "Run", "function", "lib.py", "llm", 2), ("readme", "readme", "code", "readme.md", None, 3), ("readme_doc", "readme", "markdown", "readme.md", None, 4)],
        "id string, label string, file_type string, source_file string, _origin string, _ord long",
    )
    e = edges(spark, [("ghost", "readme"), ("readme_doc", "readme"), ("lib_run", "gone")])
    g = B.build_graph(n, e)
    assert sorted(r.id for r in g.nodes.collect()) == ["lib_run", "readme_doc"]
    assert [(r.source, r.target) for r in g.edges.collect()] == [("lib_run", "readme_doc")]


def test_validation(spark):
    n = nodes(spark, [("a",), ("b", "", "code"), ("c", "c", "binary")])
    e = edges(spark, [("a", "q"), ("a", "b", "calls", "MAYBE"), ("", "a")])
    found = {r.error for r in X.validate(n, e).collect()}
    assert found == {"missing label", "invalid file_type binary", "unknown node q", "invalid confidence MAYBE", "missing source", "unknown node "}
    with pytest.raises(ValueError):
        X.assert_valid(n, e)


def test_fragment(spark):
    n = nodes(spark, [("a",), ("b b",), ("w", "because", "rationale")])
    e = edges(spark, [("w", "a", "rationale_for"), ("a", "a")])
    h = spark.createDataFrame([("h", ["a", "zz"]), ("k", ["a", "a"])], "id string, nodes array<string>")
    assert {r.error for r in X.validate_fragment(n, e, 2).collect()} == {"more than 2", "bad id"}
    kept, live, hyper = X.sanitize_fragment(n, e, h)
    assert [(r.id, r.rationale) for r in kept.collect()] == [("a", "because")] and live.count() == 1 and [r.id for r in hyper.collect()] == ["k"]


def test_search(spark):
    n = W.with_norm_label(nodes(spark, [("x1", "GraphStore"), ("x2", "Store"), ("x3", "graph store"), ("x4", "Café()"), ("x5", "other", "code", "store/x.py")]))
    scored = W.top_scored(W.score_nodes(n, ["graph", "store"]), 9).orderBy("rank").collect()
    assert scored[0].id == "x3" and scored[-1].id == "x5"
    assert W.pick_endpoint(n, "store graph").first().id == "x3"
    assert W.find_node(n, "cafe").first().id == "x4"
    assert W.resolve_seed(n, "store").first().id == "x2"
    assert S.query_terms("How does the Store work?") == ["store", "work"] and S.query_terms("the of") == ["the"]
    assert S.cjk_bigrams("東京都") == ["東京都", "東京", "京都"]


def test_walks(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("x", "y")])
    n = nodes(spark, [(i,) for i in "abcdexy"])
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in T.bfs(e, n, seeds, 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert [r.id for r in T.dfs(e, n, ["a"], 3).orderBy("visit").collect()] == ["a", "d", "e", "b", "c"]
    assert [r.id for r in T.shortest_path(e, "e", "b").orderBy("step").collect()] in (["e", "d", "a", "b"], ["e", "d", "c", "b"])
    assert T.shortest_path(e, "a", "y").count() == 0 and [r.id for r in T.shortest_path(e, "a", "a").collect()] == ["a"]
    assert {r.id: r.depth for r in T.affected(e, "d", ("calls",), 2).collect()} == {"c": 1, "a": 1, "b": 2}


def test_a_hub_is_not_gone_through(spark):
    star = [("s", "h"), *[("h", f"l{i}") for i in range(60)]]
    e, n = edges(spark, star), nodes(spark, [("s",), ("h",), *[(f"l{i}",) for i in range(60)]])
    assert T.bfs(e, n, spark.createDataFrame([("s",)], "id string"), 3).count() == 2
    assert T.bfs(e, n, spark.createDataFrame([("h",)], "id string"), 1).count() == 61


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "e")], "a string, b string")
    assert [(r.length, r.cycle) for r in T.import_cycles(pairs).collect()] == [(1, "d"), (2, "a -> b"), (3, "a -> b -> c")]


def test_betweenness_against_all_shortest_paths(spark):
    """Random graphs with many shortest paths, a loop, parallel edges and two components; every path is listed."""
    import random
    from collections import Counter
    from itertools import permutations

    rng = random.Random(4)
    for size in (6, 9):
        names = [f"n{i}" for i in range(size)]
        pairs = [(a, b) for a, b in permutations(names[:-2], 2) if rng.random() < 0.3] + [(names[-2], names[-1]), ("n0", "n0")]
        pairs += pairs[:2]
        near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} - {v} for v in names}

        def shortest(s, t, near=near):
            found, front = [], [[s]]
            while front and not found:
                front = [[*p, w] for p in front for w in sorted(near[p[-1]]) if w not in p]
                found = [p for p in front if p[-1] == t]
            return found

        node, edge = Counter(), Counter()
        for s, t in permutations(names, 2):
            paths = shortest(s, t)
            for p in paths:
                node.update({v: 1 / len(paths) for v in p[1:-1]})
                edge.update({tuple(sorted(q)): 1 / len(paths) for q in zip(p, p[1:], strict=False)})
        n = spark.createDataFrame([(v, i) for i, v in enumerate(names)], "id string, _ord long")
        e = spark.createDataFrame(pairs, "source string, target string")
        got = {r.id: r.betweenness for r in T.betweenness(n, e).collect()}
        assert got.keys() == set(names) and all(abs(got[v] - node[v] / ((size - 1) * (size - 2))) < 1e-12 for v in names)
        of_edges = {(r.source, r.target): r.betweenness for r in T.edge_betweenness(n, e).collect()}
        assert of_edges.keys() == edge.keys() and all(abs(of_edges[k] - edge[k] / (size * (size - 1))) < 1e-12 for k in edge)
        some = {r.id: r.betweenness for r in T.betweenness(n, e, pivots=2).collect()}
        part = Counter()
        for s in names[:2]:
            for t in names:
                if s != t and (paths := shortest(s, t)):
                    for p in paths:
                        part.update({v: 1 / len(paths) for v in p[1:-1]})
        assert all(abs(some[v] - part[v] / ((size - 1) * (size - 2)) * size / 2) < 1e-12 for v in names)
    assert T.edge_betweenness(n, e, limit=3).count() == 0 and T.pivot_rule(1000) is None and T.pivot_rule(1001) == 100


def test_betweenness_of_a_path(spark):
    e, n = edges(spark, [("a", "b"), ("b", "c")]), nodes(spark, [("a",), ("b",), ("c",)])
    assert {r.id: r.betweenness for r in T.betweenness(n, e).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert {r.id: r.betweenness for r in T.betweenness(n, e, reference_scale=True).collect()}["b"] == 2.0
    assert {(r.source, r.target): round(r.betweenness, 9) for r in T.edge_betweenness(n, e).collect()} == {("a", "b"): round(4 / 6, 9), ("b", "c"): round(4 / 6, 9)}


def test_betweenness_of_a_long_chain(spark, monkeypatch):
    """300 steps, a table each before; the last end is no node, an edge is given twice, one has no end, and at first two ids share a hash."""
    from pyspark.sql import functions as F

    from graphloom.operators import paths

    m, real = 301, paths._hashes
    n = spark.createDataFrame([(f"v{i}", i) for i in range(m - 1)], "id string, _ord long")
    e = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(m - 1)] + [("v3", "v2"), ("v3", "v3"), ("v4", None)], "source string, target string")
    monkeypatch.setattr(paths, "_hashes", lambda c, salt: real(c, salt) if salt else (F.length(c).cast("long"), real(c, 0)[1]))
    got = {r.id: r.betweenness for r in T.betweenness(n, e, pivots=2).collect()}
    scale = 1 / ((m - 2) * (m - 3)) * (m - 1) / 2
    want = {f"v{i}": scale * (m - 1 - i) * (2 if i > 1 else i) for i in range(m - 1)}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_dependencies_in_small_pieces_and_files(spark):
    """A hub's arcs shared out, levels over many parts and vectors in files, against plain counting."""
    import random
    from collections import Counter

    from graphloom.operators.paths import dependencies

    rng = random.Random(8)
    names = [f"x{i}" for i in range(300)]
    pairs = [(rng.choice(names[:290]), rng.choice(names[:290])) for _ in range(500)] + [("x0", v) for v in names[1:120]]
    near = {v: set() for v in names}
    for a, b in pairs:
        if a != b:
            near[a].add(b), near[b].add(a)
    want, sources = Counter(), ["x0", "x7", "x7", "x299", "missing"]
    for s in sources[:-1]:
        levels, paths = [[s]], Counter({s: 1.0})
        while levels[-1]:
            step = Counter()
            for v in levels[-1]:
                step.update({w: paths[v] for w in near[v] if w not in paths})
            paths.update(step)
            levels.append(sorted(step))
        owed = Counter()
        for front, back in zip(levels[-2::-1], levels[:0:-1], strict=True):
            for v in front:
                owed[v] = sum(paths[v] / paths[w] * (1 + owed[w]) for w in back if w in near[v])
        want.update({v: x for v, x in owed.items() if v != s})
    n = spark.createDataFrame([(v,) for v in names], "id string")
    got = {r.id: r.total or 0.0 for r in dependencies(n, spark.createDataFrame(pairs, "source string, target string"), sources, piece=5, held=0).collect()}
    assert got.keys() == set(names) and all(abs(got[v] - want[v]) < 1e-9 for v in names)
    assert dependencies(n, spark.createDataFrame([], "source string, target string"), []) is None


def test_bridges_find_the_top_nodes_once(spark):
    """What stands behind the few top nodes, here counted as it is read, is not found again for their neighbours."""
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            read.add(len(b))
            yield b

    n = spark.createDataFrame([(f"n{i}", f"N{i}", "code", "a.py", i // 2, i) for i in range(6)], "id string, label string, file_type string, source_file string, community long, _ord long")
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "source string, target string")
    central = T.betweenness(n, e).coalesce(1).mapInPandas(rows, "id string, betweenness double")
    got = {r.question for r in W.questions_bridges(n, e, central).collect()}
    assert got == {"Why does `N1` connect `Community 0` to `Community 1`?", "Why does `N2` connect `Community 1` to `Community 0`?", "Why does `N3` connect `Community 1` to `Community 2`?"}
    assert read.value == 6


def cliques(spark, k=3, size=5):
    rows = [(f"{c}{i}", f"{c}{j}") for c in range(k) for i in range(size) for j in range(i)] + [(f"{c}0", f"{c + 1}0") for c in range(k - 1)]
    return edges(spark, rows), nodes(spark, [(f"{c}{i}",) for c in range(k) for i in range(size)] + [("alone",)])


def test_communities(spark, monkeypatch):
    e, n = cliques(spark)
    pairs = C.undirected_weights(e)
    for refine in (True, False):
        found = {r.id: r.community for r in C.partition(pairs, refine=refine).collect()}
        assert len(set(found.values())) == 3 and all(len({found[f"{c}{i}"] for i in range(5)}) == 1 for c in range(3))
    assert C.modularity(pairs, C.partition(pairs)) > 0.5
    placed = C.cluster(n, e)
    assert placed.count() == 16 and placed.where("node_id = 'alone'").first().cid == 3
    again = C.keep_labels(placed.withColumn("cid", F.col("cid") + 7), placed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, placed.select("cid", "node_id").collect()))
    one = {r.id: r.component for r in C.components(pairs).collect()}
    monkeypatch.setattr(C, "SMALL", 1)
    assert {r.id: r.component for r in C.components(pairs).collect()} == one == dict.fromkeys(one, "00")


def test_partition_of_planted_groups(spark):
    """Thirty groups with noise between them: high modularity, connected communities, the same result for any partitioning."""
    import random

    rng = random.Random(6)
    names = [f"g{i // 12:02d}_{i:03d}" for i in range(360)]
    rows = {tuple(sorted((a, b))) for a in names for b in names if a != b and rng.random() < (0.5 if a[:3] == b[:3] else 0.004)}
    pairs = C.undirected_weights(edges(spark, sorted(rows)))
    found = C.partition(pairs)
    home = {r.id: r.community for r in found.collect()}
    assert set(home) == {x for r in rows for x in r} and all(home[c] == c and c <= x for x, c in home.items())
    planted = spark.createDataFrame([(x, x[:3]) for x in home], "id string, community string")
    assert C.modularity(pairs, found) >= 0.95 * C.modularity(pairs, planted)
    inside = [(a, b) for a, b in rows if home[a] == home[b]]
    reached = {r.id: r.component for r in C.components(C.undirected_weights(edges(spark, inside))).collect()}
    assert all(reached[x] == c for x, c in home.items() if sum(d == c for d in home.values()) > 1)
    again = C.partition(pairs.repartition(7, "b"))
    assert {r.id: r.community for r in again.collect()} == home


def test_loose_and_large_communities_split(spark):
    rows = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(59)]
    pairs = C.undirected_weights(edges(spark, rows))
    one = spark.createDataFrame([(f"a{i:02d}", "a00") for i in range(60)] + [("z1", "z1")], "id string, community string")
    loose = C.split_loose(one, pairs)
    assert loose.count() == 61 and loose.select("community").distinct().count() > 4
    assert C.split_loose(one, pairs, least=61).select("community").distinct().count() == 2
    large = C.split_large(one, pairs)
    assert large.count() == 61 and large.select("community").distinct().count() > 4


def test_labels_are_kept_by_greatest_overlap(spark):
    import random

    rng = random.Random(3)
    old = [(f"n{i}", rng.randrange(9)) for i in range(200)]
    new = [(f"n{i}", rng.randrange(11) + 100) for i in range(220)]
    frame = lambda rows: spark.createDataFrame([(c, n) for n, c in rows], "cid long, node_id string")
    got = dict({(r.node_id, r.cid) for r in C.keep_labels(frame(new), frame(old)).collect()})
    before, shared = dict(old), {}
    for n, c in new:
        if n in before:
            shared[before[n], c] = shared.get((before[n], c), 0) + 1
    mapping: dict = {}
    for (o, c), _ in sorted(shared.items(), key=lambda x: (-x[1], *x[0])):
        if o not in mapping.values() and c not in mapping:
            mapping[c] = o
    sizes = {c: sum(x == c for _, x in new) for _, c in new}
    for c in sorted(set(sizes) - set(mapping), key=lambda c: (-sizes[c], c)):
        mapping[c] = max(8, *mapping.values()) + 1
    assert got == {n: mapping[c] for n, c in new}


def test_labels_merge_transitively(spark):
    n = nodes(spark, [("abc_c1", "Same"), ("abcd", "same "), ("ab", "SAME"), ("q", "other")])
    assert {(r.old, r.new) for r in B.label_remap(n).collect()} == {("abc_c1", "ab"), ("abcd", "ab")}


def test_entity_guards(spark):
    rows = [("model v1", "model v2"), ("parser", "parser two"), ("chart1", "chart2"), ("straße", "strasse")]
    got = spark.createDataFrame(rows, "a string, b string").select(S.numeric_tokens_differ(F.col("a"), F.col("b")), S.is_prefix_extension(F.col("a"), F.col("b")), S.is_variant_pair(F.col("a"), F.col("b")), S.entity_norm(F.col("a"))).collect()
    assert [tuple(r)[:3] for r in got] == [(True, False, True), (False, True, False), (True, False, True), (False, False, False)] and got[3][3] == "strasse"
    assert (S.damerau("abcd", "acbd"), S.damerau("ca", "abc")) == (1, 3) and round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_candidate_pairs_band_only_crowds_of_one_number(spark, monkeypatch):
    seen, write = {}, E.written
    monkeypatch.setattr(E, "written", lambda df, label="step": seen.setdefault(label, []).append(write(df, label)) or seen[label][-1])
    labels = [(f"{kind}:{i}", f"{word} {i:06}") for i in range(40) for kind, word in (("c", "customer"), ("s", "custtomer"), ("o", "order"))]
    found = E.candidate_pairs(spark.createDataFrame([*labels, ("x", "order 999999")], "key string, norm string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"c:{i}", f"s:{i}") for i in range(40))
    assert seen["bands"][0].count() == 0  # 32 a label before
    crowd = [(f"k{i}", f"label number of {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(E.FEW + 8)]
    pairs = {tuple(r) for r in E.candidate_pairs(spark.createDataFrame(crowd, "key string, norm string")).collect()}
    assert ("k0", "k1") in pairs and all(a < b for a, b in pairs) and seen["bands"][1].count() == 32 * len(crowd)


def test_id_collisions_rank_only_what_occurs_again(spark):
    rows = [("a_x", "x", "a.py"), ("a_x", "longer", "a.py"), ("b", "one", "b.py"), (None, "p", "q"), (None, "pp", "q")]
    got = E.resolve_id_collisions(spark.createDataFrame(rows, "id string, label string, source_file string")).collect()
    assert sorted(str(r.label) for r in got) == ["one", "p", "x"]


def test_entity_resolution(spark):
    n = nodes(spark, [("n1", "authentication service", "document", "a.md"), ("n2", "authentication servise", "document", "a.md"), ("n3", "authentication service 2", "document", "a.md"), ("n4", "payments", "concept", "b.md"), ("n5", "Payments", "concept", "b.md")])
    g = Graph(n, edges(spark, [("n2", "n4"), ("n1", "n2"), ("n5", "n3")]))
    out = E.deduplicate_entities(g)
    assert sorted(r.id for r in out.nodes.collect()) == ["n1", "n3", "n4"]
    assert sorted((r.source, r.target) for r in out.edges.collect()) == [("n1", "n4"), ("n4", "n3")]


def test_minhash_estimates_jaccard(spark):
    row = spark.createDataFrame([("abcdefghijklmnopqrstuvw", "abcdefghijklmnopqrstXYZ")], "a string, b string")
    a, b = S.shingles(F.col("a")), S.shingles(F.col("b"))
    est, true = row.select(E.minhash_jaccard(E.minhash(a), E.minhash(b)), E.jaccard(a, b)).first()
    assert abs(est - true) < 0.15


def test_upsert_and_reconcile(spark):
    old = Graph(nodes(spark, [("a", "a", "code", "f.py"), ("b", "b", "code", "g.py"), ("c", "c", "code", "h.py")]).withColumn("_origin", F.lit("ast")), edges(spark, [("a", "b"), ("b", "c")]).withColumn("_origin", F.lit(None).cast("string")))
    new = Graph(nodes(spark, [("a2", "a2", "code", "f.py")]).withColumn("_origin", F.lit("ast")), edges(spark, [("a2", "b")]).withColumn("_origin", F.lit(None).cast("string")))
    out = U.upsert(old, new)
    assert sorted(r.id for r in out.nodes.collect()) == ["a2", "b", "c"] and sorted((r.source, r.target) for r in out.edges.collect()) == [("a2", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        U.upsert(old, Graph(new.nodes.withColumn("source_file", F.lit("f.py")).limit(0).unionByName(new.nodes.withColumn("id", F.lit("b")).withColumn("source_file", F.lit("f.py"))), new.edges.limit(0)))
    file = lambda *names: spark.createDataFrame([(x,) for x in names], "source_file string")
    back = U.reconcile(old, new, file("f.py"), file("g.py", "h.py"), file("h.py"))
    assert sorted(r.id for r in back.nodes.collect()) == ["a2", "c"]
    assert U.unchanged(old, old) and not U.unchanged(old, out)


def test_manifest_and_tags(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, ast_hash string")
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, ast_hash string")
    assert {r.path: r.state for r in U.detect_changes(m, f).collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    assert U.repo_tags(["x/app", "y/app", "z/lib"]) == ["x_app", "y_app", "z_lib"]
    assert U.diff_summary({"new_nodes": 1, "removed_edges": 2}) == "1 new node, 2 removed edges"


def test_lessons(spark):
    m = spark.createDataFrame([("q1", "2024-01-31", "useful", ["n", "n"], 1), ("q2", "2024-01-01", "useful", ["n"], 2), ("q3", None, "dead_end", ["k"], 3), ("q4", "2030-01-01", "dead_end", ["n"], 4)], "question string, date string, outcome string, source_nodes array<string>, _ord long")
    got = {r.node: r for r in A.lessons(m, "2024-01-31", 30.0).collect()}
    assert got["n"].score == 0.5 and got["n"].standing == "contested" and got["k"].standing == "avoid"


def test_call_resolution(spark):
    n = nodes(spark, [("m_run", "run()", "code", "m.py"), ("u_help", "help()", "code", "u.py"), ("v_help", "twice()", "code", "v.py"), ("w_help", "twice()", "code", "w.py"), ("j_go", "go()", "code", "j.js")])
    e = edges(spark, [("m", "u", "imports_from")]).withColumn("source_file", F.lit("m.py"))
    calls = spark.createDataFrame([("m_run", c, member, None, "m.py") for c, member in (("help", False), ("twice", False), ("go", False), ("run", False), ("help", True))], "caller string, callee string, is_member_call boolean, receiver string, source_file string")
    assert [(r.source, r.target, r.confidence) for r in R.resolve_calls(calls, n, e).collect()] == [("m_run", "u_help", "EXTRACTED")]


def test_collisions_and_stubs(spark):
    n = nodes(spark, [("x", "X", "code", "a/one.py"), ("x", "X", "code", "b/two.py"), ("stub", "Base", "code", ""), ("base", "Base", "code", "c.py")])
    e = edges(spark, [("x", "stub", "inherits")]).withColumn("source_file", F.lit("a/one.py"))
    n2, e2 = R.split_collisions(n, e)
    assert sorted(r.id for r in n2.collect()) == ["a_one_x", "b_two_x", "base", "stub"] and e2.first().source == "a_one_x"
    n3, e3 = R.rewire_stubs(n2, e2)
    assert "stub" not in {r.id for r in n3.collect()} and e3.first().target == "base"


def test_order_of_rows_does_not_matter(spark):
    e, n = cliques(spark)
    for op in (lambda x: B.collapse_directed(x), lambda x: B.collapse_undirected(x), lambda x: W.god_nodes(n, x)):
        assert sorted(map(str, op(e).collect())) == sorted(map(str, op(e.orderBy(F.desc("target"), F.rand(3))).collect()))


def test_one_task_clusters_as_its_steps_do(spark, monkeypatch):
    links = {tuple(sorted((g * 25 + i, (g if i % 7 else (g + 1) % 3) * 25 + (i * k) % 25))) for g in range(3) for i in range(25) for k in (2, 3)} | {(75, 75 + i) for i in range(1, 61)}
    n = nodes(spark, [(f"n{i:03}", "x", "code", "f.py") for i in range(140)])
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", float(1 + (a * b) % 3)) for a, b in sorted(links)], "source string, target string, weight double")
    calls, tables = [], C.local_moves
    monkeypatch.setattr(C, "SLICE", 50)
    monkeypatch.setattr(C, "local_moves", lambda *x: calls.append(1) or tables(*x))
    one = {r.node_id: r.cid for r in C.cluster(n, e).collect()}
    assert not calls and len(one) == 140  # hundreds of jobs before
    pairs = C.written(C.undirected_weights(e))
    found = C.written(C.partition(pairs))
    members = found.unionByName(n.select("id").join(found, "id", "left_anti").withColumn("community", F.col("id")))
    steps = C.split_loose(C.written(C.split_large(C.written(members), pairs)), pairs)
    assert {r.node_id: r.cid for r in C.total_order(C.written(steps)).collect()} == one and not calls


def test_one_task_partitions_as_tables_do(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"n{g}{i}", f"n{g}{j}", 1.0 + (i * j) % 3) for g in range(4) for i in range(6) for j in range(i)] + [(f"n{g}0", f"n{g + 1}1", 1.0) for g in range(3)], "a string, b string, weight double")
    one = {r.id: r.community for r in C.partition(pairs, refine=False).collect()}
    monkeypatch.setattr(C, "LEVEL", 0)
    assert {r.id: r.community for r in C.partition(pairs, refine=False).collect()} == one


def planted(spark, groups, size, inside, outside, seed):
    import random

    rng = random.Random(seed)
    links = {tuple(sorted((g * size + rng.randrange(size), g * size + rng.randrange(size)))) for g in range(groups) for _ in range(inside)} | {tuple(sorted((rng.randrange(groups * size), rng.randrange(groups * size)))) for _ in range(outside)}
    return spark.createDataFrame([(f"n{a:03}", f"n{b:03}", float(1 + (a * b) % 3)) for a, b in sorted(links)], "source string, target string, weight double")


def test_parts_in_files_partition_as_one_task_does(spark, monkeypatch):
    """Levels above LEVEL pairs, here all or all but the last ones, are moved in parts; no pairs are grouped in tables and no rounds are joins."""
    from graphloom.operators import partitions as P

    e = planted(spark, 12, 25, 90, 150, 4)
    e = e.union(e.where("weight = 3").select("target", "source", F.lit(1.0))).union(e.limit(0))
    one = {refine: {r.id: r.community for r in C.partition_edges(e, refine=refine).collect()} for refine in (True, False)}
    whole = {r.node_id: r.cid for r in C.cluster(e.select(F.col("source").alias("id")).union(spark.createDataFrame([("alone",)], "id string")).distinct(), e).collect()}
    calls = []
    for name in ("local_moves", "contract", "undirected_weights", "components"):
        monkeypatch.setattr(C, name, lambda *x: calls.append(1))
    monkeypatch.setattr(P, "LOAD", 600)
    monkeypatch.setattr(P, "HELD", 0)
    for least in (0, 60, 500):
        monkeypatch.setattr(C, "LEVEL", least)
        for refine in (True, False):
            assert {r.id: r.community for r in C.partition_edges(e, refine=refine).collect()} == one[refine] and not calls
    monkeypatch.setattr(C, "LEVEL", 60)
    n = e.select(F.col("source").alias("id")).union(spark.createDataFrame([("alone",)], "id string")).distinct()
    assert {r.node_id: r.cid for r in C.cluster(n, e).collect()} == whole and not calls


def test_parts_in_files_split_large_and_loose_communities(spark, monkeypatch):
    links = {tuple(sorted((g * 25 + i, (g if i % 7 else (g + 1) % 3) * 25 + (i * k) % 25))) for g in range(3) for i in range(25) for k in (2, 3)} | {(75, 75 + i) for i in range(1, 61)}
    n = nodes(spark, [(f"n{i:03}", "x", "code", "f.py") for i in range(140)])
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", float(1 + (a * b) % 3)) for a, b in sorted(links)], "source string, target string, weight double")
    one = {r.node_id: r.cid for r in C.cluster(n, e).collect()}
    for least in (0, 50):
        monkeypatch.setattr(C, "LEVEL", least)
        assert {r.node_id: r.cid for r in C.cluster(n, e).collect()} == one


def test_files_hold_null_and_empty_ids(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), (None, None), ("", "a"), ("é", "日本"), ("x", None)], "source string, target string")
    one = sorted((str(r.id), str(r.community)) for r in C.partition_edges(e).collect())
    monkeypatch.setattr(C, "LEVEL", 0)
    assert sorted((str(r.id), str(r.community)) for r in C.partition_edges(e).collect()) == one and len(one) == 8
