"""The smaller operators."""

from pyspark.sql import functions as F

from graphloom.operators import helpers as H


def test_rows(spark):
    h = spark.createDataFrame([("h", ["a", "b", "z"])], "id string, nodes array<string>")
    c = spark.createDataFrame([(2, "a"), (1, "b"), (1, "c")], "cid long, node_id string")
    assert H.hyperedge_communities(h, c).first().communities == [1, 2]
    assert {r.label for r in H.placeholder_labels(c).collect()} == {"Community 1", "Community 2"}
    impact = spark.createDataFrame([(1, 5, [3]), (2, None, None)], "number long, nodes long, communities array<long>")
    assert {r.number: r.text for r in H.blast_radius(impact).collect()} == {1: "5 nodes in 1 community", 2: "no graph impact"}
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("x", 1, 1)], "model string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_rate double, output_rate double")
    assert {r.model: r.cost for r in H.estimated_cost(usage, rates).collect()} == {"m": 4.0, "x": 0.0}
    files = spark.createDataFrame([("a.md",), ("b.md",)], "source_file string")
    n = spark.createDataFrame([("a.md", "document", None), ("b.md", "document", "ast")], "source_file string, file_type string, _origin string")
    assert [r.source_file for r in H.without_semantic_documents(files, n).collect()] == ["b.md"]
    assert [r.source_file for r in H.uncovered(files, files.where("source_file = 'a.md'")).collect()] == ["b.md"]
    assert [r.source_file for r in H.rebase_paths(files, "/r/sub", "/r").orderBy("source_file").collect()] == ["sub/a.md", "sub/b.md"]
    assert H.lessons_fresh(spark.createDataFrame([(3.0,)], "mtime double"), 4.0) and not H.lessons_fresh(spark.createDataFrame([(5.0,)], "mtime double"), 4.0)


def test_texts(spark):
    t = spark.createDataFrame([("p", "x\nif seen_pairs.contains((source, target)) {\n" + "y" * 30)], "path string, text string")
    assert [(r.line) for r in H.suppression_sites(t).collect()] == [2]
    parts = H.expand_oversized(t, 40).orderBy("part").collect()
    assert "".join(r.text for r in parts) == t.first().text and all(len(r.text) <= 40 for r in parts)
    assert H.bisect("ab\ncd") == ("ab", "\ncd") or "".join(H.bisect("ab\ncd")) == "ab\ncd"
    assert H.common_root(["a/b/c.py", "a/b/d/e.py"]) == "a/b" and H.common_root([]) == ""
    assert [r[0] for r in spark.createDataFrame([(" ",), ("{}",), ("{1}",)], "v string").select(H.is_hollow(F.col("v"))).collect()] == [True, True, False]
    e = spark.createDataFrame([("a", "b")], "from string, to string")
    assert (H.normalize_edges(e).first().source, H.normalize_nodes(spark.createDataFrame([("i", "n")], "id string, name string")).first().label) == ("a", "n")


def test_lookups_and_names(spark):
    one = spark.createDataFrame([("n", 3, 2, ""), (" ", 4, 1, "x")], "name string, number long, members long, other string")
    got = one.select(H.display_community(F.col("name"), F.col("number")).alias("d"), H.community_header(F.col("name"), F.col("number")).alias("h")).collect()
    assert [(r.d, r.h) for r in got] == [("n", "Community 3 \u2014 n"), ("4", "Community 4")]
    lines = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, line string")
    lessons = spark.createDataFrame([("a", "preferred", False), ("b", "avoid", True)], "id string, standing string, stale boolean")
    assert {r.line for r in H.with_learning(lines, lessons).collect()} == {"A learning=preferred", "B learning=avoid:stale", "C"}
    m = spark.createDataFrame([("k", "f", "a.py", "L1"), ("k", "x", "a.py", "L9"), ("q", "y", "a.py", "L2"), ("q", "z", "b.py", "L1")], "key string, id string, source_file string, source_location string")
    assert sorted(r.id for r in H.prefer_file_node(m).collect()) == ["f", "y", "z"]
    assert sorted(r.source_file for r in H.chunk_sources(m).collect()) == ["a.py", "b.py"]
    assert H.merge_root(["/a", "/a"]) == "/a" and H.merge_root(["/a/b", "/a/c"]) == "/a" and H.merge_root(["/a", None]) is None and H.merge_root([]) is None
    assert H.resolves_under("x/../y", "/r") and not H.resolves_under("../y", "/r") and H.resolves_under(".", "/r") and not H.resolves_under("/root/y", "/r")
    n = spark.createDataFrame([("a", "A"), ("b", None), ("c", "A")], "id string, label string")
    assert sorted(r.name for r in H.known_nodes(n).collect()) == ["A", "a", "b", "c"]
    members = spark.createDataFrame([(1, "a"), (2, "b")], "cid long, node_id string")
    assert {(r.node_id, r.label) for r in H.node_community_labels(members, spark.createDataFrame([(1, "One")], "cid long, label string")).collect()} == {("a", "One"), ("b", "2")}
    calls = spark.createDataFrame([("a.py", [("f", 1), ("g", 2)]), ("b.py", [])], "source_file string, raw_calls array<struct<callee: string, line: int>>")
    assert [(r.source_file, r.callee, r.line) for r in H.flat_calls(calls).collect()] == [("a.py", "f", 1), ("a.py", "g", 2)]


def test_paths(spark):
    p = spark.createDataFrame([("docs/a/x.md", "../b/y.md#z"), ("docs/x.md", "/top/./y.md"), ("x.md", "../out.md"), ("x.md", "http://a/b"), ("x.md", "#here"), ("a/x.md", "y.md?q=1")], "source string, target string")
    assert [r[0] for r in p.select(H.resolve_link(F.col("source"), F.col("target"))).collect()] == ["docs/b/y.md", "top/y.md", None, None, None, "a/y.md"]
    f = spark.createDataFrame([("/r/src/A-b.py",), ("/other/x.py",), (None,)], "source_file string")
    assert [r[0] for r in f.select(H.source_key(F.col("source_file"))).collect()] == ["r_src_a_b", "other_x", ""]
    assert [r.source_file for r in H.relativise(f, "/r").collect()] == ["src/A-b.py", "/other/x.py", None]


def test_caches_and_fragments(spark, tmp_path):
    files = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three"), ("d", None)], "path string, text string")
    empty = spark.createDataFrame([], "hash string, words long")
    counts, cache = H.word_counts(files.where("path <> 'd'"), empty)
    assert {(r.path, r.words) for r in counts.collect()} == {("a", 2), ("b", 2), ("c", 1)} and cache.count() == 2
    told = cache.withColumn("words", F.col("words") + 10)
    assert {(r.path, r.words) for r in H.word_counts(files.where("path <> 'd'"), told)[0].collect()} == {("a", 12), ("b", 12), ("c", 11)}
    folder = f"file://{tmp_path}/cache"
    spark.createDataFrame([("a.py", "h"), ("a.py", "i")], "source_file string, hash string").write.parquet(folder)
    assert [r.source_file for r in H.cached_files(spark.read.parquet(folder)).collect()] == ["a.py"]
    H.clear_cache(spark, folder)
    H.clear_cache(spark, folder)
    assert not (tmp_path / "cache").exists()
    n = spark.createDataFrame([("a", "A", "code", "a.py"), ("b", "", "code", "a.py"), ("c", "C", "sound", "a.py"), ("d", "D", "code", "d.py")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("a", "d", "calls", "EXTRACTED", "a.py"), ("a", "c", "calls", "EXTRACTED", "a.py"), ("a", "d", "calls", "MAYBE", "a.py")], "source string, target string, relation string, confidence string, source_file string")
    good, kept, errors = H.load_fragment(n, e)
    assert sorted(r.id for r in good.collect()) == ["a", "d"] and kept.count() == 1 and errors.count() >= 3


def test_names_and_archetypes(spark):
    c = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, [])], "cid long, members array<string>")
    named = H.name_communities(c, lambda part: {cid: f"about {m[0]}" for cid, m in part if m}, batch=2)
    assert {(r.cid, r.label) for r in named.collect()} == {(1, "about a"), (2, "about b"), (3, "Community 3")}
    rows = [(1, "api_request", "api/x.py"), (1, "tree", "x.py"), (2, "tree", "y.py"), (3, "html", "a/html.py"), (3, "cache", "url.py"), (None, "test", "test.py")]
    n = spark.createDataFrame([(*r, "code", i, str(i)) for i, r in enumerate(rows)], "community long, label string, source_file string, file_type string, _ord long, id string")
    assert {(r.community, r.section) for r in H.community_archetypes(n).collect()} == {(1, "serve-api"), (2, "other"), (3, "ingest-cache-update")}
    told = spark.createDataFrame([(2, "Parser of calls")], "cid long, label string")
    assert {(r.community, r.section) for r in H.community_archetypes(n, told).collect()} >= {(2, "extract-pipeline")}
