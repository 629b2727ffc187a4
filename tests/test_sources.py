"""Sources, extraction, streams, exports and the query interface."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from graphloom.api import GraphQueries
from graphloom.functions import text as S
from graphloom.operators import filters as X
from graphloom.operators import rank as W
from graphloom.schema import Graph
from graphloom.sinks import export as K
from graphloom.sources import extract as XT
from graphloom.sources import files as FS
from graphloom.streaming import watch as ST

from .test_graph import edges, nodes


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_identifiers(spark):
    assert one(spark, "Foo--Bar__baz.QUX ", S.normalize_id) == "foo_bar_baz_qux"
    assert one(spark, "ﬁle Ünï", S.normalize_id) == "file_ünï"
    assert one(spark, "a/b.c/d.e.py", S.file_stem) == "a/b.c/d.e"
    assert one(spark, "C:\\x\\y", lambda c: S.norm_source_file(c, "C:/x")) == "y"
    assert one(spark, "a/../b/./c", S.posix_normpath) == "b/c"
    assert one(spark, 'say "hi"\n\x01', S.yaml_str) == 'say \\"hi\\"\\n\\x01'
    assert one(spark, "Crème Brûlée", lambda c: F.array_join(S.search_tokens(c), " ")) == "creme brulee"


def test_classifiers(spark):
    kinds = {"a.py": "code", "x.blade.php": "code", "POM.XML": "code", "d.md": "document", "p.pdf": "paper", "i.xcassets/p.pdf": None, "v.mp4": "video", "n": None, "s.PNG": "image"}
    got = spark.createDataFrame([(k,) for k in kinds], "p string").select("p", FS.classify_file(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in got} == kinds
    assert one(spark, "#!/usr/bin/env -S python3 -u\nx", FS.shebang_interpreter) == "python3"
    assert one(spark, "Abstract. We propose ... arXiv 2101.00001 [1]", FS.looks_like_paper)
    for path, secret in (("a/.env", True), ("k/id_rsa", True), ("src/main.py", False), ("x/.ssh/known", True)):
        assert one(spark, path, FS.is_sensitive) is secret
    for path, hit in (("build/x.o", True), ("src/keep.log", False), ("src/a.log", True), ("docs/deep/a/b.tmp", True), ("docs/b.tmp", True)):
        assert one(spark, path, lambda c: FS.is_ignored(c, ["build/", "*.log", "!keep.log", "docs/**/*.tmp", "# note"])) is hit
    assert FS.could_contain_included("src/lib", ["src/lib/*.py"]) and not FS.could_contain_included("docs", ["src/*.py"])
    for url, kind in (("https://arxiv.org/abs/1", "arxiv"), ("https://h.org/a.PDF?x", "pdf"), ("https://h.org/i.png", "image"), ("https://x.com/u", "tweet"), ("h", "webpage")):
        assert one(spark, url, FS.url_type) == kind
    assert X.validate_url("https://example.com/a") and not X.validate_url("http://127.0.0.1/") and not X.validate_url("ftp://example.com")


def test_html_and_office(spark, tmp_path):
    md = one(spark, "<h1>T</h1><script>bad()</script><p>a <b>b</b> <a href='/u'>l</a></p><ul><li>x</li></ul>", FS.html_to_markdown)
    assert md.startswith("# T") and "**b**" in md and "[l](/u)" in md and "* x" in md and "bad" not in md
    buffer = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    assert FS.docx_markdown(buffer.getvalue()) == "## Head\n\nBody" and FS.docx_markdown(b"junk") == ""
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.py").write_text("x = 1")
    found = FS.scan(spark, f"file://{tmp_path}")
    assert FS.office_text(found).first().text.startswith("## Head")
    assert {r.kind for r in FS.corpus(found).collect()} == {"code", "document"}


def test_model_answers(spark):
    assert json.loads(FS.salvage_json('Sure:\n```json\n{"a": [1]}\n```')) == {"a": [1]} and json.loads(FS.salvage_json('x {bad} {"b": 2} y')) == {"b": 2} and FS.salvage_json("none") is None
    chunks = spark.createDataFrame([(1, "ok"), (2, "long long\ntext")], "chunk_id long, text string")
    got = FS.extract_with_model(chunks, lambda t: '{"n": 1}' if len(t) < 11 else "cut").collect()
    assert sorted(r.chunk_id for r in got) == [1, 2, 2]


def test_work_sources(spark):
    raw = json.dumps([{"number": 3, "baseRefName": "main", "isDraft": False, "reviewDecision": "APPROVED", "updatedAt": "2024-01-01T00:00:00Z", "files": [{"path": "a.py"}], "statusCheckRollup": [{"conclusion": "SUCCESS"}, {"status": "QUEUED", "conclusion": ""}]}])
    pr = FS.pr_list(spark.createDataFrame([(raw,)], "json string")).first()
    assert (pr.number, pr.ci_status, pr.files_changed) == (3, "PENDING", ["a.py"])
    trees = FS.worktrees(spark.createDataFrame([("worktree /a\nHEAD 1\nbranch refs/heads/x\n\nworktree /b\nHEAD 2\ndetached\n",)], "text string")).collect()
    assert [(r.path, r.branch) for r in trees] == [("/a", "x"), ("/b", None)]
    note = '---\nquestion: "Why?"\ndate: 2024-01-02\noutcome: useful\nsource_nodes: ["a_b", "c"]\n---\nbody'
    m = FS.memory_documents(spark.createDataFrame([("n.md", note)], "path string, text string")).first()
    assert (m.question, m.outcome, m.source_nodes) == ("Why?", "useful", ["a_b", "c"])


def test_index_source(spark):
    doc = {"relative_path": "a.rs", "symbols": [{"symbol": "pkg/Foo#", "kind": "", "display_name": "Foo", "occurrences": [{"range": [4, 0]}], "relationships": [{"symbol": "pkg/Bar#", "is_implementation": True}, {"symbol": "std/Baz#", "is_reference": True}]}]}
    other = {"relative_path": "b.rs", "symbols": [{"symbol": "pkg/Bar#", "kind": "", "display_name": "", "occurrences": [], "relationships": []}]}
    shape = "relative_path string, symbols array<struct<symbol:string,kind:string,display_name:string,occurrences:array<struct<range:array<int>>>,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>>>"
    n, e = FS.scip_graph(spark.read.schema(shape).json(spark.sparkContext.parallelize([json.dumps(doc), json.dumps(other)])))
    assert n.count() == 3 and n.where("label = 'Foo'").first().source_location == "L5"
    assert {r.relation for r in e.collect()} == {"implements", "references"}


def test_extraction(spark):
    files = {
        "pkg/util.py": 'def helper():\n    """Help."""\n    return 1\n',
        "pkg/main.py": "from .util import helper\n\nclass App(Base):\n    def run(self):\n        helper()\n        self.x.go()\n",
        "web/a.ts": "import { b } from './b'\nexport class A extends B {\n  go() {}\n}\nexport function top() {\n  run()\n}\n",
        "db/s.sql": "CREATE TABLE orders (id int REFERENCES users(id)); -- FROM nope\nCREATE VIEW v AS SELECT * FROM orders JOIN users;",
        "docs/x.md": "# One\n\ntext [to](../pkg/main.py)\n\n## Two\n```\n# no\n```\n",
        "m.rs": "pub struct S;\nimpl T for S {}\npub fn f() {\n  g()\n}\n",
        "pyproject.toml": '[project]\nname = "demo"\ndependencies = ["numpy>=1", "pandas"]\n',
        "mcp.json": '{"mcpServers": {"s": {"command": "npx", "env": {"KEY": "secret"}}}}',
        "broken.py": "def (:\n",
        "data.json": '{"a": {"b": 1}}',
        "Cargo.toml": '[package]\nname = "c"\n[dependencies]\nserde = "1"\n',
        "noext": "#!/bin/bash\nf() {\n  g\n}\n",
    }
    r = XT.extract(spark.createDataFrame(list(files.items()), "path string, text string"))
    rows = r.collect()
    labels = {(x.source_file, x.label) for x in rows if x.kind == "node"}
    assert {("pkg/main.py", "App"), ("pkg/main.py", ".run()"), ("web/a.ts", "top()"), ("db/s.sql", "orders"), ("docs/x.md", "Two"), ("m.rs", "S"), ("noext", "f()"), ("data.json", "b")} <= labels
    relations = {(x.source_file, x.relation) for x in rows if x.kind == "edge"}
    assert {("pkg/main.py", "inherits"), ("pkg/util.py", "rationale_for"), ("db/s.sql", "references"), ("db/s.sql", "reads_from"), ("docs/x.md", "references"), ("pyproject.toml", "depends_on"), ("Cargo.toml", "depends_on"), ("mcp.json", "uses")} <= relations
    assert ("docs/x.md", "no") not in labels and not any("secret" in (x.label or "") for x in rows)
    assert [x.source_file for x in rows if x.kind == "error"] == ["broken.py"]
    g = XT.extracted_graph(r)
    calls = {(x.source, x.target, x.confidence) for x in g.edges.where("relation = 'calls'").collect()}
    assert calls == {("pkg_main_app_run", "pkg_util_helper", "EXTRACTED")}
    assert all(XT.language_of(f"x.{ext}") for exts, *_ in XT.LANGUAGES.values() for ext in exts.split())


def test_streams(spark, tmp_path):
    rows = [("a.py", "2024-01-01 00:00:00"), ("a.py", "2024-01-01 00:00:02"), ("a.py", "2024-01-01 00:00:09"), ("b.md", "2024-01-01 00:00:01"), ("b.md", "2024-01-01 00:00:01")]
    table = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{tmp_path}/in")
    assert sorted((r.path, r.changes) for r in ST.debounced(table).collect()) == [("a.py", 1), ("a.py", 2), ("b.md", 2)]
    stream = ST.changes(spark, f"{tmp_path}/in")
    q = ST.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bursts").count() == 3
    q = ST.first_seen(ST.changes(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 4
    store, told = ST.GraphStore(spark, f"{tmp_path}/store"), []
    extract = lambda files: Graph(files.select(F.col("source_file").alias("id"), F.col("source_file").alias("label"), "source_file", F.lit(1).cast("long").alias("_ord")), edges(spark, []))
    q = ST.watch(ST.changes(spark, f"{tmp_path}/in"), store, extract, f"{tmp_path}/cp", notify=lambda df: told.extend(r.source_file for r in df.collect()), available_now=True)
    q.awaitTermination()
    assert store.version() == 0 and [r.id for r in store.load().nodes.collect()] == ["a.py"] and told == ["b.md"]
    changed = spark.createDataFrame([("a.py",)], "source_file string")
    assert ST.rebuild(store, changed, extract) is None
    q = ST.per_path_counts(ST.changes(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.path: r.changes for r in spark.table("counts").collect()} == {"a.py": 3, "b.md": 2}


def small(spark):
    n = nodes(spark, [("a", "Alpha & Co", "code", "x.py", 1), ("b", "Beta", "code", "y.py", 1), ("c", "beta", "document", "z.md", 2)])
    return Graph(n, edges(spark, [("a", "b", "calls"), ("b", "c", "uses", "INFERRED"), ("c", "a", "references", "AMBIGUOUS")]))


def test_exports(spark, tmp_path):
    g = small(spark)
    K.to_json(g, f"{tmp_path}/g.json")
    back = FS.load_graph(spark, f"{tmp_path}/g.json")
    assert back.directed and back.nodes.count() == 3 and {r.confidence_score for r in back.edges.collect()} == {1.0, 0.5, 0.2}
    K.write_lines(K.graphml_lines(g), f"{tmp_path}/g.graphml")
    from xml.etree import ElementTree

    root = ElementTree.parse(f"{tmp_path}/g.graphml").getroot()
    assert len([x for x in root.iter() if x.tag.endswith("node")]) == 3
    assert K.cypher_lines(g).count() == 6 and K.neo4j_nodes(g).count() == 3 and "MERGE (a)-[:USES" in " ".join(r.line for r in K.cypher_lines(g).collect())
    assert sorted(r.name for r in K.note_names(g.nodes).collect()) == ["Alpha & Co", "Beta", "beta_1"]
    K.write_texts(K.obsidian_notes(g), f"file://{tmp_path}/vault")
    assert len(list((tmp_path / "vault").iterdir())) == 3 and "[[Beta]]" in (tmp_path / "vault" / "Alpha & Co.md").read_text()
    assert K.wiki_pages(g).count() == 2 and json.loads(K.canvas(g))["edges"] and "<svg" in K.to_svg(g) and "Alpha" in K.to_html(g)
    assert "Graph report" in K.report(g) and "flowchart" in K.callflow_html(g) and K.backup(f"{tmp_path}/g.json").endswith(".bak1") and K.backup(f"{tmp_path}/none") is None
    many, _, meta = K.view_rows(g, 2)
    assert meta and len(many) == 2
    assert K.token_reduction(g, ["alpha beta"])["reduction"] > 0
    K.save_memory(spark, f"{tmp_path}/mem", "q", "a", "useful", ["a"], "2024-01-01")
    assert spark.read.parquet(f"{tmp_path}/mem").count() == 1


def test_overlay_and_reports(spark):
    from graphloom.operators import aggregate as A

    g = small(spark)
    m = spark.createDataFrame([("q", "2024-01-01", "useful", ["a", "Beta"], 1), ("r", "2024-01-01", "useful", ["a"], 2)], "question string, date string, outcome string, source_nodes array<string>, _ord long")
    lessons = A.lessons(m, "2024-01-01")
    assert {r.id: r.status for r in K.learning_overlay(lessons, g.nodes).collect()} == {"a": "preferred", "b": "tentative"}
    assert "## Preferred" in K.lessons_markdown(lessons) and "raw edges: 3" in K.diagnostics_text(A.edge_diagnostics(g.edges, g.nodes))
    assert "<ul>" in K.tree_html(A.path_rollup(g.nodes))


def test_query_interface(spark):
    q = GraphQueries(small(spark))
    text = q.query_graph("Explain alpha", depth=2)
    assert "NODE Alpha & Co" in text and "EDGE Alpha & Co --calls" in text
    assert q.query_graph("zzzz") == "No matching nodes found." and "truncated" in q.query_graph("alpha beta", token_budget=25)
    assert "Degree: 2" in q.get_node("Beta") and q.get_neighbors("alpha").count() == 2 and q.get_node("qqq").startswith("No node")
    assert [r.id for r in q.shortest_path("alpha", "beta").collect()] and q.graph_stats().first().nodes == 3
    assert q.explain("alpha").count() == 2 and [r.id for r in q.affected("a").collect()] == ["c", "b"]
    assert q.questions().count() >= 1 and q.surprises().count() >= 0 and q.recluster().count() == 3


def test_budget_and_chunks(spark):
    units = spark.createDataFrame([(f"d/{i}", 40, False) for i in range(5)] + [("e/big", 500, False)], "path string, tokens long, is_image boolean")
    chunks = {r.path: r.chunk for r in W.pack_chunks(units, 100).collect()}
    assert chunks == {"d/0": 0, "d/1": 0, "d/2": 1, "d/3": 1, "d/4": 2, "e/big": 3}
    parts = W.slices("# a\n" + "x" * 50 + "\n# b\n" + "y" * 50, 60)
    assert parts[0] == (0, 55) and parts[-1][1] == 109


def test_page_links_once_for_a_url_of_several_rows(spark):
    rows = [("u", '<a href="x">'), ("u", "<a href='x'><a href=\"y\">"), ("v", '<aé href="z">'), ("w", '<a\x0bhref\x0b="q">'), ("n", None), (None, '<a href="x">')]
    got = FS.page_links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [("u", "x"), ("u", "y"), ("v", "z"), (None, "x")]))
