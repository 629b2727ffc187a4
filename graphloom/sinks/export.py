"""Exports (K01-K22): line formats as columns of text, documents as strings of bounded size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregate import degree_all
from ..schema import Graph

VIEW_LIMIT = 5000


def default_score(confidence: Column) -> Column:
    """The score of an edge that has none."""
    return F.when(confidence == "INFERRED", 0.5).when(confidence == "AMBIGUOUS", 0.2).otherwise(1.0)


def with_scores(edges: DataFrame) -> DataFrame:
    given = F.col("confidence_score") if "confidence_score" in edges.columns else F.lit(None).cast("double")
    return edges.withColumn("confidence_score", F.coalesce(given, default_score(F.col("confidence"))))


def node_community(communities: DataFrame) -> DataFrame:
    """(id, community)."""
    return communities.select(F.col("node_id").alias("id"), F.col("cid").alias("community")).dropDuplicates(["id"])


def export_norm_label(label: Column) -> Column:
    """Lower case without combining characters, which are not decomposed."""
    return F.lower(F.regexp_replace(label, r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]", ""))


def restore_direction(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source and target as _src and _tgt say, if these still exist."""
    out = edges
    for own, true in (("source", "_src"), ("target", "_tgt")):
        if true in edges.columns:
            ids = nodes.select(F.col("id").alias("_live"))
            out = out.join(ids, out[true] == ids["_live"], "left").withColumn(own, F.coalesce("_live", own)).drop("_live")
    return out


def node_link(graph: Graph, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and link tables as they are written."""
    nodes = graph.nodes.withColumn("norm_label", export_norm_label(F.col("label")))
    if communities is not None:
        nodes = nodes.drop("community").join(node_community(communities), "id", "left")
    return nodes, restore_direction(with_scores(graph.edges), graph.nodes)


def write_node_link(graph: Graph, path: str, communities: DataFrame | None = None) -> None:
    """JSON lines of nodes and links in two folders, in parallel. read_node_link and to_json read and join them."""
    nodes, links = node_link(graph, communities)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def to_json(graph: Graph, path: str, communities: DataFrame | None = None, cap: int = 512 << 20) -> None:
    """One node-link file, streamed row by row; stops at the size cap."""
    nodes, links = node_link(graph, communities)
    with open(path, "w") as f:
        f.write(json.dumps({"directed": graph.directed, "multigraph": graph.multi, "graph": {}})[:-1])
        for name, df in (("nodes", nodes.orderBy("_ord")), ("links", links.orderBy("_ord"))):
            f.write(f', "{name}": [')
            for i, row in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
                f.write((", " if i else "") + row.j)
                if f.tell() > cap:
                    raise ValueError(f"more than {cap} bytes")
            f.write("]")
        f.write("}")


def xml_escape(c: Column) -> Column:
    from ..functions.text import escape_html

    return escape_html(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def graphml_lines(graph: Graph) -> DataFrame:
    """(section, _ord, line) of a GraphML file; every attribute has a typed key."""
    kinds = {"string": "string", "double": "double", "bigint": "long", "int": "int", "boolean": "boolean"}
    spark = graph.nodes.sparkSession

    def section(df: DataFrame, domain: str, skip: set[str], opening: Column, closing: str):
        keys = [(c, t) for c, t in df.dtypes if c not in skip and t in kinds]
        data = F.concat(*[F.coalesce(F.concat(F.lit(f'<data key="{domain[0]}_{c}">'), xml_escape(F.col(c).cast("string")), F.lit("</data>")), F.lit("")) for c, _ in keys], F.lit(""))
        head = [f'<key id="{domain[0]}_{c}" for="{domain}" attr.name="{c}" attr.type="{kinds[t]}"/>' for c, t in keys]
        return head, df.select(F.lit(2 if domain == "node" else 3).alias("section"), "_ord", F.concat(opening, data, F.lit(closing)).alias("line"))

    n_head, n = section(graph.nodes, "node", {"id", "_ord"}, F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">')), "</node>")
    e_head, e = section(graph.edges, "edge", {"source", "target", "_ord"}, F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">')), "</edge>")
    frame = [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">')]
    frame += [(1, i, k) for i, k in enumerate([*n_head, *e_head, f'<graph edgedefault="{"directed" if graph.directed else "undirected"}">'])] + [(4, 0, "</graph>"), (4, 1, "</graphml>")]
    return n.unionByName(e).unionByName(spark.createDataFrame(frame, "section int, _ord long, line string"))


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "_ord")) -> None:
    """One text file of lines in order, streamed through the driver partition by partition."""
    with open(path, "w") as f:
        for row in lines.orderBy(*order).select("line").toLocalIterator():
            f.write(row.line + "\n")


def cypher_label(c: Column) -> Column:
    """A label or relation as an identifier."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_]", "_"), r"^(?=[0-9])", "_")
    return F.when(name == "", "Entity").otherwise(name)


def cypher_string(c: Column) -> Column:
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.regexp_replace(out, r"[\r\n]+", " "), F.lit("'"))


def cypher_lines(graph: Graph) -> DataFrame:
    """MERGE statements of nodes, then of edges."""
    n = graph.nodes.select(F.lit(0).alias("section"), "_ord", F.concat(F.lit("MERGE (n:"), cypher_label(F.initcap("file_type")), F.lit(" {id: "), cypher_string(F.col("id")), F.lit("}) SET n.label = "), cypher_string(F.col("label")), F.lit(", n.source_file = "), cypher_string(F.col("source_file")), F.lit(";")).alias("line"))
    e = graph.edges.select(F.lit(1).alias("section"), "_ord", F.concat(F.lit("MATCH (a {id: "), cypher_string(F.col("source")), F.lit("}), (b {id: "), cypher_string(F.col("target")), F.lit("}) MERGE (a)-[:"), cypher_label(F.upper("relation")), F.lit(" {confidence: "), cypher_string(F.col("confidence")), F.lit("}]->(b);")).alias("line"))
    return n.unionByName(e)


def neo4j_nodes(graph: Graph, communities: DataFrame | None = None) -> DataFrame:
    """(label, id, properties as JSON)."""
    nodes, _ = node_link(graph, communities)
    return nodes.select(cypher_label(F.initcap("file_type")).alias("label"), "id", F.to_json(F.struct(*[c for c in nodes.columns if c not in ("id", "_ord")])).alias("properties"))


def neo4j_edges(graph: Graph) -> DataFrame:
    """K05."""
    e = with_scores(graph.edges)
    return e.select(cypher_label(F.upper("relation")).alias("type"), "source", "target", F.to_json(F.struct(*[c for c in e.columns if c not in ("source", "target", "_ord")])).alias("properties"))


def push(rows: DataFrame, connect, statement: str, batch: int = 500) -> None:
    """Sends rows in batches through a client that `connect` makes in every task."""

    def send(part):
        client, held = connect(), []
        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) == batch:
                client.run(statement, held)
                held = []
        if held:
            client.run(statement, held)

    rows.foreachPartition(send)


def view_rows(graph: Graph, limit: int = VIEW_LIMIT) -> tuple[list, list, bool]:
    """The rows a picture shows: the graph, or that of its communities if it has more than limit nodes; of very many edges the first ones."""
    if graph.nodes.limit(limit + 1).count() <= limit:
        n = graph.nodes.select("id", "label", F.coalesce("community", F.lit(-1)).alias("community")).orderBy("_ord").collect()
        return n, graph.edges.orderBy("_ord", "source", "target", "relation").select("source", "target", "relation").limit(limit * 10).collect(), False
    from ..operators.aggregate import meta_graph
    from ..operators.communities import communities_of

    c = communities_of(graph.nodes)
    n = c.groupBy("cid").count().orderBy(F.desc("count"), "cid").limit(limit).select(F.concat(F.lit("c"), "cid").alias("id"), F.concat(F.lit("Community "), "cid", F.lit(" ("), "count", F.lit(")")).alias("label"), F.col("cid").alias("community")).collect()
    e = meta_graph(graph.edges, c).orderBy(F.desc("edges"), "cu", "cv").limit(limit * 10).select(F.concat(F.lit("c"), "cu").alias("source"), F.concat(F.lit("c"), "cv").alias("target"), F.col("edges").cast("string").alias("relation")).collect()
    return n, e, True


def to_svg(graph: Graph, limit: int = 500, size: int = 900) -> str:
    """A drawing of the graph or of its communities."""
    from html import escape

    from ..operators.traverse import spring_layout

    spark = graph.nodes.sparkSession
    n, e, _ = view_rows(graph, limit)
    pairs = spark.createDataFrame([(r.source, r.target) for r in e] or [("", "")], "source string, target string")
    at = spring_layout(pairs, limit)
    xs = [p for p in at.values()] or [(0.0, 0.0)]
    low = [min(p[i] for p in xs) for i in (0, 1)]
    wide = [max(max(p[i] for p in xs) - low[i], 1e-9) for i in (0, 1)]
    place = lambda x: tuple(20 + (at[x][i] - low[i]) / wide[i] * (size - 40) for i in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">']
    out += [f'<line x1="{place(r.source)[0]:.1f}" y1="{place(r.source)[1]:.1f}" x2="{place(r.target)[0]:.1f}" y2="{place(r.target)[1]:.1f}" stroke="#999"/>' for r in e if r.source in at and r.target in at]
    out += [f'<circle cx="{place(r.id)[0]:.1f}" cy="{place(r.id)[1]:.1f}" r="5" fill="hsl({(r.community * 47) % 360},60%,50%)"><title>{escape(r.label or r.id)}</title></circle>' for r in n if r.id in at]
    return "\n".join([*out, "</svg>"])


def to_html(graph: Graph, title: str = "graph", limit: int = VIEW_LIMIT) -> str:
    """A page with the data and a list that can be searched."""
    from html import escape

    n, e, meta = view_rows(graph, limit)
    data = json.dumps({"nodes": [r.asDict() for r in n], "edges": [r.asDict() for r in e], "communities_only": meta}).replace("</", "<\\/")
    script = "const D=JSON.parse(document.getElementById('data').textContent),q=document.getElementById('q'),o=document.getElementById('o');function show(){const t=q.value.toLowerCase();o.textContent=D.nodes.filter(n=>(n.label||n.id).toLowerCase().includes(t)).slice(0,200).map(n=>(n.label||n.id)+' ['+n.community+']').join('\\n')}q.oninput=show;show()"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><input id="q" placeholder="search"><pre id="o"></pre><script id="data" type="application/json">{data}</script><script>{script}</script></body></html>'


def obsidian_tag(c: Column) -> Column:
    """Z61."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9/_-]+", "-"), r"^-+|-+$", "")


def note_names(nodes: DataFrame) -> DataFrame:
    """(id, name): file names from labels, numbered where they would meet."""
    safe = F.substring(F.trim(F.regexp_replace(F.coalesce("label", "id"), r'[\\/:*?"<>|#^\[\]\r\n]+', "_")), 1, 120)
    n = nodes.select("id", "_ord", F.when(safe == "", "_").otherwise(safe).alias("base"))
    rank = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("_ord", "id"))
    return n.withColumn("_n", rank).select("id", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("_n") - 1)).alias("name"))


def obsidian_notes(graph: Graph) -> DataFrame:
    """(path, text): a note per node with links to its neighbours."""
    names = note_names(graph.nodes)
    other = names.select(F.col("id").alias("target"), F.col("name").alias("to"))
    links = graph.edges.join(other, "target").groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.concat(F.lit("- "), "relation", F.lit(": [["), "to", F.lit("]]")))), lambda x: x), "\n").alias("links"))
    j = graph.nodes.join(names, "id").join(links, "id", "left")
    front = F.concat(F.lit("---\nid: "), "id", F.lit("\nsource: "), F.coalesce("source_file", F.lit("")), F.lit("\ntags: ["), obsidian_tag(F.coalesce("file_type", F.lit("concept"))), F.lit("]\n---\n\n# "), F.coalesce("label", "id"), F.lit("\n\n"))
    return j.select(F.concat("name", F.lit(".md")).alias("path"), F.concat(front, F.coalesce("links", F.lit(""))).alias("text"))


def canvas(graph: Graph, limit: int = 500) -> str:
    """A canvas of cards on a grid, with arrows."""
    n, e, _ = view_rows(graph, limit)
    ids = {r.id for r in n}
    cards = [{"id": r.id, "type": "text", "text": r.label or r.id, "x": i % 20 * 300, "y": i // 20 * 160, "width": 260, "height": 100} for i, r in enumerate(n)]
    arrows = [{"id": f"e{i}", "fromNode": r.source, "toNode": r.target, "label": r.relation} for i, r in enumerate(e) if r.source in ids and r.target in ids]
    return json.dumps({"nodes": cards, "edges": arrows})


def wiki_pages(graph: Graph, top: int = 20) -> DataFrame:
    """(path, text): a page per community with its best connected nodes."""
    j = graph.nodes.where("community is not null").join(degree_all(graph.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    ranked = j.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("community"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    lines = ranked.groupBy("community", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label", "degree"))), lambda s: F.concat(F.lit("- "), s["label"], F.lit(" ("), s["degree"], F.lit(")"))), "\n").alias("body"))
    return lines.select(F.concat(F.lit("community_"), "community", F.lit(".md")).alias("path"), F.concat(F.lit("# Community "), "community", F.lit("\n\n"), "_n", F.lit(" nodes\n\n"), "body").alias("text"))


def write_texts(texts: DataFrame, folder: str) -> None:
    """Writes (path, text) rows as files in a store all tasks share."""

    def send(part):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in part:
            with store.open_output_stream(f"{base}/{row.path}") as f:
                f.write(row.text.encode())

    texts.foreachPartition(send)


def report(graph: Graph, top: int = 10) -> str:
    """An overview in markdown, from aggregates of bounded size."""
    from ..operators.aggregate import confidence_stats, thin_communities
    from ..operators.communities import communities_of
    from ..operators.rank import god_nodes, surprising_connections

    stats = confidence_stats(graph.edges).first()
    c = communities_of(graph.nodes)
    out = ["# Graph report", "", f"{graph.nodes.count()} nodes, {stats.edges} edges, {c.select('cid').distinct().count()} communities ({thin_communities(c).count()} thin)", ""]
    out += [f"Edges: {stats.extracted_pct}% extracted, {stats.inferred_pct}% inferred, {stats.ambiguous_pct}% ambiguous", "", "## Most connected", ""]
    out += [f"{i}. {r.label} - {r.degree} edges" for i, r in enumerate(god_nodes(graph.nodes, graph.edges, top).collect(), 1)]
    out += ["", "## Surprising connections", ""] + [f"- {r.u} --{r.relation}--> {r.v} [{r.confidence}]" for r in surprising_connections(graph.nodes, graph.edges).collect()]
    return "\n".join(out)


def callflow_sections(graph: Graph, per_section: int = 12) -> DataFrame:
    """The best edges within and between communities, by score."""
    from ..operators.filters import callflow_edges

    side = lambda p: graph.nodes.select(F.col("id").alias(p), F.col("community").alias(f"{p}_c"), F.col("label").alias(f"{p}_label"))
    score = F.when(F.col("relation").isin("calls", "indirect_call"), 3).when(F.col("relation").isin("imports", "imports_from"), 2).otherwise(1) + F.when(F.col("confidence") == "EXTRACTED", 1).otherwise(0)
    e = callflow_edges(graph.edges).join(side("source"), "source").join(side("target"), "target").withColumn("score", score).withColumn("inside", F.col("source_c").eqNullSafe(F.col("target_c")))
    w = Window.partitionBy("source_c", "inside").orderBy(F.desc("score"), "_ord")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_section).select("source_c", "inside", "source_label", "target_label", "relation", "score", "rank")


def mermaid(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'["\[\]{}()|<>]', " "), r"\s+", " ")


def callflow_html(graph: Graph, sections: int = 12) -> str:
    """Diagrams of the first communities."""
    from html import escape

    rows = callflow_sections(graph).where(F.col("inside") & (F.col("source_c") < sections)).select("source_c", mermaid(F.col("source_label")).alias("a"), mermaid(F.col("target_label")).alias("b"), "relation").orderBy("source_c", "rank").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.source_c, []).append(f'  "{r.a}" -->|{r.relation}| "{r.b}"')
    return "<!DOCTYPE html><html><body>" + "".join(f"<h2>Community {c}</h2><pre class='mermaid'>flowchart LR\n{escape(chr(10).join(v))}</pre>" for c, v in by.items()) + "</body></html>"


def tree_html(rollup: DataFrame, limit: int = VIEW_LIMIT) -> str:
    """Folders with their counts as a nested list."""
    from html import escape

    rows = {r.path: r.nodes for r in rollup.orderBy("path").limit(limit).collect()}
    below = lambda p: sorted(k for k in rows if k.rpartition("/")[0] == p and k != p)
    draw = lambda p: f"<li>{escape(p.rpartition('/')[2])} ({rows[p]})" + (f"<ul>{''.join(map(draw, below(p)))}</ul>" if below(p) else "") + "</li>"
    return f"<!DOCTYPE html><html><body><ul>{''.join(draw(p) for p in rows if '/' not in p)}</ul></body></html>"


def lessons_markdown(lessons: DataFrame, limit: int = 50) -> str:
    """What past sessions found, by standing."""
    out = ["# Lessons", ""]
    for standing in ("preferred", "tentative", "contested", "avoid"):
        rows = lessons.where(F.col("standing") == standing).orderBy(F.desc("score"), "node").limit(limit).collect()
        out += [f"## {standing.capitalize()}", "", *[f"- {r.node} (score {r.score}, {r.positive} for, {r.negative} against)" for r in rows], ""] if rows else []
    return "\n".join(out)


def learning_overlay(lessons: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per node id (or its only label) its standing, and whether its file has changed since (path, was, now)."""
    by_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_by_label")).where("_n = 1").drop("_n")
    ids = nodes.select(F.col("id").alias("_id"))
    j = lessons.join(ids, lessons["node"] == ids["_id"], "left").join(by_label, lessons["node"] == by_label["label"], "left").withColumn("id", F.coalesce("_id", "_by_label")).where("id is not null")
    rank = F.when(F.col("standing") == "contested", 0).when(F.col("standing") == "preferred", 1).when(F.col("standing") == "tentative", 2).otherwise(3)
    one = j.groupBy("id").agg(F.min_by(F.struct("standing", "score"), F.struct(rank, F.col("node"))).alias("s")).select("id", F.col("s.standing").alias("status"), F.col("s.score").alias("score"))
    if files is None:
        return one.withColumn("stale", F.lit(False))
    f = nodes.select("id", F.col("source_file").alias("path")).join(files, "path")
    return one.join(f.select("id", (F.col("was") != F.col("now")).alias("_stale")), "id", "left").select("id", "status", "score", F.coalesce("_stale", F.lit(False)).alias("stale"))


def save_memory(spark: SparkSession, folder: str, question: str, answer: str, outcome: str, source_nodes: list[str], date: str, correction: str | None = None) -> None:
    """Appends a question-and-answer note."""
    from ..schema import OUTCOMES

    if outcome not in OUTCOMES:
        raise ValueError(f"outcome must be one of {OUTCOMES}")
    row = [(question, answer, outcome, correction, source_nodes, date)]
    spark.createDataFrame(row, "question string, answer string, outcome string, correction string, source_nodes array<string>, date string").coalesce(1).write.mode("append").parquet(folder)


def backup(path: str) -> str | None:
    """Copies a file or folder aside before it is overwritten."""
    import os
    import shutil

    if not os.path.exists(path):
        return None
    n = 1
    while os.path.exists(f"{path}.bak{n}"):
        n += 1
    (shutil.copytree if os.path.isdir(path) else shutil.copy2)(path, f"{path}.bak{n}")
    return f"{path}.bak{n}"


def diagnostics_text(diagnostics: DataFrame) -> str:
    """K20."""
    return "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in diagnostics.first().asDict().items())


def prs_text(prs: DataFrame, limit: int = 100) -> str:
    """PRs (number, status, title, nodes) by urgency."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("ci_failing", "changes_requested", "wrong_base", "pending", "stale", "ready", "approved", "draft")]), F.col("status"))
    return "\n".join(f"#{r.number} [{r.status}] {r.title or ''} - touches {r.nodes or 0} nodes" for r in prs.orderBy(rank, "number").limit(limit).collect())


def token_reduction(graph: Graph, questions: list[str], words: int | None = None, depth: int = 3) -> dict:
    """Tokens of the whole corpus against those of the questions' neighbourhoods."""
    from ..functions.text import query_terms
    from ..operators.rank import node_lines, pick_seeds, score_nodes, with_norm_label
    from ..operators.traverse import both_ways

    nodes = with_norm_label(graph.nodes)
    corpus = (words or graph.nodes.count() * 50) * 100 // 75
    arcs = both_ways(graph.edges)
    costs = []
    for q in questions:
        ids = pick_seeds(score_nodes(nodes, query_terms(q)), 3).select("id")
        for _ in range(depth):
            ids = ids.union(arcs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))).distinct()
        size = graph.nodes.join(ids, "id", "left_semi").agg(F.coalesce(F.sum(F.octet_length(node_lines(graph.nodes)) + 1), F.lit(0))).first()[0]
        if size:
            costs.append(size // 4)
    mean = sum(costs) / len(costs) if costs else 0
    return {"corpus_tokens": corpus, "avg_query_tokens": mean, "reduction": round(corpus / mean, 1) if mean else 0.0}
