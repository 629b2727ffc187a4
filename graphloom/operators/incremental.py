"""Set operations on graphs and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .build import dedupe_nodes
from .joins import first_by, remap


def _edge_key(edges: DataFrame, directed: bool) -> DataFrame:
    a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    return edges.select(a.alias("a"), b.alias("b"), F.coalesce("relation", F.lit("")).alias("relation")).distinct()


def graph_diff(old: Graph, new: Graph) -> dict[str, DataFrame]:
    """Nodes and edges that are new or gone; edges by endpoints and relation."""
    o, n = old.nodes.select("id", "label"), new.nodes.select("id", "label")
    eo, en = _edge_key(old.edges, old.directed), _edge_key(new.edges, new.directed)
    return {"new_nodes": n.join(o, "id", "left_anti"), "removed_nodes": o.join(n, "id", "left_anti"), "new_edges": en.join(eo, ["a", "b", "relation"], "left_anti"), "removed_edges": eo.join(en, ["a", "b", "relation"], "left_anti")}


def diff_summary(counts: dict[str, int]) -> str:
    """One line about a diff."""
    words = [(counts[k], k.replace("_", " ")) for k in ("new_nodes", "new_edges", "removed_nodes", "removed_edges") if counts.get(k)]
    return ", ".join(f"{n} {w[:-1] if n == 1 else w}" for n, w in words) or "no changes"


def union_merge(a: Graph, b: Graph) -> Graph:
    """Nodes by id, b before a; edges and hyperedges one after the other."""
    later = lambda df: df.withColumn("_ord", F.col("_ord") + F.lit(10**17))
    hyper = [g.hyperedges for g in (a, b) if g.hyperedges is not None]
    return a.with_(
        nodes=dedupe_nodes(a.nodes.unionByName(later(b.nodes), allowMissingColumns=True)),
        edges=a.edges.unionByName(later(b.edges), allowMissingColumns=True),
        hyperedges=hyper[0].unionByName(hyper[1], allowMissingColumns=True) if len(hyper) == 2 else hyper[0] if hyper else None,
    )


def capped_merge(a: Graph, b: Graph, cap: int = 100_000) -> Graph:
    """A merge that refuses results of more than cap nodes."""
    out = union_merge(a, b)
    if out.nodes.limit(cap + 1).count() > cap:
        raise ValueError(f"the merged graph has more than {cap} nodes")
    return out


def with_prefix(graph: Graph, tag: str) -> Graph:
    """Ids as tag::id, with the repository and the local id kept."""
    p = lambda c: F.concat(F.lit(tag + "::"), F.col(c))
    nodes = graph.nodes.withColumn("local_id", F.col("id")).withColumn("repo", F.lit(tag)).withColumn("id", p("id"))
    hyper = graph.hyperedges
    if hyper is not None:
        hyper = hyper.withColumn("id", p("id")).withColumn("nodes", F.transform("nodes", lambda m: F.concat(F.lit(tag + "::"), m)))
    return graph.with_(nodes=nodes, edges=graph.edges.withColumn("source", p("source")).withColumn("target", p("target")), hyperedges=hyper)


def repo_tags(paths: list[str]) -> list[str]:
    """The shortest distinct trailing parts of some paths."""
    parts = [p.replace("\\", "/").strip("/").split("/") for p in paths]
    depth = 1
    while depth < max(map(len, parts), default=1) and len({tuple(p[-depth:]) for p in parts}) < len(parts):
        depth += 1
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        tag = "_".join(p[-depth:])
        seen[tag] = seen.get(tag, 0) + 1
        out.append(tag if seen[tag] == 1 else f"{tag}_{seen[tag]}")
    return out


def merge_repos(graphs: dict[str, Graph]) -> Graph:
    """Several repositories in one graph."""
    out = None
    for tag, g in graphs.items():
        out = with_prefix(g, tag) if out is None else union_merge(out, with_prefix(g, tag))
    return out


def merge_chunks(chunks: list[Graph]) -> Graph:
    """Extraction chunks; the first node of an id counts."""
    from .build import merge_extractions

    g = merge_extractions(chunks)
    return g.with_(nodes=first_by(g.nodes, ["id"], ["_ord"]))


def merge_cached(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached rows count before fresh ones of the same id."""
    both = cached.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return first_by(both, ["id"], ["_p", "_ord"]).drop("_p")


def prune_repo(graph: Graph, tag: str) -> Graph:
    """Without a repository's nodes and what hangs on them."""
    from .build import remove_nodes

    return remove_nodes(graph, graph.nodes.where(F.col("repo") == tag).select("id"))


def global_add(whole: Graph, part: Graph, tag: str) -> Graph:
    """Replaces a repository's nodes; external nodes of an existing label are merged into it."""
    fresh = with_prefix(part, tag)
    rest = prune_repo(whole, tag)
    external = F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("")) == ""
    known = rest.nodes.where(external).select("label", "id", "_ord").groupBy("label").agg(F.max_by("id", "_ord").alias("new"))
    mapping = fresh.nodes.where(external).join(known, "label").select(F.col("id").alias("old"), "new")
    nodes = fresh.nodes.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    edges = remap(remap(fresh.edges, "source", mapping), "target", mapping)
    return union_merge(rest, fresh.with_(nodes=nodes, edges=edges.select(fresh.edges.columns)))


def carried_hyperedges(old: DataFrame, live: DataFrame) -> DataFrame:
    """Hyperedges all of whose members are live (id)."""
    dead = old.select("id", F.explode("nodes").alias("_m")).join(live.select(F.col("id").alias("_m")).distinct(), "_m", "left_anti").select("id").distinct()
    return old.join(dead, "id", "left_anti").select(old.columns)


def without_sources(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is not listed; rows without a file stay."""
    return df.join(files.select("source_file").distinct(), "source_file", "left_anti").select(df.columns)


def upsert(old: Graph, new: Graph, deleted: DataFrame | None = None, allow_shrink: bool = False) -> Graph:
    """What the new extraction's files had is replaced, deleted files' rows go, hyperedges carry over.

    Refuses to end with fewer nodes than before, unless files were deleted or allow_shrink is set.
    """
    replaced = new.nodes.where("coalesce(source_file, '') <> ''").select("source_file").union(new.edges.where("coalesce(source_file, '') <> ''").select("source_file")).distinct()
    gone = replaced if deleted is None else replaced.union(deleted.select("source_file")).distinct()
    nodes = dedupe_nodes(without_sources(old.nodes, gone).unionByName(new.nodes.withColumn("_ord", F.col("_ord") + F.lit(10**17)), allowMissingColumns=True))
    ids = nodes.select(F.col("id").alias("_i"))
    edges = without_sources(old.edges, gone).unionByName(new.edges.withColumn("_ord", F.col("_ord") + F.lit(10**17)), allowMissingColumns=True)
    edges = edges.join(ids, F.col("source") == F.col("_i"), "left_semi").join(ids, F.col("target") == F.col("_i"), "left_semi")
    if deleted is None and not allow_shrink and nodes.count() < old.nodes.count():
        raise ValueError("the update would lose nodes")
    hyper = old.hyperedges
    if hyper is not None:
        kept = carried_hyperedges(hyper, nodes)
        hyper = kept if new.hyperedges is None else new.hyperedges.unionByName(kept.join(new.hyperedges.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return old.with_(nodes=nodes, edges=edges, hyperedges=hyper if hyper is not None else new.hyperedges)


def detect_changes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """U16: (path, state) of all paths: new, changed, same or deleted, by content hash."""
    m, f = manifest.select("path", F.col("ast_hash").alias("was")), files.select("path", F.col("ast_hash").alias("now"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def next_manifest(manifest: DataFrame, files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Fresh rows, and old ones neither rewritten nor deleted."""
    kept = manifest.join(files.select("path"), "path", "left_anti").join(deleted.select("path"), "path", "left_anti")
    return files.select(manifest.columns).unionByName(kept.select(manifest.columns))


def md5_of(content: Column) -> Column:
    """U18."""
    return F.md5(content)


def body_content(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---[ \t]*\r?\n?", "")


def content_hash(text: Column) -> Column:
    """Of the body, so that edits of the front matter change nothing."""
    return F.sha2(body_content(text), 256)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose hash the cache has, and those it lacks."""
    known = cache.select("hash").distinct()
    return files.join(known, "hash", "left_semi"), files.join(known, "hash", "left_anti")


def save_cache(rows: DataFrame, path: str) -> None:
    """One folder per hash prefix; a file's rows lie together."""
    rows.withColumn("bucket", F.substring("hash", 1, 2)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def prune_cache(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Cache rows of hashes still in use."""
    return cache.join(live.select("hash").distinct(), "hash", "left_semi").select(cache.columns)


def eviction(old_nodes: DataFrame, rebuilt: DataFrame, deleted: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose nodes go, and files whose edges go; a deleted file that is still there is not deleted."""
    really = deleted.select("source_file").join(on_disk.select("source_file"), "source_file", "left_anti").distinct()
    return really.union(rebuilt.select("source_file")).distinct(), really


def reconcile(old: Graph, fresh: Graph, rebuilt: DataFrame, deleted: DataFrame, on_disk: DataFrame, full: bool = False) -> Graph:
    """The prior graph with a fresh extraction; parsed rows of rebuilt files go, others survive."""
    _, really = eviction(old.nodes, rebuilt, deleted, on_disk)
    flag = lambda df, name: df.select("source_file").distinct().withColumn(name, F.lit(True))
    ast = F.coalesce(F.col("_origin") == "ast", F.lit(False))
    no_file = F.coalesce(F.col("source_file"), F.lit("")) == ""
    marked = lambda df: df.join(flag(really, "_gone"), "source_file", "left").join(flag(rebuilt, "_again"), "source_file", "left")
    kept = marked(old.nodes.join(fresh.nodes.select("id"), "id", "left_anti"))
    kept = kept.where(F.col("_gone").isNull() & ~(ast & (F.col("_again").isNotNull() | (F.lit(full) & no_file)))).select(old.nodes.columns)
    nodes = kept.unionByName(fresh.nodes, allowMissingColumns=True)
    live = nodes.select(F.col("id").alias("_i"))
    edges = marked(old.edges).where(F.col("_gone").isNull() & ~(ast & F.col("_again").isNotNull())).select(old.edges.columns)
    edges = edges.join(live, F.col("source") == F.col("_i"), "left_semi").join(live, F.col("target") == F.col("_i"), "left_semi").unionByName(fresh.edges, allowMissingColumns=True)
    return old.with_(nodes=nodes, edges=edges)


def shrink_losses(old_nodes: DataFrame, new_nodes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Nodes lost although their file was not rebuilt; an update is safe if there are none."""
    lost = old_nodes.join(new_nodes.select("id"), "id", "left_anti")
    return lost.join(rebuilt.select("source_file").distinct(), "source_file", "left_anti")


def topology(graph: Graph) -> DataFrame:
    """Counts and order-free hashes of nodes and edges, as one row."""
    h = lambda df, cols: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).cast("decimal(20,0)")), F.lit(0)).alias("h"))
    n, e = h(graph.nodes, ["id", "label", "source_file"]), h(graph.edges, ["source", "target", "relation", "confidence"])
    return n.select(F.col("n").alias("nodes"), F.col("h").alias("node_hash")).join(F.broadcast(e.select(F.col("n").alias("edges"), F.col("h").alias("edge_hash"))))


def unchanged(a: Graph, b: Graph) -> bool:
    """Z100."""
    return topology(a).first() == topology(b).first()
