"""Graph construction (G01-G22) and conforming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, file_node_id, nfkc_casefold, normalize_id, normalize_id_ascii
from ..schema import FILE_TYPES, Graph
from .filters import BUILD_FAMILIES, language_family
from .joins import first_by, remap, unique_matches

# Other words for file types.
FILE_TYPE_SYNONYMS = {
    "markdown": "document", "text": "document", "doc": "document", "pdf": "paper", "method": "code", "function": "code", "class": "code",
    "module": "code", "file": "code", "script": "code", "idea": "concept", "entity": "concept", "term": "concept", "figure": "image", "diagram": "image",
}


def coerce_file_type(c: Column) -> Column:
    """A known type stays, a synonym is replaced, anything else becomes a concept."""
    v = F.lower(F.trim(c))
    out = F.when(v.isin(*FILE_TYPES), v)
    for word, kind in FILE_TYPE_SYNONYMS.items():
        out = out.when(v == word, kind)
    return out.otherwise("concept")


def canonicalise_nodes(nodes: DataFrame) -> DataFrame:
    """`source` stands in for a missing source_file; file types are coerced."""
    if "source" in nodes.columns:
        nodes = nodes.withColumn("source_file", F.coalesce("source_file", "source")).drop("source")
    return nodes.withColumn("file_type", coerce_file_type(F.col("file_type")))


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; the last attributes win, the first position stays."""
    w = Window.partitionBy("id")
    return nodes.withColumn("_first", F.min("_ord").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_ord")))).where("_rn = 1").withColumn("_ord", F.col("_first")).drop("_first", "_rn")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, relation)."""
    return first_by(edges, ["source", "target", "relation"], ["_ord"])


def _packed(edges: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in edges.columns])


def collapse_directed(edges: DataFrame) -> DataFrame:
    """G04, directed: one edge per (source, target), the one with the greatest (relation, _ord); the first position stays."""
    rows = edges.groupBy("source", "target").agg(F.max_by(_packed(edges), F.struct("relation", "_ord")).alias("e"), F.min(F.struct("relation", "_ord")).alias("f"))
    return rows.select("e.*", F.col("f._ord").alias("_first")).withColumn("_ord", F.col("_first")).drop("_first")


def collapse_undirected(edges: DataFrame) -> DataFrame:
    """G04, undirected: one edge per pair of nodes, by a closed form of insertion in (source, target, relation) order.

    All edges from the smaller to the greater node come first. Let r be the relation of the last of
    them. If an edge of the other direction has a relation other than r, the last one of that
    direction survives, else the last of the first direction does, as a reversed duplicate is dropped.
    A self-loop repeated with one relation counts as its own reverse: the first of the last relation
    survives. Source and target stay as first stored; _src and _tgt tell the surviving direction.
    """
    a, b = F.least("source", "target"), F.greatest("source", "target")
    sort = F.struct("relation", "_ord")
    forward = F.col("source") == F.col("_a")
    marked = edges.withColumn("_a", a).withColumn("_b", b)
    last = lambda cond: F.max_by(_packed(edges), F.when(cond, sort))
    rows = marked.groupBy("_a", "_b").agg(
        last(forward).alias("fwd"),
        last(~forward).alias("bwd"),
        F.min(F.when(~forward, F.col("relation"))).alias("bwd_first"),
        F.max_by(_packed(edges), F.when(F.col("source") == F.col("target"), F.struct(F.col("relation"), -F.col("_ord")))).alias("loop"),
    )
    # Relations of the other direction are all r if the least and the greatest are.
    differs = (F.col("bwd_first") != F.col("fwd.relation")) | (F.col("bwd.relation") != F.col("fwd.relation"))
    kept = F.when(F.col("_a") == F.col("_b"), F.col("loop")).when(F.col("fwd").isNull(), F.col("bwd")).when(F.col("bwd").isNotNull() & differs, F.col("bwd")).otherwise(F.col("fwd"))
    flat = rows.select("_a", "_b", kept.alias("e"), F.col("fwd").isNotNull().alias("has_fwd"))
    out = flat.select("e.*", F.when(F.col("has_fwd"), F.col("_a")).otherwise(F.col("_b")).alias("_s"), F.when(F.col("has_fwd"), F.col("_b")).otherwise(F.col("_a")).alias("_t"))
    out = out.withColumn("_src", F.col("source")).withColumn("_tgt", F.col("target")).withColumn("source", F.col("_s")).withColumn("target", F.col("_t"))
    return out.drop("_s", "_t")


def endpoint_index(nodes: DataFrame, aliases: DataFrame | None = None, ascii_ids: bool = False) -> DataFrame:
    """(key, id) from normalised ids and aliases; keys that mean several nodes are left out."""
    norm = normalize_id_ascii if ascii_ids else normalize_id
    keys = nodes.select(norm(F.col("id")).alias("key"), "id")
    if aliases is not None:
        keys = keys.unionByName(aliases.select(norm(F.col("alias")).alias("key"), "id"))
    return unique_matches(keys.distinct(), ["key"], "id")


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, ascii_ids: bool = False) -> DataFrame:
    """Endpoints by exact id, else by the normalised form; edges that stay unresolved are dropped."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    index = endpoint_index(nodes, aliases, ascii_ids).select(F.col("key").alias("_key"), F.col("id").alias("_by_key"))
    norm = normalize_id_ascii if ascii_ids else normalize_id
    out = edges
    for c in ("source", "target"):
        exact = out.join(ids, out[c] == ids["_id"], "left").withColumn("_n", norm(F.col(c)))
        both = exact.join(index, exact["_n"] == index["_key"], "left")
        out = both.withColumn(c, F.coalesce("_id", "_by_key")).where(F.col(c).isNotNull()).drop("_id", "_n", "_key", "_by_key")
    return out


def guard_languages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cross-language guard of G06: inferred calls need equal families, imports and references no known difference."""
    side = lambda end: nodes.select(F.col("id").alias(f"_{end}_id"), language_family(F.col("source_file"), BUILD_FAMILIES).alias(f"_{end}_family"), (F.coalesce(F.col("source_file"), F.lit("")).rlike(r"\.[^./]+$")).alias(f"_{end}_ext"))
    s, t = side("s"), side("t")
    j = edges.join(s, edges["source"] == s["_s_id"], "left").join(t, edges["target"] == t["_t_id"], "left")
    both_ext = F.coalesce(F.col("_s_ext") & F.col("_t_ext"), F.lit(False))
    same = F.col("_s_family").eqNullSafe(F.col("_t_family")) & F.col("_s_family").isNotNull()
    bad_call = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & both_ext & ~same
    bad_use = F.col("relation").isin("imports", "imports_from", "references") & F.coalesce(F.col("_s_family") != F.col("_t_family"), F.lit(False))
    return j.where(~(F.coalesce(bad_call, F.lit(False)) | F.coalesce(bad_use, F.lit(False)))).select(edges.columns)


def backfill_source_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A missing source_file of an edge is that of its source, else of its target."""
    side = lambda c: nodes.select(F.col("id").alias(f"_{c}"), F.nullif(F.col("source_file"), F.lit("")).alias(f"_{c}_file"))
    s, t = side("s"), side("t")
    j = edges.join(s, edges["source"] == s["_s"], "left").join(t, edges["target"] == t["_t"], "left")
    return j.withColumn("source_file", F.coalesce(F.nullif(F.col("source_file"), F.lit("")), "_s_file", "_t_file", F.lit(""))).select(edges.columns)


def conform_edges(edges: DataFrame, nodes: DataFrame, directed: bool = True, multi: bool = False) -> DataFrame:
    """Resolve, guard, fill in and collapse."""
    out = backfill_source_file(guard_languages(resolve_endpoints(edges, nodes), nodes), nodes)
    return out if multi else collapse_directed(out) if directed else collapse_undirected(out)


def ghost_remap(nodes: DataFrame) -> DataFrame:
    """(old, new) from model-made nodes to the parsed node of the same file name and label.

    A key counts if exactly one parsed node has it and the others come from one file at most.
    """
    keyed = nodes.withColumn("_k", basename(F.coalesce("source_file", F.lit("")))).withColumn("_l", F.lower(F.trim("label"))).where("_k <> '' and _l <> ''")
    ast = F.coalesce(F.col("_origin") == "ast", F.lit(False))
    keys = keyed.groupBy("_k", "_l").agg(
        F.sum(ast.cast("int")).alias("n_ast"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(~ast, F.col("source_file"))).alias("files"), F.max(F.when(ast, F.col("id"))).alias("new")
    ).where("n_ast = 1 and n > 1 and files <= 1")
    return keyed.where(~ast).join(keys, ["_k", "_l"]).select(F.col("id").alias("old"), "new").where("old <> new")


def apply_remap(graph: Graph, mapping: DataFrame) -> Graph:
    """Nodes that mapping replaces go, endpoints and members follow; only self-loops made by it are dropped."""
    gone = mapping.select(F.col("old").alias("id"))
    before = graph.edges.withColumn("_loop", F.col("source") == F.col("target"))
    after = remap(remap(before, "source", mapping), "target", mapping).where("_loop or source <> target").select(graph.edges.columns)
    hyper = graph.hyperedges
    if hyper is not None:
        members = remap(hyper.select("id", F.posexplode("nodes").alias("pos", "m")), "m", mapping)
        lists = members.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])).alias("nodes"))
        hyper = hyper.drop("nodes").join(lists, "id", "left").select(graph.hyperedges.columns)
    return graph.with_(nodes=graph.nodes.join(gone, "id", "left_anti"), edges=after, hyperedges=hyper)


def doc_twin_remap(nodes: DataFrame) -> DataFrame:
    """(old, new) from a bare id to its `_doc` twin in the same file."""
    bare = nodes.select(F.col("id").alias("old"), F.col("source_file").alias("_file"))
    twin = nodes.select(F.col("id").alias("new"), F.col("source_file").alias("_twin"), F.regexp_replace("id", "_doc$", "").alias("_bare")).where("new like '%\\\\_doc'")
    return bare.join(twin, (bare["old"] == twin["_bare"]) & bare["_file"].eqNullSafe(twin["_twin"])).select("old", "new")


def normalize_hyperedge_members(hyperedges: DataFrame) -> DataFrame:
    """Members under any of their names, each once."""
    names = [F.col(c) for c in ("nodes", "members", "node_ids") if c in hyperedges.columns]
    return hyperedges.withColumn("nodes", F.array_distinct(F.filter(F.coalesce(*names, F.array().cast("array<string>")), lambda m: m.isNotNull()))).drop("members", "node_ids")


def attach_hyperedges(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges with resolved, distinct, live members; the first of each id; none without members."""
    ids = endpoint_index(nodes).select(F.col("key").alias("_key"), F.col("id").alias("_by_key"))
    own = nodes.select(F.col("id").alias("_id")).distinct()
    first = first_by(normalize_hyperedge_members(hyperedges).withColumn("_o", F.monotonically_increasing_id()), ["id"], ["_o"]).drop("_o")
    rows = first.select("id", F.posexplode("nodes").alias("pos", "m"))
    rows = rows.join(own, rows["m"] == own["_id"], "left").withColumn("_n", normalize_id(F.col("m")))
    rows = rows.join(ids, rows["_n"] == ids["_key"], "left").withColumn("m", F.coalesce("_id", "_by_key")).where("m is not null")
    lists = rows.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])).alias("nodes"))
    return first.drop("nodes").join(lists, "id").select([c for c in first.columns])


def label_remap(nodes: DataFrame, norm: Column | None = None) -> DataFrame:
    """(old, new) to one node per label: no `_c<n>` suffix before one, then the shorter id, then the first."""
    norm = nfkc_casefold(F.trim("label")) if norm is None else norm
    rank = F.struct(F.col("id").rlike(r"_c\d+$").alias("s"), F.char_length("id").alias("n"), F.col("_ord"))
    keyed = nodes.withColumn("_norm", norm).where("_norm <> ''")
    winner = keyed.groupBy("_norm").agg(F.min_by("id", rank).alias("new"))
    return keyed.join(winner, "_norm").where("id <> new").select(F.col("id").alias("old"), "new")


def merge_extractions(parts: list[Graph]) -> Graph:
    """Concatenation, positions kept in order of the parts."""
    def stack(frames):
        out = None
        for i, f in enumerate(frames):
            f = f.withColumn("_ord", F.col("_ord") + F.lit(i * 10**15)) if "_ord" in f.columns else f
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    hyper = [p.hyperedges for p in parts if p.hyperedges is not None]
    return Graph(stack([p.nodes for p in parts]), stack([p.edges for p in parts]), stack(hyper) if hyper else None, parts[0].directed, parts[0].multi)


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the given nodes (column id), their edges and the hyperedges that name them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    edges = graph.edges.join(gone, F.col("source") == F.col("_gone"), "left_anti").join(gone, F.col("target") == F.col("_gone"), "left_anti")
    hyper = graph.hyperedges
    if hyper is not None:
        hit = hyper.select("id", F.explode("nodes").alias("m")).join(gone, F.col("m") == F.col("_gone"), "left_semi").select("id").distinct()
        hyper = hyper.join(hit, "id", "left_anti")
    return graph.with_(nodes=graph.nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti"), edges=edges, hyperedges=hyper)


def remove_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Without the edges between the given pairs (source, target)."""
    if graph.directed:
        return graph.with_(edges=graph.edges.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_anti").select(graph.edges.columns))
    key = lambda df: df.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    return graph.with_(edges=key(graph.edges).join(key(pairs).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").select(graph.edges.columns))


def relabel_nodes(graph: Graph, mapping: DataFrame) -> Graph:
    """G19."""
    return graph.with_(nodes=dedupe_nodes(remap(graph.nodes, "id", mapping)), edges=remap(remap(graph.edges, "source", mapping), "target", mapping).select(graph.edges.columns))


def edges_between(graph: Graph, u: str, v: str) -> DataFrame:
    """All parallel edges between two nodes, in order; G20 takes the first."""
    hit = (F.col("source") == u) & (F.col("target") == v)
    return graph.edges.where(hit if graph.directed else hit | ((F.col("source") == v) & (F.col("target") == u))).orderBy("_ord")


def semantic_rekey(nodes: DataFrame) -> DataFrame:
    """(old, new) that puts the id of a model-made node under its file's id; ambiguous new ids are left out."""
    file_id = file_node_id(F.col("source_file"))
    named = nodes.where("coalesce(_origin, '') <> 'ast' and coalesce(source_file, '') <> ''").select(F.col("id").alias("old"), file_id.alias("_f"), normalize_id(F.col("label")).alias("_l"))
    wanted = named.select("old", F.concat_ws("_", "_f", "_l").alias("new")).where("old <> new and not startswith(old, new)")
    return wanted.join(unique_matches(wanted, ["new"], "old").select("old"), "old")


def has_legacy_ids(nodes: DataFrame) -> bool:
    """Whether an id lacks its file's prefix."""
    return not nodes.where("_origin = 'ast' and coalesce(source_file, '') <> ''").where(~F.startswith(F.col("id"), file_node_id(F.col("source_file")))).limit(1).isEmpty()


def build_graph(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None, directed: bool = True, multi: bool = False) -> Graph:
    """Canonicalise, dedupe, merge twins and ghosts, conform edges, attach hyperedges."""
    n = dedupe_nodes(canonicalise_nodes(nodes))
    g = apply_remap(Graph(n, edges, hyperedges, directed, multi), doc_twin_remap(n))
    g = apply_remap(g, ghost_remap(g.nodes)) if "_origin" in n.columns else g
    return g.with_(edges=conform_edges(g.edges, g.nodes, directed, multi), hyperedges=attach_hyperedges(g.hyperedges, g.nodes) if g.hyperedges is not None else None)


def multigraph_probe(spark) -> dict[str, bool]:
    """Whether parallel edges keep their keys, attributes and direction through a round trip."""
    rows = [("a", "b", "calls", 1), ("a", "b", "uses", 2), ("b", "a", "calls", 3)]
    e = spark.createDataFrame(rows, "source string, target string, relation string, _ord long")
    return {
        "parallel_edges": e.where("source = 'a' and target = 'b'").count() == 2,
        "keyed_edges": e.select("source", "target", "relation").distinct().count() == 3,
        "directed": e.where("source = 'b'").count() == 1,
        "collapse": collapse_directed(e).count() == 2,
    }
