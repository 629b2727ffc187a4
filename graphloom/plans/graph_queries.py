"""Queries on graph construction, aggregation, set operations and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import build as B
from ..operators import communities as C
from ..operators import filters as X
from ..operators import incremental as U
from ..operators import rank as W
from ..schema import Graph
from ..sources.tables import GRAPH_SQL, edges, graph, nodes, table
from .catalog import query

NOT_STUB = """NOT (label <> '' AND ((source_file <> '' AND label = split_part(source_file, '/', -1)) OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1)))"""
NOT_CONCEPT = """NOT (source_file = '' OR NOT contains(split_part(source_file, '/', -1), '.'))"""
DEGREE_ALL = """deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) GROUP BY id)"""
DEGREE_TWICE = """deg2 AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"""


def members(spark, d):
    """Nations as communities: the nodes that carry a nation's number."""
    return C.communities_of(nodes(spark, d))


@query("god_nodes", f"{DEGREE_ALL} SELECT id, label, CAST(degree AS BIGINT) AS degree FROM (SELECT n.*, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id)) WHERE {NOT_STUB} AND {NOT_CONCEPT} ORDER BY degree DESC, _ord LIMIT 10")
def god_nodes(spark, d):
    return W.god_nodes(nodes(spark, d), edges(spark, d), 10)


@query("degree_all", f"{DEGREE_ALL} SELECT n.id, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM nodes n LEFT JOIN deg USING (id)")
def degree_all(spark, d):
    return A.degree_all(edges(spark, d), nodes(spark, d))


@query("degree_endpoint", f"{DEGREE_TWICE} SELECT n.id, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM nodes n LEFT JOIN deg2 USING (id)")
def degree_endpoint(spark, d):
    return A.degree_endpoints(edges(spark, d), nodes(spark, d))


RANKED = f"{DEGREE_ALL}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM (SELECT coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id)))"


@query("hub_threshold", f"{RANKED} SELECT CAST(greatest(50, max(degree)) AS BIGINT) AS threshold FROM r WHERE i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)")
def hub_threshold(spark, d):
    return A.hub_threshold(A.degree_all(edges(spark, d), nodes(spark, d)))


@query("hub_nodes", f"{RANKED}, t AS (SELECT max(degree) AS threshold FROM r WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) SELECT id, CAST(degree AS BIGINT) AS degree FROM deg, t WHERE degree > threshold")
def hub_nodes(spark, d):
    return A.hub_nodes(A.degree_all(edges(spark, d), nodes(spark, d)), 95)


@query("edge_collapse_directed", "SELECT source, target, relation, confidence, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY relation DESC, _ord DESC) AS rn FROM edges) WHERE rn = 1")
def edge_collapse_directed(spark, d):
    return B.collapse_directed(edges(spark, d)).select("source", "target", "relation", "confidence", "weight")


def _mixed(spark, d):
    """Edges in both directions with several relations: lines as stored, and each order's return flags turned round."""
    e = edges(spark, d)
    lines = e.where("relation = 'contains'")
    turned = lines.select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("confidence") == "AMBIGUOUS", "returns").otherwise("contains").alias("relation"), "confidence", "weight", "context", "source_file", (F.col("_ord") + 10**16).alias("_ord"))
    return e.unionByName(turned)


@query(
    "edge_collapse_undirected",
    """mixed AS (SELECT * FROM edges UNION ALL SELECT target, source, CASE WHEN confidence = 'AMBIGUOUS' THEN 'returns' ELSE 'contains' END, confidence, weight, context, source_file, _ord + 10000000000000000 FROM edges WHERE relation = 'contains'),
    k AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b, source = least(source, target) AS fwd FROM mixed),
    s AS (SELECT a, b, arg_max(relation, (relation, _ord)) FILTER (fwd) AS fr, arg_max(_ord, (relation, _ord)) FILTER (fwd) AS fo, arg_max(relation, (relation, _ord)) FILTER (NOT fwd) AS br, arg_max(_ord, (relation, _ord)) FILTER (NOT fwd) AS bo FROM k GROUP BY a, b),
    x AS (SELECT a, b, count(*) AS other FROM k JOIN s USING (a, b) WHERE NOT fwd AND relation <> fr GROUP BY a, b),
    w AS (SELECT s.a, s.b, CASE WHEN fo IS NULL THEN bo WHEN bo IS NOT NULL AND other > 0 THEN bo ELSE fo END AS _ord, fo IS NOT NULL AS has_fwd FROM s LEFT JOIN x USING (a, b))
    SELECT CASE WHEN has_fwd THEN a ELSE b END AS source, CASE WHEN has_fwd THEN b ELSE a END AS target, k.source AS _src, k.target AS _tgt, relation, confidence, weight FROM w JOIN k USING (a, b, _ord)""",
)
def edge_collapse_undirected(spark, d):
    return B.collapse_undirected(_mixed(spark, d)).select("source", "target", "_src", "_tgt", "relation", "confidence", "weight")


@query("edge_dedupe", "SELECT source, target, relation, confidence, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY _ord) AS rn FROM edges) WHERE rn = 1")
def edge_dedupe(spark, d):
    return B.dedupe_edges(edges(spark, d)).select("source", "target", "relation", "confidence", "weight")


def _renamed_parts(spark, d):
    p = table(spark, d, "part")
    new = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_type").alias("label"), (F.lit(7 * 10**15) + F.col("p_partkey")).alias("_ord"))
    return nodes(spark, d).select("id", "label", "_ord").unionByName(new)


RENAMED = "renamed AS (SELECT id, label, _ord FROM nodes UNION ALL SELECT 'part:' || p_partkey, p_type, 7000000000000000 + p_partkey FROM part)"


@query("node_dedupe", f"{RENAMED} SELECT id, arg_max(label, _ord) AS label, min(_ord) AS _ord FROM renamed GROUP BY id")
def node_dedupe(spark, d):
    return B.dedupe_nodes(_renamed_parts(spark, d)).select("id", "label", "_ord")


@query("dangling_edges", "live AS (SELECT id FROM nodes WHERE file_type = 'document' OR source_file = '') SELECT source, target, relation, CASE WHEN source NOT IN (SELECT id FROM live) THEN source ELSE target END AS missing FROM edges WHERE source NOT IN (SELECT id FROM live) OR target NOT IN (SELECT id FROM live)")
def dangling_edges(spark, d):
    live = nodes(spark, d).where("file_type = 'document' or source_file = ''")
    return X.dangling(edges(spark, d), live).select("source", "target", "relation", "missing")


@query("prune_dangling", "live AS (SELECT id FROM nodes WHERE file_type = 'document' OR source_file = '') SELECT source, target, relation, _ord FROM edges WHERE source IN (SELECT id FROM live) AND target IN (SELECT id FROM live)")
def prune_dangling(spark, d):
    live = nodes(spark, d).where("file_type = 'document' or source_file = ''")
    return X.prune_dangling(edges(spark, d), live).select("source", "target", "relation", "_ord")


@query(
    "validate_errors",
    """n AS (SELECT id, CASE WHEN starts_with(id, 'region') THEN '' ELSE label END AS label, CASE WHEN starts_with(id, 'supplier') THEN 'binary' ELSE file_type END AS file_type, source_file FROM nodes WHERE NOT starts_with(id, 'nation')),
    e AS (SELECT source, target, relation, CASE WHEN relation = 'uses' THEN 'GUESS' ELSE confidence END AS confidence, source_file FROM edges),
    miss AS (SELECT e.*, CASE WHEN source NOT IN (SELECT id FROM n) THEN source ELSE target END AS missing FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n))
    SELECT kind, error, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT 'node' AS kind, 'missing label' AS error FROM n WHERE label = ''
      UNION ALL SELECT 'node', 'invalid file_type ' || file_type FROM n WHERE file_type NOT IN ('code', 'document', 'paper', 'image', 'rationale', 'concept')
      UNION ALL SELECT 'edge', 'invalid confidence ' || confidence FROM e WHERE confidence NOT IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')
      UNION ALL SELECT 'edge', 'unknown node ' || missing FROM miss) GROUP BY kind, error""",
)
def validate_errors(spark, d):
    n = nodes(spark, d).where("not startswith(id, 'nation')")
    n = n.withColumn("label", F.expr("if(startswith(id, 'region'), '', label)")).withColumn("file_type", F.expr("if(startswith(id, 'supplier'), 'binary', file_type)"))
    e = edges(spark, d).withColumn("confidence", F.expr("if(relation = 'uses', 'GUESS', confidence)"))
    return X.validate(n, e).groupBy("kind", "error").agg(F.count(F.lit(1)).alias("n"))


@query("endpoint_resolve", "SELECT source, target, relation, _ord FROM edges")
def endpoint_resolve(spark, d):
    loose = edges(spark, d).withColumn("source", F.upper(F.replace("source", F.lit(":"), F.lit("--")))).withColumn("target", F.concat(F.lit("_"), F.replace("target", F.lit(":"), F.lit(" ")), F.lit("_")))
    return B.resolve_endpoints(loose, nodes(spark, d), ascii_ids=True).select("source", "target", "relation", "_ord")


GHOST = """g AS (
  SELECT id, label, source_file, CASE WHEN file_type = 'code' AND starts_with(id, 'supplier') THEN 'ast' END AS _origin FROM nodes
  UNION ALL SELECT 'ghost_' || id, upper(label), 'copy/' || source_file, 'llm' FROM nodes WHERE starts_with(id, 'supplier'))"""


def _ghosts(spark, d):
    n = nodes(spark, d).withColumn("_origin", F.expr("if(file_type = 'code' and startswith(id, 'supplier'), 'ast', null)"))
    twins = n.where("startswith(id, 'supplier')").select(F.concat(F.lit("ghost_"), "id").alias("id"), F.upper("label").alias("label"), F.concat(F.lit("copy/"), "source_file").alias("source_file"), F.lit("llm").alias("_origin"))
    return n.select("id", "label", "source_file", "_origin").unionByName(twins)


@query(
    "ghost_merge",
    f"""{GHOST}, k AS (SELECT *, split_part(source_file, '/', -1) AS f, lower(trim(label)) AS l, coalesce(_origin = 'ast', false) AS ast FROM g WHERE source_file <> '' AND label <> ''),
    u AS (SELECT f, l, max(id) FILTER (ast) AS new FROM k GROUP BY f, l HAVING count(*) FILTER (ast) = 1 AND count(*) > 1 AND count(DISTINCT source_file) FILTER (NOT ast) <= 1)
    SELECT k.id AS old, u.new FROM k JOIN u USING (f, l) WHERE NOT ast""",
)
def ghost_merge(spark, d):
    return B.ghost_remap(_ghosts(spark, d))


@query("label_dedup", "r AS (SELECT id, lower(trim(label)) AS norm, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY regexp_matches(id, '_c[0-9]+$'), length(id), _ord) AS rn FROM nodes WHERE trim(label) <> '') SELECT a.id AS old, b.id AS new FROM r a JOIN r b USING (norm) WHERE b.rn = 1 AND a.rn > 1")
def label_dedup(spark, d):
    return B.label_remap(nodes(spark, d), F.lower(F.trim("label")))


@query(
    "remap_applied",
    """r AS (SELECT id, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY length(id), _ord) AS rn, lower(trim(label)) AS norm FROM nodes),
    m AS (SELECT a.id AS old, b.id AS new FROM r a JOIN r b USING (norm) WHERE b.rn = 1 AND a.rn > 1)
    SELECT coalesce(s.new, source) AS source, coalesce(t.new, target) AS target, relation, CAST(count(*) AS BIGINT) AS n FROM edges LEFT JOIN m s ON source = s.old LEFT JOIN m t ON target = t.old WHERE coalesce(s.new, source) <> coalesce(t.new, target) GROUP BY 1, 2, 3""",
)
def remap_applied(spark, d):
    g = graph(spark, d)
    out = B.apply_remap(g, B.label_remap(g.nodes, F.lower(F.trim("label"))))
    return out.edges.groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("doc_twins", "t AS (SELECT id, source_file FROM nodes UNION ALL SELECT id || '_doc', source_file FROM nodes WHERE file_type = 'document') SELECT a.id AS old, b.id AS new FROM t a JOIN t b ON b.id = a.id || '_doc' AND a.source_file = b.source_file")
def doc_twins(spark, d):
    n = nodes(spark, d).select("id", "source_file", "file_type")
    twins = n.where("file_type = 'document'").withColumn("id", F.concat("id", F.lit("_doc")))
    return B.doc_twin_remap(n.unionByName(twins))


@query(
    "language_guard",
    """f AS (SELECT id, CASE WHEN ends_with(source_file, '.py') THEN 'py' END AS fam, regexp_matches(source_file, '\\.[^./]+$') AS ext FROM nodes),
    e AS (SELECT source, target, CASE WHEN relation = 'contains' THEN 'calls' ELSE relation END AS relation, confidence, _ord FROM edges)
    SELECT e.source, e.target, e.relation, e._ord FROM e JOIN f s ON s.id = source JOIN f t ON t.id = target
    WHERE NOT (relation = 'calls' AND confidence = 'INFERRED' AND s.ext AND t.ext AND NOT coalesce(s.fam = t.fam, false))""",
)
def language_guard(spark, d):
    e = edges(spark, d).withColumn("relation", F.expr("if(relation = 'contains', 'calls', relation)"))
    return B.guard_languages(e, nodes(spark, d)).select("source", "target", "relation", "_ord")


@query("source_backfill", "SELECT e.source, e.target, e._ord, coalesce(nullif(e.source_file, ''), nullif(s.source_file, ''), nullif(t.source_file, ''), '') AS source_file FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target")
def source_backfill(spark, d):
    return B.backfill_source_file(edges(spark, d), nodes(spark, d)).select("source", "target", "_ord", "source_file")


@query("graph_stats", "SELECT CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (confidence = 'EXTRACTED') AS BIGINT) AS extracted, CAST(count(*) FILTER (confidence = 'INFERRED') AS BIGINT) AS inferred, CAST(count(*) FILTER (confidence = 'AMBIGUOUS') AS BIGINT) AS ambiguous, CAST(floor(100.0 * count(*) FILTER (confidence = 'EXTRACTED') / count(*) + 0.5) AS BIGINT) AS extracted_pct, CAST(floor(100.0 * count(*) FILTER (confidence = 'INFERRED') / count(*) + 0.5) AS BIGINT) AS inferred_pct, CAST(floor(100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*) + 0.5) AS BIGINT) AS ambiguous_pct FROM edges")
def graph_stats(spark, d):
    return A.confidence_histogram(edges(spark, d))


@query("confidence_stats", "SELECT CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (confidence = 'EXTRACTED') AS BIGINT) AS extracted, CAST(count(*) FILTER (confidence = 'INFERRED') AS BIGINT) AS inferred, CAST(count(*) FILTER (confidence = 'AMBIGUOUS') AS BIGINT) AS ambiguous, CAST(0.5 AS DOUBLE) AS inferred_mean, CAST(100 * count(*) FILTER (confidence = 'EXTRACTED') // count(*) AS BIGINT) AS extracted_pct, CAST(100 * count(*) FILTER (confidence = 'INFERRED') // count(*) AS BIGINT) AS inferred_pct, CAST(100 * count(*) FILTER (confidence = 'AMBIGUOUS') // count(*) AS BIGINT) AS ambiguous_pct FROM edges")
def confidence_stats(spark, d):
    return A.confidence_stats(edges(spark, d))


@query(
    "edge_diagnostics",
    """live AS (SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes WHERE file_type <> 'code') AND target IN (SELECT id FROM nodes WHERE file_type <> 'code')),
    p AS (SELECT source, target, count(*) AS c, count(DISTINCT relation) AS rels, count(DISTINCT (relation, confidence, weight, context, source_file)) AS vars FROM live GROUP BY source, target),
    x AS (SELECT sum(c - 1) AS s FROM (SELECT count(*) AS c FROM live GROUP BY source, target, relation, confidence, weight, context, source_file)),
    u AS (SELECT sum(c - 1) AS s FROM (SELECT count(*) AS c FROM live GROUP BY least(source, target), greatest(source, target))),
    r AS (SELECT sum(c - 1) AS s FROM (SELECT count(*) AS c FROM live GROUP BY source, target, relation))
    SELECT CAST((SELECT count(*) FROM edges) AS BIGINT) AS raw_edges, CAST((SELECT count(*) FROM edges WHERE source = target) AS BIGINT) AS self_loops, CAST(0 AS BIGINT) AS missing_source, CAST(0 AS BIGINT) AS missing_target, CAST((SELECT count(*) FROM live) AS BIGINT) AS live_edges,
      CAST(count(*) AS BIGINT) AS directed_pairs, CAST(count(*) FILTER (rels > 1) AS BIGINT) AS relation_variant_groups, CAST(count(*) FILTER (vars > 1) AS BIGINT) AS variant_groups, CAST(sum(c - 1) AS BIGINT) AS directed_collapse,
      CAST((SELECT s FROM x) AS BIGINT) AS exact_duplicates, CAST((SELECT s FROM u) AS BIGINT) AS undirected_collapse, CAST((SELECT s FROM r) AS BIGINT) AS same_relation_collapse, CAST((SELECT count(*) FROM edges) - (SELECT count(*) FROM live) AS BIGINT) AS dangling_edges FROM p""",
)
def edge_diagnostics(spark, d):
    return A.edge_diagnostics(edges(spark, d), nodes(spark, d).where("file_type <> 'code'"))


MEMBERS = "c AS (SELECT community AS cid, id AS node_id FROM nodes WHERE community IS NOT NULL)"


@query("cohesion_all", f"{MEMBERS}, i AS (SELECT cid, count(*) AS k FROM (SELECT DISTINCT s.cid, least(source, target) AS a, greatest(source, target) AS b FROM edges JOIN c s ON s.node_id = source JOIN c t ON t.node_id = target WHERE s.cid = t.cid) GROUP BY cid) SELECT CAST(m.cid AS BIGINT) AS cid, CAST(n AS BIGINT) AS members, CAST(coalesce(k, 0) AS BIGINT) AS intra_edges, round(CASE WHEN n <= 1 THEN 1.0 ELSE coalesce(k, 0) / (n * (n - 1) / 2.0) END, 9) AS cohesion FROM (SELECT cid, count(*) AS n FROM c GROUP BY cid) m LEFT JOIN i USING (cid)")
def cohesion_all(spark, d):
    return A.cohesion(edges(spark, d), members(spark, d)).withColumn("cohesion", F.round("cohesion", 9))


@query("community_remap_overlap", f"{MEMBERS}, o AS (SELECT region.r_regionkey AS cid, 'customer:' || c_custkey AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT CAST(c.cid AS BIGINT) AS new_cid, CAST(o.cid AS BIGINT) AS old_cid, CAST(count(*) AS BIGINT) AS shared FROM c JOIN o USING (node_id) GROUP BY 1, 2")
def community_remap_overlap(spark, d):
    region_of = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("cid"))
    old = table(spark, d, "customer").join(region_of, "c_nationkey").select("cid", F.concat(F.lit("customer:"), "c_custkey").alias("node_id"))
    return C.overlap(members(spark, d), old)


@query("meta_graph", f"{MEMBERS} SELECT CAST(least(s.cid, t.cid) AS BIGINT) AS cu, CAST(greatest(s.cid, t.cid) AS BIGINT) AS cv, CAST(count(*) AS BIGINT) AS edges FROM edges JOIN c s ON s.node_id = source JOIN c t ON t.node_id = target WHERE s.cid <> t.cid GROUP BY 1, 2")
def meta_graph(spark, d):
    return A.meta_graph(edges(spark, d), members(spark, d))


@query("hub_labels", f"{DEGREE_TWICE} SELECT CAST(community AS BIGINT) AS community, id, label, CAST(degree AS BIGINT) AS degree FROM (SELECT n.*, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, n.id) AS rn FROM nodes n LEFT JOIN deg2 USING (id) WHERE community IS NOT NULL) WHERE rn = 1")
def hub_labels(spark, d):
    return W.hub_labels(nodes(spark, d), edges(spark, d))


@query("dominant_confidence", "x AS (SELECT id, confidence, count(*) AS n FROM (SELECT source AS id, confidence FROM edges UNION ALL SELECT target, confidence FROM edges WHERE source <> target) GROUP BY 1, 2) SELECT id, confidence, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, CASE confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END) AS rn FROM x) WHERE rn = 1")
def dominant_confidence(spark, d):
    return A.dominant_confidence(edges(spark, d))


@query("community_reach", f"{MEMBERS} SELECT id, CAST(count(DISTINCT cid) AS BIGINT) AS reach FROM (SELECT source AS id, target AS o FROM edges UNION ALL SELECT target, source FROM edges) JOIN c ON o = node_id GROUP BY id")
def community_reach(spark, d):
    return A.community_reach(edges(spark, d), members(spark, d))


@query("isolated_nodes", f"{DEGREE_ALL} SELECT id, CAST(degree AS BIGINT) AS degree FROM (SELECT n.*, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id)) WHERE degree <= 1 AND {NOT_STUB} AND {NOT_CONCEPT} AND file_type <> 'rationale'")
def isolated_nodes(spark, d):
    return A.isolated_nodes(nodes(spark, d), A.degree_all(edges(spark, d), nodes(spark, d))).select("id", "degree")


@query("thin_communities", f"{MEMBERS} SELECT CAST(cid AS BIGINT) AS cid, CAST(count(*) AS BIGINT) AS members FROM c GROUP BY cid HAVING count(*) < 40")
def thin_communities(spark, d):
    return A.thin_communities(members(spark, d), 40)


@query("member_signatures", f"{MEMBERS} SELECT CAST(cid AS BIGINT) AS cid, substr(sha256(string_agg(node_id, chr(0) ORDER BY node_id) || chr(0)), 1, 16) AS signature FROM c GROUP BY cid")
def member_signatures(spark, d):
    return A.member_signatures(members(spark, d))


@query("community_labels", "SELECT CAST(community AS BIGINT) AS community, string_agg(label, ', ' ORDER BY rn) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY _ord) AS rn FROM nodes WHERE community IS NOT NULL) WHERE rn <= 5 GROUP BY community")
def community_labels(spark, d):
    return A.community_labels(nodes(spark, d), 5)


@query("path_rollup", "p AS (SELECT string_split(source_file, '/') AS s FROM nodes WHERE source_file <> '') SELECT path, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p)) GROUP BY path")
def path_rollup(spark, d):
    return A.path_rollup(nodes(spark, d))


@query("file_index", "SELECT source_file, CAST(count(*) AS BIGINT) AS node_count, array_to_string(list_sort(list(DISTINCT community) FILTER (community IS NOT NULL)), ',') AS communities FROM nodes WHERE source_file <> '' GROUP BY source_file")
def file_index(spark, d):
    return A.file_index(nodes(spark, d)).withColumn("communities", F.expr("if(size(communities) = 0, null, array_join(transform(communities, c -> cast(c as string)), ','))"))


def _prs(spark, d):
    """Orders as pull requests that touch the files of their parts."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_set(F.concat(F.lit("src/parts/"), "p_brand", F.lit(".py"))).alias("files_changed"))


@query(
    "pr_impact",
    """f AS (SELECT source_file, count(*) AS n, list(DISTINCT community) AS cs FROM nodes WHERE source_file <> '' GROUP BY source_file),
    pr AS (SELECT DISTINCT l_orderkey AS number, 'parts/' || p_brand || '.py' AS file FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT number, CAST(sum(n) AS BIGINT) AS nodes, array_to_string(list_sort(list_distinct(flatten(list(cs)))), ',') AS communities FROM pr JOIN f ON source_file = file GROUP BY number""",
)
def pr_impact(spark, d):
    out = A.pr_impact(_prs(spark, d), A.file_index(nodes(spark, d)))
    return out.withColumn("communities", F.expr("array_join(transform(communities, c -> cast(c as string)), ',')"))


@query("pr_conflicts", "x AS (SELECT DISTINCT l_orderkey AS number, p_size + 100 AS community FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN (SELECT DISTINCT p_brand AS b, p_size AS z FROM part) q ON q.b = p.p_brand AND q.z = p.p_size) SELECT CAST(community AS BIGINT) AS community, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY community HAVING count(*) > 1")
def pr_conflicts(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    impact = lines.groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_set((F.col("p_size") + 100).cast("bigint")).alias("communities"))
    return A.pr_conflicts(impact).select("community", "n")


@query(
    "pr_status",
    """SELECT o_orderkey AS number, CASE WHEN o_orderpriority = '5-LOW' THEN 'wrong_base' WHEN o_orderstatus = 'F' THEN 'ci_failing' WHEN o_totalprice > 300000 THEN 'changes_requested'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'draft' WHEN date_diff('second', o_orderdate, TIMESTAMP '1998-08-01') / 86400.0 >= 14 THEN 'stale' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END AS status FROM orders""",
    graph=False,
)
def pr_status(spark, d):
    prs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("number"), F.expr("if(o_orderpriority = '5-LOW', 'dev', 'main')").alias("base_branch"), F.expr("case o_orderstatus when 'F' then 'FAILURE' when 'P' then 'PENDING' else 'SUCCESS' end").alias("ci_status"),
        F.expr("if(o_totalprice > 300000, 'CHANGES_REQUESTED', 'APPROVED')").alias("review_decision"), (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("is_draft"), F.col("o_orderdate").alias("updated_at"),
    )
    return prs.select("number", A.pr_status("1998-08-01").alias("status"))


def _older(spark, d) -> Graph:
    """The graph before the suppliers came."""
    g = graph(spark, d)
    return g.with_(nodes=g.nodes.where("not startswith(id, 'supplier')"), edges=g.edges.where("not startswith(source, 'supplier') and not startswith(target, 'supplier')"))


@query("graph_diff_nodes", "SELECT 'new' AS side, id, label FROM nodes WHERE starts_with(id, 'supplier')")
def graph_diff_nodes(spark, d):
    out = U.graph_diff(_older(spark, d), graph(spark, d))
    return out["new_nodes"].select(F.lit("new").alias("side"), "id", "label").unionByName(out["removed_nodes"].select(F.lit("removed").alias("side"), "id", "label"))


@query("graph_diff_edges", "SELECT DISTINCT 'removed' AS side, source AS a, target AS b, relation FROM edges WHERE starts_with(source, 'supplier') OR starts_with(target, 'supplier')")
def graph_diff_edges(spark, d):
    out = U.graph_diff(graph(spark, d), _older(spark, d))
    return out["new_edges"].select(F.lit("new").alias("side"), "a", "b", "relation").unionByName(out["removed_edges"].select(F.lit("removed").alias("side"), "a", "b", "relation"))


@query("union_merge", f"{RENAMED} SELECT 'node' AS kind, id AS ref, arg_max(label, _ord) AS value FROM renamed GROUP BY id UNION ALL SELECT 'edge', source || '>' || target, relation FROM edges UNION ALL SELECT 'edge', source || '>' || target, relation FROM edges WHERE relation = 'uses'")
def union_merge(spark, d):
    g = graph(spark, d)
    p = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_partkey").alias("_ord"))
    m = U.union_merge(g, Graph(p, g.edges.where("relation = 'uses'")))
    return m.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.col("label").alias("value")).unionByName(m.edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("ref"), F.col("relation").alias("value")))


@query("merge_repos", "SELECT tag || '::' || id AS id, tag AS repo, id AS local_id, label FROM nodes, (VALUES ('a'), ('b')) t(tag)")
def merge_repos(spark, d):
    g = graph(spark, d)
    return U.merge_repos({"a": g, "b": g}).nodes.select("id", "repo", "local_id", "label")


@query("global_add", "ext AS (SELECT label, id FROM nodes WHERE source_file = ''), w AS (SELECT 'a::' || id AS id, label FROM nodes) SELECT id, label FROM w UNION ALL SELECT 'b::' || id, label FROM nodes WHERE source_file <> ''")
def global_add(spark, d):
    g = graph(spark, d)
    return U.global_add(U.with_prefix(g, "a"), g, "b").nodes.select("id", "label")


@query("global_remove", "SELECT 'a::' || id AS id FROM nodes")
def global_remove(spark, d):
    g = graph(spark, d)
    return U.prune_repo(U.merge_repos({"a": g, "b": g}), "b").nodes.select("id")


MANIFEST = "m AS (SELECT url AS path, md5(html) AS was FROM pages WHERE length(html) > 1500), f AS (SELECT url AS path, md5(CASE WHEN contains(html, '%%%') THEN html || ' ' ELSE html END) AS now FROM pages WHERE NOT contains(url, '?'))"


def _manifests(spark, d):
    p = table(spark, d, "pages")
    m = p.where(F.char_length("html") > 1500).select(F.col("url").alias("path"), F.md5("html").alias("ast_hash"))
    f = p.where("not contains(url, '?')").select(F.col("url").alias("path"), F.md5(F.when(F.contains("html", F.lit("%%%")), F.concat("html", F.lit(" "))).otherwise(F.col("html"))).alias("ast_hash"))
    return m, f


@query("incremental_changed", f"WITH {MANIFEST} SELECT coalesce(m.path, f.path) AS path, CASE WHEN now IS NULL THEN 'deleted' WHEN was IS NULL THEN 'new' WHEN was <> now THEN 'changed' ELSE 'same' END AS state FROM m FULL JOIN f ON m.path = f.path", graph=False)
def incremental_changed(spark, d):
    return U.detect_changes(*_manifests(spark, d))


@query("next_manifest", f"WITH {MANIFEST} SELECT path, now AS ast_hash FROM f UNION ALL SELECT path, was FROM m WHERE path NOT IN (SELECT path FROM f) AND NOT contains(path, '?')", graph=False)
def next_manifest(spark, d):
    m, f = _manifests(spark, d)
    return U.next_manifest(m, f, m.where("contains(path, '?')"))


@query(
    "incremental_upsert",
    """fresh AS (SELECT id, label || ' v2' AS label, source_file FROM nodes WHERE starts_with(id, 'part:') AND ends_with(id, '7')), rep AS (SELECT DISTINCT source_file FROM fresh),
    kept AS (SELECT id, label FROM nodes WHERE source_file NOT IN (SELECT source_file FROM rep) AND NOT starts_with(source_file, 'orders/1995'))
    SELECT id, label FROM kept WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT id, label FROM fresh""",
)
def incremental_upsert(spark, d):
    g = graph(spark, d)
    fresh = g.nodes.where("startswith(id, 'part:') and endswith(id, '7')").withColumn("label", F.concat("label", F.lit(" v2")))
    gone = g.nodes.where("startswith(source_file, 'orders/1995')").select("source_file").distinct()
    return U.upsert(g, Graph(fresh, g.edges.limit(0)), gone).nodes.select("id", "label")


@query("shrink_guard", "SELECT id, source_file FROM nodes WHERE starts_with(id, 'supplier') AND source_file <> 'suppliers/nation_3.py'")
def shrink_guard(spark, d):
    n = nodes(spark, d)
    return U.shrink_losses(n, n.where("not startswith(id, 'supplier')"), n.where("source_file = 'suppliers/nation_3.py'")).select("id", "source_file")


@query("cache_split", "WITH h AS (SELECT doc_id, source, sha256(regexp_replace(text, '^---\\r?\\n(.|\\n)*?\\n---[ \\t]*\\r?\\n?', '')) AS hash FROM documents), c AS (SELECT DISTINCT hash FROM h WHERE source <> 'src0') SELECT doc_id, hash IN (SELECT hash FROM c) AS hit FROM h", graph=False)
def cache_split(spark, d):
    files = table(spark, d, "documents").select("doc_id", "source", U.content_hash(F.col("text")).alias("hash"))
    hit, miss = U.cache_split(files, files.where("source <> 'src0'"))
    return hit.select("doc_id", F.lit(True).alias("hit")).unionByName(miss.select("doc_id", F.lit(False).alias("hit")))


@query("topology", "SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM edges) AS BIGINT) AS edges")
def topology(spark, d):
    return U.topology(graph(spark, d)).select("nodes", "edges")


@query("undirected_weights", "SELECT least(source, target) AS a, greatest(source, target) AS b, max(coalesce(weight, 1.0)) AS weight FROM edges GROUP BY 1, 2")
def undirected_weights(spark, d):
    return C.undirected_weights(edges(spark, d))


@query("induced_subgraph", "SELECT least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight FROM edges WHERE source IN (SELECT id FROM nodes WHERE file_type = 'document') AND target IN (SELECT id FROM nodes WHERE file_type = 'document') GROUP BY 1, 2")
def induced_subgraph(spark, d):
    return C.induced(C.undirected_weights(edges(spark, d)), nodes(spark, d).where("file_type = 'document'"))


@query(
    "connected_components",
    f"""WITH RECURSIVE {GRAPH_SQL},
    nd AS (SELECT n_nationkey, 'region:' || n_regionkey AS r FROM nation),
    rg AS (SELECT 'customer:' || c_custkey AS id, r FROM customer JOIN nd ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, r FROM supplier JOIN nd ON s_nationkey = n_nationkey UNION ALL SELECT 'nation:' || n_nationkey, r FROM nd UNION ALL SELECT DISTINCT r, r FROM nd),
    od AS (SELECT source AS id, r FROM edges JOIN rg ON id = target WHERE relation = 'references'),
    pr AS (SELECT source AS id, min(r) AS r FROM edges JOIN rg ON id = target WHERE relation = 'uses' GROUP BY source),
    v AS (SELECT * FROM rg UNION ALL SELECT * FROM od UNION ALL SELECT * FROM pr),
    lk AS (SELECT DISTINCT x.r AS a, y.r AS b FROM edges JOIN v x ON x.id = source JOIN v y ON y.id = target),
    reach AS (SELECT DISTINCT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM lk UNION SELECT b, a FROM lk) l ON l.a = reach.b),
    root AS (SELECT a AS r, min(b) AS root FROM reach GROUP BY a)
    SELECT id, min(id) OVER (PARTITION BY root) AS component FROM v JOIN root USING (r)""",
    graph=False,
)
def connected_components(spark, d):
    return C.components(C.undirected_weights(edges(spark, d)))


@query("clusters")
def clusters(spark, d):
    return C.cluster(nodes(spark, d), edges(spark, d, repeated=True))


@query("louvain_communities")
def louvain_communities(spark, d):
    return C.partition_edges(edges(spark, d, repeated=True), refine=False)


@query("stable_labels", f"{MEMBERS} SELECT CAST(cid AS BIGINT) AS cid, node_id FROM c")
def stable_labels(spark, d):
    c = members(spark, d)
    return C.keep_labels(c.withColumn("cid", F.col("cid") + 1000), c)
