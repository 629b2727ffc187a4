"""Queries on search, traversal, ranking, memory and work reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import rank as W
from ..operators import traverse as T
from ..operators.scratch import written
from ..sources.tables import edges, nodes, table
from .catalog import SQL, query
from .graph_queries import DEGREE_ALL, MEMBERS, NOT_CONCEPT, NOT_STUB, members

QUESTION = ["blue", "steel", "customer"]


def prepared(spark, d):
    """Nodes with their search label; the labels of these tables are ASCII."""
    return W.with_norm_label(nodes(spark, d), ascii_labels=True)


TERMS = "terms AS (SELECT * FROM (VALUES ('blue', 0), ('steel', 1), ('customer', 2)) t(term, term_no))"
IDF = f"{TERMS}, idf AS (SELECT term, term_no, count(id) AS df, ln(1 + (SELECT count(*) FROM nodes) / (1.0 + count(id))) AS idf FROM terms LEFT JOIN nodes ON contains(lower(label), term) GROUP BY 1, 2)"
SCORED = f"""{IDF},
n AS (SELECT *, lower(label) AS norm, regexp_replace(lower(label), '[()]+$', '') AS bare, array_to_string(regexp_extract_all(lower(label), '[a-z0-9_]+'), ' ') AS tokens, lower(source_file) AS src FROM nodes),
per AS (SELECT n.id, any_value(n.label) AS label, any_value(norm) AS norm, any_value(bare) AS bare, any_value(tokens) AS tokens, any_value(_ord) AS _ord,
   sum(CASE WHEN norm = term OR bare = term THEN 1000 * idf WHEN starts_with(norm, term) OR starts_with(bare, term) THEN 100 * idf ELSE 0 END) AS tiered,
   count(*) FILTER (norm = term OR bare = term OR starts_with(norm, term) OR starts_with(bare, term)) AS matched,
   sum(CASE WHEN NOT (norm = term OR bare = term OR starts_with(norm, term) OR starts_with(bare, term)) AND contains(norm, term) THEN idf ELSE 0 END + CASE WHEN contains(src, term) THEN 0.5 * idf ELSE 0 END) AS plain
   FROM n, idf GROUP BY n.id),
scored AS (SELECT id, label, length(label) AS label_len, _ord, norm, (CASE WHEN norm = 'blue steel customer' OR bare = 'blue steel customer' OR tokens = 'blue steel customer' OR lower(id) = 'blue steel customer' THEN 10000 * (SELECT max(idf) FROM idf)
   WHEN starts_with(norm, 'blue steel customer') OR starts_with(bare, 'blue steel customer') OR starts_with(tokens, 'blue steel customer') THEN 1000 * (SELECT max(idf) FROM idf) ELSE 0 END) + plain + tiered * (matched / 3.0) * (matched / 3.0) AS score FROM per),
hits AS (SELECT * FROM scored WHERE score > 0)"""


@query("idf", f"{IDF} SELECT term, term_no, CAST(df AS BIGINT) AS df, round(idf, 9) AS idf FROM idf")
def idf(spark, d):
    return W.idf(prepared(spark, d), QUESTION).withColumn("idf", F.round("idf", 9))


@query("score_nodes", f"{SCORED} SELECT id, round(score, 6) AS score, CAST(label_len AS INTEGER) AS label_len FROM hits")
def score_nodes(spark, d):
    return W.score_nodes(prepared(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"), "label_len")


@query("pick_seeds", f"{SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, label_len, id) AS rank, max(score) OVER () AS top FROM hits) SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND (rank = 1 OR score >= 0.2 * top)")
def pick_seeds(spark, d):
    return W.pick_seeds(W.score_nodes(prepared(spark, d), QUESTION), 5).withColumn("score", F.round("score", 6))


@query("pick_seeds_diverse")
def pick_seeds_diverse(spark, d):
    return W.pick_seeds_diverse(prepared(spark, d), edges(spark, d), QUESTION, 3)


@query("pick_endpoint", f"{SCORED} SELECT id, round(score, 6) AS score, contains(norm, 'blue') AND contains(norm, 'steel') AND contains(norm, 'customer') AS \"full\" FROM hits ORDER BY contains(norm, 'blue') AND contains(norm, 'steel') AND contains(norm, 'customer') DESC, score DESC, label_len, id LIMIT 1")
def pick_endpoint(spark, d):
    return W.pick_endpoint(prepared(spark, d), "blue steel customer").withColumn("score", F.round("score", 6))


@query(
    "find_node",
    """SELECT id, CAST(tier AS INTEGER) AS tier FROM (SELECT id, CASE WHEN lower(source_file) = 'parts/brand#12.py' AND source_location = 'L1' THEN 1 WHEN lower(source_file) = 'parts/brand#12.py' THEN 2
    WHEN lower(label) = 'parts/brand#12.py' THEN 3 WHEN starts_with(lower(label), 'parts/brand#12.py') THEN 4 WHEN contains(lower(label), 'parts/brand#12.py') THEN 5 END AS tier FROM nodes) WHERE tier IS NOT NULL""",
)
def find_node(spark, d):
    return W.find_node(prepared(spark, d), "parts/Brand#12.py").select("id", "tier")


@query("resolve_seed", "SELECT id, CAST(0 AS INTEGER) AS tier FROM nodes WHERE id = 'nation:7'")
def resolve_seed(spark, d):
    return W.resolve_seed(nodes(spark, d), "nation:7").select("id", "tier")


BFS = f"""{DEGREE_ALL}, dn AS (SELECT n.id, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id)),
th AS (SELECT greatest(50, max(degree)) AS t FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM dn) WHERE i = CAST(floor(n * 0.99) AS BIGINT)),
blocked AS (SELECT id FROM dn, th WHERE degree >= t AND id <> 'order:7'), arcs AS (SELECT DISTINCT source, target FROM edges),
l0 AS (SELECT 'order:7' AS id), l1 AS (SELECT DISTINCT target AS id FROM arcs JOIN l0 ON source = l0.id WHERE target <> 'order:7'),
l2 AS (SELECT DISTINCT target AS id FROM arcs JOIN l1 ON source = l1.id WHERE l1.id NOT IN (SELECT id FROM blocked) AND target NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1)),
l3 AS (SELECT DISTINCT target AS id FROM arcs JOIN l2 ON source = l2.id WHERE l2.id NOT IN (SELECT id FROM blocked) AND target NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1 UNION ALL SELECT id FROM l2)),
ball AS (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3)"""


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("bfs_depth3", f"{BFS} SELECT id, CAST(depth AS INTEGER) AS depth FROM ball")
def bfs_depth3(spark, d):
    return T.bfs(edges(spark, d), nodes(spark, d), seeds(spark, "order:7"), 3)


@query("bfs_edges", f"{BFS} SELECT DISTINCT e.source, e.target, CAST(t.depth AS INTEGER) AS depth FROM edges e JOIN ball s ON s.id = source JOIN ball t ON t.id = target WHERE t.depth = s.depth + 1")
def bfs_edges(spark, d):
    e = edges(spark, d)
    return T.bfs_edges(e, T.bfs(e, nodes(spark, d), seeds(spark, "order:7"), 3))


@query("dfs_depth2")
def dfs_depth2(spark, d):
    return T.dfs(edges(spark, d), nodes(spark, d), ["order:7", "order:32"], 2)


@query("neighbors", "SELECT DISTINCT other FROM (SELECT target AS other FROM edges WHERE source = 'customer:8' UNION ALL SELECT source FROM edges WHERE target = 'customer:8')")
def neighbors(spark, d):
    return T.neighbors(edges(spark, d), "customer:8", directed=False)


@query("successors", "SELECT target AS other FROM edges WHERE source = 'part:5'")
def successors(spark, d):
    return T.successors(edges(spark, d), "part:5")


@query("predecessors", "SELECT source AS other FROM edges WHERE target = 'part:5'")
def predecessors(spark, d):
    return T.predecessors(edges(spark, d), "part:5")


@query(
    "affected",
    """rel AS (SELECT * FROM edges WHERE relation IN ('references', 'uses')), a0 AS (SELECT 'supplier:3' AS id),
    a1 AS (SELECT source AS id, arg_min(relation, _ord) AS via FROM rel WHERE target IN (SELECT id FROM a0) GROUP BY source)
    SELECT id, CAST(1 AS INTEGER) AS depth, via FROM a1""",
)
def affected(spark, d):
    return T.affected(edges(spark, d), "supplier:3", ("references", "uses"), 2)


@query(
    "shortest_path",
    "SELECT CAST(0 AS INTEGER) AS step, 'customer:1' AS id UNION ALL SELECT 1, 'nation:' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1",
    graph=False,
)
def shortest_path(spark, d):
    region = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return T.shortest_path(edges(spark, d), "customer:1", f"region:{region}", 6)


SUCCESSION = """
b AS (SELECT l_orderkey, p_brand, lead(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT p_brand AS a, nxt AS b, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, nxt) AS rn FROM b WHERE nxt IS NOT NULL AND nxt <> p_brand GROUP BY 1, 2),
fg AS (SELECT a, b FROM r WHERE rn <= 2)"""


def brand_graph(spark, d):
    """Each brand's two most frequent successors among the lines of an order."""
    from pyspark.sql import Window

    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = j.select(F.col("p_brand").alias("a"), F.lead("p_brand").over(w).alias("b")).where("b is not null and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("rn <= 2").select("a", "b")


@query("file_graph", f"WITH {SUCCESSION} SELECT a, b FROM fg", graph=False)
def file_graph(spark, d):
    pairs = brand_graph(spark, d)
    n = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("source_file", F.col("id"))
    e = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("imports_from").alias("relation"), F.lit(None).cast("string").alias("source_file"))
    return T.file_graph(e, n)


@query(
    "import_cycles",
    f"""WITH RECURSIVE {SUCCESSION},
    walk AS (SELECT a AS head, b AS last, [a, b] AS path FROM fg WHERE a < b UNION ALL SELECT head, fg.b, list_append(path, fg.b) FROM walk JOIN fg ON last = fg.a WHERE fg.b > head AND NOT list_contains(path, fg.b) AND len(path) < 5)
    SELECT CAST(len(path) AS INTEGER) AS length, array_to_string(path, ' -> ') AS cycle FROM walk JOIN fg ON last = fg.a AND fg.b = head ORDER BY length, cycle LIMIT 20""",
    graph=False,
)
def import_cycles(spark, d):
    return T.import_cycles(brand_graph(spark, d), 5, 20)


@query("token_budget_render", "l AS (SELECT id, 'NODE ' || label || ' [src=' || source_file || ' loc=' || source_location || ' community=' || coalesce(CAST(community AS VARCHAR), '') || ']' AS line, _ord FROM nodes) SELECT line, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(line) + 1) OVER (ORDER BY _ord ROWS UNBOUNDED PRECEDING) AS used FROM l) WHERE used - 1 <= 300 * 3")
def token_budget_render(spark, d):
    lines = nodes(spark, d).select(W.node_lines(nodes(spark, d)).alias("line"), "_ord")
    return W.within_budget(lines, ["_ord"], 300).select("line", "used")


SIDES = f"""{DEGREE_ALL}, nn AS (SELECT n.*, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id)),
nx AS (SELECT *, NOT ({NOT_STUB}) OR NOT ({NOT_CONCEPT}) AS skip, CASE WHEN ends_with(source_file, '.py') THEN 'code' ELSE 'doc' END AS cat FROM nn),
pairs AS (SELECT e.*, u.label AS ul, v.label AS vl, u.source_file AS uf, v.source_file AS vf, u.community AS uc, v.community AS vc, u.degree AS ud, v.degree AS vd, u.cat AS ucat, v.cat AS vcat, u.skip OR v.skip AS skip
  FROM edges e JOIN nx u ON u.id = source JOIN nx v ON v.id = target WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method')),
hush AS (SELECT *, confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND ((ucat = 'code') <> (vcat = 'code')) AS h FROM pairs WHERE NOT skip),
sc AS (SELECT *, CAST((CASE WHEN h THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END) + CASE WHEN NOT h AND ucat <> vcat THEN 2 ELSE 0 END
  + CASE WHEN NOT h AND split_part(uf, '/', 1) <> split_part(vf, '/', 1) THEN 2 ELSE 0 END + CASE WHEN NOT h AND coalesce(uc <> vc, false) THEN 1 ELSE 0 END
  + CASE WHEN least(ud, vd) <= 2 AND greatest(ud, vd) >= 5 THEN 1 ELSE 0 END AS INTEGER) AS score FROM hush)"""


@query("surprises_cross_file", f"{SIDES} SELECT source AS u, target AS v, ul AS u_label, vl AS v_label, relation, confidence, score FROM sc WHERE uf <> '' AND vf <> '' AND uf <> vf ORDER BY score DESC, _ord LIMIT 5")
def surprises_cross_file(spark, d):
    return W.cross_file_surprises(nodes(spark, d), edges(spark, d), 5)


@query("surprise_scores", f"{SIDES} SELECT source AS u, target AS v, relation, score FROM sc")
def surprise_scores(spark, d):
    e = edges(spark, d)
    j = W.surprise_columns(e.where(~F.col("relation").isin(*W.STRUCTURAL)), nodes(spark, d), A.degree_all(e))
    return j.where("not u_skip and not v_skip").select("u", "v", "relation", W.surprise_score().alias("score"))


@query("surprises_cross_community", f"{SIDES}, b AS (SELECT least(uc, vc) AS cu, greatest(uc, vc) AS cv, *, row_number() OVER (PARTITION BY least(uc, vc), greatest(uc, vc) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, _ord) AS rn FROM hush WHERE uc <> vc) SELECT CAST(cu AS BIGINT) AS cu, CAST(cv AS BIGINT) AS cv, source AS u, target AS v, relation, confidence FROM b WHERE rn = 1 ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, _ord LIMIT 5")
def surprises_cross_community(spark, d):
    return W.cross_community_surprises(nodes(spark, d), edges(spark, d), 5)


@query("questions_ambiguous", "SELECT 'ambiguous_edge' AS type, 'What is the exact relationship between `' || u.label || '` and `' || v.label || '`?' AS question, 'Edge tagged AMBIGUOUS (relation: ' || relation || ') - confidence is low.' AS why, e._ord AS position FROM edges e JOIN nodes u ON u.id = source JOIN nodes v ON v.id = target WHERE confidence = 'AMBIGUOUS'")
def questions_ambiguous(spark, d):
    return W.questions_ambiguous(nodes(spark, d), edges(spark, d))


@query(
    "questions_inferred",
    f"""{DEGREE_ALL}, top AS (SELECT id, label, _ord FROM (SELECT n.*, degree FROM nodes n JOIN deg USING (id)) WHERE {NOT_STUB} ORDER BY degree DESC, _ord LIMIT 5),
    x AS (SELECT source AS id, target AS o, _ord FROM edges WHERE confidence = 'INFERRED' UNION ALL SELECT target, source, _ord FROM edges WHERE confidence = 'INFERRED' AND source <> target),
    y AS (SELECT top.id, top.label, top._ord AS pos, n.label AS ol, row_number() OVER (PARTITION BY top.id ORDER BY x._ord) AS rn, count(*) OVER (PARTITION BY top.id) AS c FROM top JOIN x USING (id) JOIN nodes n ON n.id = o)
    SELECT 'verify_inferred' AS type, 'Are the ' || c || ' inferred relationships involving `' || label || '` (e.g. with `' || max(ol) FILTER (rn = 1) || '` and `' || max(ol) FILTER (rn = 2) || '`) actually correct?' AS question,
      '`' || label || '` has ' || c || ' INFERRED edges - model-reasoned connections that need verification.' AS why, pos AS position FROM y WHERE c >= 2 GROUP BY id, label, pos, c""",
)
def questions_inferred(spark, d):
    return W.questions_inferred(nodes(spark, d), edges(spark, d))


@query(
    "questions_isolated",
    f"""{DEGREE_ALL},
    alone AS (SELECT id, label, _ord FROM (SELECT n.*, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id)) WHERE degree <= 1 AND {NOT_STUB} AND {NOT_CONCEPT}),
    first AS (SELECT string_agg('`' || label || '`', ', ' ORDER BY _ord) AS names FROM (SELECT * FROM alone ORDER BY _ord LIMIT 3))
    SELECT 'isolated_nodes' AS type, 'What connects ' || names || ' to the rest of the system?' AS question, (SELECT count(*) FROM alone) || ' weakly-connected nodes found - possible documentation gaps or missing edges.' AS why, CAST(0 AS BIGINT) AS position FROM first WHERE names IS NOT NULL""",
)
def questions_isolated(spark, d):
    return W.questions_isolated(nodes(spark, d), edges(spark, d))


LOW = f"""{MEMBERS}, i AS (SELECT cid, count(*) AS k FROM (SELECT DISTINCT s.cid, least(source, target) AS a, greatest(source, target) AS b FROM edges JOIN c s ON s.node_id = source JOIN c t ON t.node_id = target WHERE s.cid = t.cid) GROUP BY cid),
low AS (SELECT CAST(m.cid AS BIGINT) AS cid, coalesce(k, 0) / (n * (n - 1) / 2.0) AS cohesion FROM (SELECT cid, count(*) AS n FROM c GROUP BY cid) m LEFT JOIN i USING (cid) WHERE n >= 5)"""


@query(
    "questions_low_cohesion",
    f"{LOW} SELECT 'low_cohesion' AS type, 'Should `Community ' || cid || '` be split into smaller, more focused modules?' AS question, 'Cohesion score ' || regexp_replace(CAST(CAST(round(cohesion, 6) AS DECIMAL(12, 6)) AS VARCHAR), '\\.?0+$', '') || ' - nodes in this community are weakly interconnected.' AS why, cid AS position FROM low WHERE cohesion < 0.15",
)
def questions_low_cohesion(spark, d):
    return W.questions_low_cohesion(A.cohesion(edges(spark, d), members(spark, d)))


SUGGESTED = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {i} AS section, type, question, why, position FROM ({SQL[q]}) ORDER BY position, question LIMIT 7)"
    for i, q in enumerate(("questions_ambiguous", "questions_inferred", "questions_isolated", "questions_low_cohesion"))
)


@query("suggest_questions", f"SELECT CAST(section AS INTEGER) AS section, type, question, why FROM ({SUGGESTED}) ORDER BY section, position, question LIMIT 7", graph=False)
def suggest_questions(spark, d):
    e = edges(spark, d)
    return W.suggest_questions(nodes(spark, d), e, A.cohesion(e, members(spark, d)))


@query("diagram_nodes", f"{DEGREE_ALL} SELECT CAST(community AS BIGINT) AS community, id, CAST(degree AS BIGINT) AS degree, CAST(rank AS INTEGER) AS rank FROM (SELECT n.community, n.id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, n.id) AS rank FROM nodes n LEFT JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rank <= 12")
def diagram_nodes(spark, d):
    return W.diagram_nodes(nodes(spark, d), edges(spark, d)).select("community", "id", F.col("degree").cast("bigint").alias("degree"), "rank")


@query("section_keywords", "w AS (SELECT community, unnest(regexp_extract_all(lower(label), '[a-z0-9_]+')) AS word FROM nodes WHERE community IS NOT NULL) SELECT CAST(community AS BIGINT) AS community, word, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (SELECT community, word, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, word) AS rank FROM w WHERE length(word) > 2 GROUP BY 1, 2) WHERE rank <= 5")
def section_keywords(spark, d):
    return W.section_keywords(nodes(spark, d), 5)


@query("sorted_edges", "SELECT source, target, relation, _ord FROM edges")
def sorted_edges(spark, d):
    return W.sorted_edges(edges(spark, d)).select("source", "target", "relation", "_ord")


def path_sql(n: str, a: str, sources: str, steps: int) -> str:
    """Shortest paths as chained common table expressions, materialised: l0.. (s, v, paths) going out, d0.. (s, v, paths, owed) and p0.. (s, v, w, part) coming back."""
    out = [f"arcs AS MATERIALIZED (SELECT DISTINCT a, b FROM ({a}) WHERE a <> b)", f"size AS (SELECT count(*) AS n FROM ({n}))", f"l0 AS MATERIALIZED (SELECT id AS s, id AS v, CAST(1.0 AS DOUBLE) AS paths FROM ({sources}))"]
    for k in range(1, steps + 1):
        seen = " ".join(f"ANTI JOIN l{j} USING (s, v)" for j in range(max(0, k - 2), k))
        out.append(f"l{k} AS MATERIALIZED (SELECT s, v, paths FROM (SELECT s, b AS v, sum(paths) AS paths FROM l{k - 1} JOIN arcs ON v = a GROUP BY s, b) {seen})")
    out.append(f"d{steps} AS MATERIALIZED (SELECT s, v, paths, CAST(0.0 AS DOUBLE) AS owed FROM l{steps})")
    for k in range(steps - 1, -1, -1):
        out.append(f"p{k} AS MATERIALIZED (SELECT h.s, h.v, w.v AS w, h.paths / w.paths * (1 + w.owed) AS part FROM d{k + 1} w JOIN arcs ON arcs.a = w.v JOIN l{k} h ON h.s = w.s AND h.v = arcs.b)")
        out.append(f"d{k} AS MATERIALIZED (SELECT s, v, paths, coalesce(owed, 0.0) AS owed FROM l{k} LEFT JOIN (SELECT s, v, sum(part) AS owed FROM p{k} GROUP BY s, v) USING (s, v))")
    out.append("owed AS (" + " UNION ALL ".join(f"SELECT s, v, owed FROM d{k}" for k in range(steps + 1)) + ")")
    out.append("parts AS (" + " UNION ALL ".join(f"SELECT v, w, part FROM p{k}" for k in range(steps)) + ")")
    return ", ".join(out)


#: The graph's communities as nodes, joined where any of their members are.
COMMUNITY_WAYS = """SELECT x.community::VARCHAR AS a, y.community::VARCHAR AS b FROM (SELECT source AS p, target AS q FROM edges UNION ALL SELECT target, source FROM edges) JOIN nodes x ON x.id = p JOIN nodes y ON y.id = q"""
COMMUNITY_IDS = "SELECT DISTINCT community::VARCHAR AS id FROM nodes WHERE community IS NOT NULL"
COMMUNITY_PATHS = path_sql(COMMUNITY_IDS, f"SELECT a, b FROM ({COMMUNITY_WAYS}) WHERE a IS NOT NULL AND b IS NOT NULL", COMMUNITY_IDS, 8)


def community_graph(spark, d):
    """The communities of the whole graph and the edges between them, as a graph of its own."""
    m = written(members(spark, d))
    n = m.select(F.col("cid").cast("string").alias("id"), F.col("cid").alias("_ord")).distinct()
    e = A.meta_graph(edges(spark, d), m).select(F.col("cu").cast("string").alias("source"), F.col("cv").cast("string").alias("target"))
    return n, e


@query("betweenness")
def betweenness(spark, d):
    return T.betweenness(nodes(spark, d), edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("community_betweenness", f"{COMMUNITY_PATHS}, g AS (SELECT v AS id, sum(owed) AS total FROM owed WHERE s <> v GROUP BY v) SELECT c.id, round(coalesce(total, 0.0) / ((n - 1.0) * (n - 2.0)), 9) AS betweenness FROM ({COMMUNITY_IDS}) c LEFT JOIN g ON g.id = c.id, size")
def community_betweenness(spark, d):
    return T.betweenness(*community_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


EDGE_PARTS = f"{COMMUNITY_PATHS}, eb AS (SELECT least(v, w) AS source, greatest(v, w) AS target, round(sum(part) / (any_value(n) * (any_value(n) - 1.0)), 9) AS betweenness FROM parts, size GROUP BY 1, 2)"


@query("edge_betweenness", f"{EDGE_PARTS} SELECT source, target, betweenness FROM eb")
def edge_betweenness(spark, d):
    return T.edge_betweenness(*community_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("betweenness_surprises", f"{EDGE_PARTS} SELECT source, target, betweenness FROM eb ORDER BY betweenness DESC, source, target LIMIT 5")
def betweenness_surprises(spark, d):
    return T.betweenness_surprises(*community_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("questions_bridges")
def questions_bridges(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return W.questions_bridges(n, e, T.betweenness(n, e))


def memory(spark, d):
    """Conversations as question-and-answer notes: a user turn, the answer after it, and the label of the document of the same number."""
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    outcome = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.expr("case when toxic = 1 then 'corrected' when quality = 1 then 'useful' else 'dead_end' end").alias("outcome"))
    j = q.join(outcome, "conv_id", "left")
    return j.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("_ord"), "question", F.coalesce("outcome", F.lit("useful")).alias("outcome"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("date"),
        F.array(F.concat(F.lit("nation:"), F.col("conv_id") % 25), F.concat(F.lit("region:"), F.col("turn") % 5)).alias("source_nodes"),
    )


MEMORY = """mem AS (SELECT conv_id * 1000 + turn AS _ord, text AS question, coalesce(CASE WHEN toxic = 1 THEN 'corrected' WHEN quality = 1 THEN 'useful' WHEN quality IS NOT NULL THEN 'dead_end' END, 'useful') AS outcome,
  '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS date, ['nation:' || (conv_id % 25), 'region:' || (turn % 5)] AS source_nodes FROM conversations LEFT JOIN labels ON doc_id = conv_id WHERE role = 'user')"""


@query(
    "memory_lessons",
    f"""WITH {MEMORY}, x AS (SELECT unnest(list_distinct(source_nodes)) AS node, date, CASE outcome WHEN 'useful' THEN 1.0 WHEN 'dead_end' THEN -1.0 ELSE 0.0 END AS s, pow(0.5, greatest(0, date_diff('second', CAST(date AS TIMESTAMP), TIMESTAMP '2024-01-31') / 86400.0) / 30.0) AS w FROM mem),
    g AS (SELECT node, round(sum(s * w), 6) AS score, count(*) FILTER (s > 0) AS positive, count(*) FILTER (s < 0) AS negative, max(date) AS last FROM x GROUP BY node)
    SELECT node, score, CAST(positive AS BIGINT) AS positive, CAST(negative AS BIGINT) AS negative, last, CASE WHEN positive > 0 AND negative > 0 THEN 'contested' WHEN positive >= 2 THEN 'preferred' WHEN positive > 0 THEN 'tentative' ELSE 'avoid' END AS standing FROM g WHERE positive + negative > 0""",
    graph=False,
)
def memory_lessons(spark, d):
    return A.lessons(memory(spark, d), "2024-01-31").withColumn("score", F.round("score", 6))


@query("dedupe_questions", f"WITH {MEMORY} SELECT _ord, question FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY _ord DESC) AS rn FROM mem) WHERE rn = 1", graph=False)
def dedupe_questions(spark, d):
    return A.dedupe_by_question(memory(spark, d)).select("_ord", "question")


@query("provenance_top5", f"WITH {MEMORY}, c AS (SELECT DISTINCT unnest(source_nodes) AS node, date, question FROM mem) SELECT node, date, question, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY date DESC, question DESC) AS rank FROM c) WHERE rank <= 5", graph=False)
def provenance_top5(spark, d):
    return A.provenance(memory(spark, d).select(F.explode("source_nodes").alias("node"), "date", "question").distinct())


@query("doc_community", f"{MEMORY}, v AS (SELECT m._ord AS doc_id, n.community, count(*) AS c FROM (SELECT _ord, unnest(source_nodes) AS node FROM mem) m JOIN nodes n ON n.id = node WHERE n.community IS NOT NULL GROUP BY 1, 2) SELECT doc_id, CAST(community AS BIGINT) AS community, CAST(c AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, community) AS rn FROM v) WHERE rn = 1")
def doc_community(spark, d):
    cited = memory(spark, d).select(F.col("_ord").alias("doc_id"), F.explode("source_nodes").alias("node"))
    return A.document_community(cited, nodes(spark, d).where("community is not null").select("id", "community"))
