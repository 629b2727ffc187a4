"""The query interface (Q01-Q19): text answers composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import query_terms
from .operators import aggregate as A
from .operators import rank as W
from .operators import traverse as T
from .operators.communities import communities_of
from .operators.filters import filter_by_context, resolve_context_filters
from .schema import Graph


class GraphQueries:
    """Answers over one graph; search labels are prepared once."""

    def __init__(self, graph: Graph):
        self.graph = graph.with_(nodes=W.with_norm_label(graph.nodes))

    def query_graph(self, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000, context_filter: list[str] | None = None) -> str:
        """Seeds by search, a walk over the edges of the contexts asked for, lines within a budget."""
        g, terms = self.graph, query_terms(question)
        edges = filter_by_context(g.edges, resolve_context_filters(question, context_filter))
        seeds = [r.id for r in W.pick_seeds_diverse(g.nodes, edges, terms).orderBy("order").collect()]  # k and one per term
        if not seeds:
            return "No matching nodes found."
        depth = min(max(depth, 1), 6)
        spark = g.nodes.sparkSession
        if mode == "dfs":
            reached = T.dfs(edges, g.nodes, seeds, depth, g.directed).select("id", "depth")
        else:
            reached = T.bfs(edges, g.nodes, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, g.directed)
        seed_rank = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "id string, seed int")
        n = g.nodes.join(reached, "id").join(A.degree_all(g.edges), "id", "left").join(F.broadcast(seed_rank), "id", "left")
        node_part = n.select(F.lit(0).alias("part"), F.coalesce("seed", F.lit(1 << 30)).alias("k1"), (-F.coalesce("degree", F.lit(0))).alias("k2"), F.col("id").alias("k3"), W.node_lines(n).alias("line"))
        labels = lambda c: g.nodes.select(F.col("id").alias(c), F.coalesce("label", "id").alias(f"{c}_l"))
        e = T.bfs_edges(edges, reached).join(edges.dropDuplicates(["source", "target"]), ["source", "target"]).join(labels("source"), "source").join(labels("target"), "target")
        line = F.concat(F.lit("EDGE "), "source_l", F.lit(" --"), F.coalesce("relation", F.lit("")), F.lit(" ["), F.coalesce("confidence", F.lit("")), F.coalesce(F.concat(F.lit(" context="), "context"), F.lit("")), F.lit("]--> "), "target_l")
        edge_part = e.select(F.lit(1).alias("part"), F.col("depth").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.concat_ws(">", "source", "target").alias("k3"), line.alias("line"))
        lines = node_part.unionByName(edge_part)
        shown = [r.line for r in W.within_budget(lines.orderBy("part", "k1", "k2", "k3").limit(token_budget * 3), ["part", "k1", "k2", "k3"], token_budget).orderBy("part", "k1", "k2", "k3").collect()]
        cut = n.count() - sum(x.startswith("NODE ") for x in shown)
        return "\n".join(shown + ([f"... (truncated - {cut} more nodes cut by ~{token_budget}-token budget)"] if cut else []))

    def _one(self, label: str):
        return W.find_node(self.graph.nodes, label).limit(1).first()

    def get_node(self, label: str) -> str:
        """Q02."""
        hit = self._one(label)
        if hit is None:
            return f"No node matching '{label}' found."
        n = self.graph.nodes.where(F.col("id") == hit.id).first()
        degree = A.degree_all(self.graph.edges).where(F.col("id") == hit.id).first()
        return f"Node: {n.label}\n  ID: {n.id}\n  Source: {n.source_file} {n.source_location or ''}\n  Type: {n.file_type}\n  Community: {'' if n.community is None else n.community}\n  Degree: {degree.degree if degree else 0}"

    def get_neighbors(self, label: str, relation: str | None = None) -> DataFrame | None:
        """Q03: (direction, id, label, relation, confidence)."""
        hit = self._one(label)
        if hit is None:
            return None
        e = self.graph.edges if relation is None else self.graph.edges.where(F.contains(F.lower("relation"), F.lit(relation.lower())))
        out = e.where(F.col("source") == hit.id).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation", "confidence")
        back = e.where(F.col("target") == hit.id).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation", "confidence")
        return out.unionByName(back).join(self.graph.nodes.select("id", "label"), "id").select("direction", "id", "label", "relation", "confidence")

    def get_community(self, cid: int) -> DataFrame:
        """Q04."""
        return self.graph.nodes.where(F.col("community") == cid).select("id", "label", "source_file").orderBy("id")

    def god_nodes(self, n: int = 10) -> DataFrame:
        """Q05."""
        return W.god_nodes(self.graph.nodes, self.graph.edges, n)

    def graph_stats(self) -> DataFrame:
        """Q06, Q11: nodes, edges, communities and confidences."""
        counts = self.graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("community").alias("communities"))
        return counts.join(F.broadcast(A.confidence_histogram(self.graph.edges)))

    def shortest_path(self, source: str, target: str, max_hops: int = 8) -> DataFrame:
        """Q07, Q14: (step, id, label) between the best matches of two descriptions."""
        ends = [W.pick_endpoint(self.graph.nodes, q).first() for q in (source, target)]
        spark = self.graph.nodes.sparkSession
        if None in ends:
            return spark.createDataFrame([], "step int, id string, label string")
        path = T.shortest_path(self.graph.edges, ends[0].id, ends[1].id, max_hops)
        return path.join(self.graph.nodes.select("id", "label"), "id").select("step", "id", "label").orderBy("step")

    def list_prs(self, prs: DataFrame, now: str, base: str = "main") -> DataFrame:
        """Q08."""
        return prs.withColumn("status", A.pr_status(now, base))

    def pr_impact(self, prs: DataFrame) -> DataFrame:
        """Q09."""
        return A.pr_impact(prs, A.file_index(self.graph.nodes))

    def triage(self, prs: DataFrame, now: str, backend=None) -> DataFrame:
        """PRs by state and impact; a backend may add a word on each of the first hundred."""
        j = self.list_prs(prs, now).join(self.pr_impact(prs), "number", "left")
        if backend is None:
            return j.orderBy("status", F.desc("nodes"), "number")
        rows = j.orderBy("status", F.desc("nodes"), "number").limit(100).collect()
        return j.sparkSession.createDataFrame([(r.number, r.status, backend(r)) for r in rows], "number long, status string, note string")

    def surprises(self, n: int = 5) -> DataFrame:
        """Q12."""
        return W.surprising_connections(self.graph.nodes, self.graph.edges, n)

    def questions(self, n: int = 7) -> DataFrame:
        """Q13."""
        return W.suggest_questions(self.graph.nodes, self.graph.edges, A.cohesion(self.graph.edges, communities_of(self.graph.nodes)), n=n)

    def explain(self, label: str, n: int = 20) -> DataFrame | None:
        """Q15: the n best connected neighbours of a node."""
        near = self.get_neighbors(label)
        return None if near is None else near.join(A.degree_all(self.graph.edges), "id").orderBy(F.desc("degree"), "id").limit(n)

    def affected(self, query: str, depth: int = 3) -> DataFrame:
        """What depends on a node (id, depth, via, label)."""
        seed = W.resolve_seed(self.graph.nodes, query).first()
        if seed is None:
            raise ValueError(f"no single node matches {query!r}")
        return T.affected(self.graph.edges, seed.id, depth=depth).join(self.graph.nodes.select("id", "label"), "id").orderBy("depth", "id")

    def diagnose(self) -> DataFrame:
        """Q17."""
        return A.edge_diagnostics(self.graph.edges, self.graph.nodes)

    def reflect(self, memory: DataFrame, now: str) -> DataFrame:
        """Q18."""
        return A.lessons(A.dedupe_by_question(memory), now)

    def recluster(self, previous: DataFrame | None = None) -> DataFrame:
        """Q19: communities anew, numbered like the previous ones where they overlap (cid, node_id, label)."""
        from .operators.communities import cluster, keep_labels

        c = cluster(self.graph.nodes, self.graph.edges)
        c = keep_labels(c, previous) if previous is not None else c
        nodes = self.graph.nodes.drop("community").join(c.select(F.col("node_id").alias("id"), F.col("cid").alias("community")), "id")
        return c.join(W.hub_labels(nodes, self.graph.edges).select(F.col("community").alias("cid"), "label"), "cid")


