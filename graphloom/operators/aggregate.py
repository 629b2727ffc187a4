"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, parse_date
from .filters import is_concept_node, is_file_node, path_match
from .scratch import written


def degree_all(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree), self-loops once; with nodes, those without edges count 0."""
    ends = edges.select(F.explode(F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))).alias("id"))
    return _with_all(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), nodes)


def degree_endpoints(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree), self-loops twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return _with_all(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), nodes)


def _with_all(degrees: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        return degrees
    return nodes.select("id").join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def percentile_pick(degrees: DataFrame, share: float) -> DataFrame:
    """One row (threshold): the degree at index floor(n * share) of the ascending order, by counts per degree."""
    by_degree = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))  # few rows: distinct degrees
    w = Window.orderBy("degree")
    runs = by_degree.select("degree", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    index = F.least(F.floor(F.col("total") * F.lit(share)), F.col("total") - 1)
    return runs.where(F.col("upto") > index).agg(F.min("degree").alias("threshold"))


def hub_threshold(degrees: DataFrame, least: int = 50) -> DataFrame:
    """max(50, the degree at the 99th percentile)."""
    return percentile_pick(degrees, 0.99).select(F.greatest(F.coalesce("threshold", F.lit(0)), F.lit(least)).cast("bigint").alias("threshold"))


def hub_nodes(degrees: DataFrame, percentile: float) -> DataFrame:
    """Nodes whose degree is strictly above the percentile's."""
    return degrees.join(F.broadcast(percentile_pick(degrees, percentile / 100)), F.col("degree") > F.col("threshold")).select("id", "degree")


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """Counts and rounded percentages of the three confidences; others count in the total only."""
    n = lambda c: F.count(F.when(F.col("confidence") == c, 1))
    t = edges.agg(F.count(F.lit(1)).alias("edges"), *[n(c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    share = lambda c: F.coalesce(F.floor(F.col(c) * 100.0 / F.greatest(F.col("edges"), F.lit(1)) + 0.5), F.lit(0)).cast("bigint").alias(f"{c}_pct")
    return t.select("*", share("extracted"), share("inferred"), share("ambiguous"))


def confidence_stats(edges: DataFrame) -> DataFrame:
    """Truncated percentages, missing confidence counting as EXTRACTED, and the mean score of inferred edges."""
    c = F.coalesce("confidence", F.lit("EXTRACTED"))
    score = F.coalesce("confidence_score", F.lit(0.5)) if "confidence_score" in edges.columns else F.lit(0.5)
    n = lambda k: F.count(F.when(c == k, 1))
    t = edges.agg(F.count(F.lit(1)).alias("edges"), *[n(k).alias(k.lower()) for k in ("EXTRACTED", "INFERRED", "AMBIGUOUS")], F.round(F.avg(F.when(c == "INFERRED", score)), 2).alias("inferred_mean"))
    share = lambda k: F.floor(F.col(k) * 100 / F.greatest(F.col("edges"), F.lit(1))).cast("bigint").alias(f"{k}_pct")
    return t.select("*", share("extracted"), share("inferred"), share("ambiguous"))


def cohesion(edges: DataFrame, communities: DataFrame, directed: bool = True) -> DataFrame:
    """(cid, members, intra_edges, cohesion) of every community."""
    size = communities.groupBy("cid").agg(F.count(F.lit(1)).alias("members"))
    s = communities.select(F.col("node_id").alias("source"), F.col("cid").alias("cs"))
    t = communities.select(F.col("node_id").alias("target"), F.col("cid").alias("ct"))
    inside = edges.select("source", "target").join(s, "source").join(t, "target").where("cs = ct")
    if directed:
        inside = inside.select("cs", F.least("source", "target"), F.greatest("source", "target")).distinct()
    intra = inside.groupBy(F.col("cs").alias("cid")).agg(F.count(F.lit(1)).alias("intra_edges"))
    n, e = F.col("members"), F.coalesce("intra_edges", F.lit(0))
    return size.join(intra, "cid", "left").select("cid", "members", e.cast("bigint").alias("intra_edges"), F.when(n <= 1, F.lit(1.0)).otherwise(e / (n * (n - 1) / 2.0)).alias("cohesion"))


def exact_signature(edges: DataFrame, columns: list[str]) -> Column:
    """A hash of an edge's fields, in sorted order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def edge_diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What collapsing parallel edges would lose, as one row of counters."""
    fields = [c for c in edges.columns if not c.startswith("_")]
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    total = edges.agg(F.count(F.lit(1)).alias("raw_edges"), F.count(F.when(F.col("source") == F.col("target"), 1)).alias("self_loops"), F.count(F.when(F.coalesce("source", F.lit("")) == "", 1)).alias("missing_source"), F.count(F.when(F.coalesce("target", F.lit("")) == "", 1)).alias("missing_target"))
    live = edges.join(ids, edges["source"] == ids["_id"], "left_semi").join(ids, edges["target"] == ids["_id"], "left_semi")
    # One row per different edge; what follows adds up its count.
    exact = written(live.groupBy(*fields).agg(F.count(F.lit(1)).alias("c")), "edge-variants")
    extra = lambda df, name: df.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(name))
    summed = lambda *keys: exact.groupBy(*keys).agg(F.sum("c").alias("c"))
    pairs = exact.groupBy("source", "target").agg(F.count_distinct("relation").alias("relations"), F.count(F.lit(1)).alias("variants"), F.sum("c").alias("c"))
    groups = pairs.agg(
        F.count(F.lit(1)).alias("directed_pairs"),
        F.count(F.when(F.col("relations") > 1, 1)).alias("relation_variant_groups"),
        F.count(F.when(F.col("variants") > 1, 1)).alias("variant_groups"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("directed_collapse"),
    )
    parts = [
        exact.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("live_edges")),
        groups,
        extra(exact, "exact_duplicates"),
        extra(summed(F.least("source", "target"), F.greatest("source", "target")), "undirected_collapse"),
        extra(summed("source", "target", "relation"), "same_relation_collapse"),
    ]
    out = total
    for p in parts:  # single rows, so that this joins one row to one row
        out = out.join(F.broadcast(p))
    return out.withColumn("dangling_edges", F.col("raw_edges") - F.col("live_edges"))


def decay(date: Column, now: str, half_life_days: float = 30.0) -> Column:
    """0.5 to the power of age over half-life; 1 without a date or for a future one."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(parse_date(date))) / 86400.0
    return F.when(age.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(half_life_days)))


def dedupe_by_question(memory: DataFrame) -> DataFrame:
    """The latest document of each question."""
    w = Window.partitionBy(F.lower(F.trim("question"))).orderBy(F.desc("_ord"))
    return memory.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lessons(memory: DataFrame, now: str, half_life_days: float = 30.0, min_positive: int = 2) -> DataFrame:
    """Per cited node its decayed signed score, counts, last date and standing."""
    sign = F.when(F.col("outcome") == "useful", 1.0).when(F.col("outcome") == "dead_end", -1.0).otherwise(0.0)
    cited = memory.select(F.explode(F.array_distinct("source_nodes")).alias("node"), "date", sign.alias("sign"), decay(F.col("date"), now, half_life_days).alias("w"))
    agg = cited.groupBy("node").agg(
        F.round(F.sum(F.col("sign") * F.col("w")), 9).alias("score"),
        F.count(F.when(F.col("sign") > 0, 1)).alias("positive"),
        F.count(F.when(F.col("sign") < 0, 1)).alias("negative"),
        F.max("date").alias("last"),
    )
    standing = F.when((F.col("positive") > 0) & (F.col("negative") > 0), "contested").when(F.col("positive") >= min_positive, "preferred").when(F.col("positive") > 0, "tentative").when(F.col("negative") > 0, "avoid")
    return agg.withColumn("standing", standing).where("standing is not null")


def document_community(citations: DataFrame, node_community: DataFrame) -> DataFrame:
    """(doc_id, community) by plurality of cited nodes; ties go to the smallest label."""
    counts = citations.join(node_community, citations["node"] == node_community["id"]).groupBy("doc_id", "community").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "community")
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("doc_id", "community", "n")


def provenance(citations: DataFrame, n: int = 5) -> DataFrame:
    """The latest n questions that cite a node (node, date, question, rank)."""
    w = Window.partitionBy("node").orderBy(F.desc("date"), F.desc("question"))
    return citations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("node", "date", "question", "rank")


def file_index(nodes: DataFrame) -> DataFrame:
    """Per file its node count and communities."""
    return nodes.where("coalesce(source_file, '') <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("node_count"), F.array_sort(F.collect_set("community")).alias("communities"))


def pr_impact(prs: DataFrame, index: DataFrame) -> DataFrame:
    """Per PR the nodes and communities of the files it touches, each file once.

    Paths match if equal or if one ends with the other; such pairs have equal names, so the join is
    on the name and the suffix test follows.
    """
    changed = prs.select("number", F.explode(F.array_distinct("files_changed")).alias("_changed")).withColumn("_name", basename(F.col("_changed")))
    known = index.withColumn("_name", basename(F.col("source_file")))
    hit = changed.join(known, "_name").where(path_match(F.col("source_file"), F.col("_changed"))).select("number", "source_file", "node_count", "communities").dropDuplicates(["number", "source_file"])
    return hit.groupBy("number").agg(F.sum("node_count").alias("nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("communities")))).alias("communities"))


def community_labels(nodes: DataFrame, n: int = 5) -> DataFrame:
    """The first n labels of each community."""
    w = Window.partitionBy("community").orderBy("_ord")
    first = nodes.where("community is not null").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "label"))), lambda s: s["label"]), ", ").alias("labels"))


def ci_rollup(checks: Column) -> Column:
    """FAILURE before PENDING before SUCCESS; NONE without checks."""
    has = lambda *v: F.exists(checks, lambda x: F.upper(x).isin(*v))
    return F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, "NONE").when(has("FAILURE", "ERROR", "CANCELLED", "TIMED_OUT"), "FAILURE").when(has("PENDING", "IN_PROGRESS", "QUEUED"), "PENDING").otherwise("SUCCESS")


def pr_status(now: str, base: str = "main", stale_days: int = 14) -> Column:
    """The state of a PR, by the first rule that applies."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("updated_at")) / 86400.0
    return (
        F.when(F.col("base_branch") != base, "wrong_base")
        .when(F.col("ci_status") == "FAILURE", "ci_failing")
        .when(F.col("review_decision") == "CHANGES_REQUESTED", "changes_requested")
        .when(F.col("is_draft"), "draft")
        .when(age >= stale_days, "stale")
        .when(F.col("ci_status") == "PENDING", "pending")
        .when(F.col("review_decision") == "APPROVED", "approved")
        .otherwise("ready")
    )


def pr_conflicts(impact: DataFrame) -> DataFrame:
    """Communities that more than one PR touches."""
    return impact.select("number", F.explode("communities").alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("number")).alias("prs")).where("n > 1")


def path_rollup(nodes: DataFrame) -> DataFrame:
    """Per directory and file the nodes below it."""
    parts = F.split(F.col("source_file"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return nodes.where("coalesce(source_file, '') <> ''").select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("nodes"))


def meta_graph(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges between communities (cu < cv) and their number."""
    s = communities.select(F.col("node_id").alias("source"), F.col("cid").alias("cs"))
    t = communities.select(F.col("node_id").alias("target"), F.col("cid").alias("ct"))
    across = edges.select("source", "target").join(s, "source").join(t, "target").where("cs <> ct")
    return across.groupBy(F.least("cs", "ct").alias("cu"), F.greatest("cs", "ct").alias("cv")).agg(F.count(F.lit(1)).alias("edges"))


def dominant_confidence(edges: DataFrame) -> DataFrame:
    """Per node the most frequent confidence of its edges; ties go to the surer one."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "confidence")
    rank = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    w = Window.partitionBy("id").orderBy(F.desc("n"), rank)
    return ends.groupBy("id", "confidence").agg(F.count(F.lit(1)).alias("n")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "confidence", "n")


def community_reach(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Per node the number of communities among its neighbours."""
    both = edges.select("source", "target").union(edges.select("target", "source")).toDF("id", "other")
    c = communities.select(F.col("node_id").alias("other"), "cid")
    return both.join(c, "other").groupBy("id").agg(F.count_distinct("cid").alias("reach"))


def isolated_nodes(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Nodes of degree 1 or less that are no file, concept or rationale."""
    j = nodes.join(degrees, "id")
    return j.where((F.col("degree") <= 1) & ~is_file_node(F.col("degree")) & ~is_concept_node() & (F.coalesce("file_type", F.lit("")) != "rationale"))


def thin_communities(communities: DataFrame, below: int = 3) -> DataFrame:
    """The communities with fewer members than `below`."""
    return communities.groupBy("cid").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") < below)


def member_signatures(communities: DataFrame) -> DataFrame:
    """Per community a short hash of its sorted members."""
    ids = F.array_join(F.array_sort(F.collect_list("node_id")), "\0")
    return communities.groupBy("cid").agg(F.substring(F.sha2(F.concat(ids, F.lit("\0")), 256), 1, 16).alias("signature"))


def corpus_totals(files: DataFrame) -> DataFrame:
    """Files and words in all, and whether that is little or much."""
    t = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return t.withColumn("advice", F.when(F.col("words") < 50_000, "small").when((F.col("words") > 500_000) | (F.col("files") > 500), "large").otherwise("fine"))
