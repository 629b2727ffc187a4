"""Ranking, search and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, sanitize_label, search_text, top_level_dir, word_tokens
from .aggregate import degree_all, degree_endpoints
from .filters import BUILTIN_NOISE, cross_language, file_category, is_concept_node, is_file_node, is_json_key_node
from .scratch import written

EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of highest degree that are no file, concept, JSON key or builtin; ties by position."""
    ranked = nodes.join(degree_all(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = ranked.where(~is_file_node(F.col("degree")) & ~is_concept_node() & ~is_json_key_node() & ~F.coalesce("label", F.lit("")).isin(*BUILTIN_NOISE))
    return kept.orderBy(F.desc("degree"), "_ord").limit(n).select("id", F.coalesce("label", "id").alias("label"), F.col("degree").cast("bigint").alias("degree"))


def with_norm_label(nodes: DataFrame, ascii_labels: bool = False) -> DataFrame:
    """norm_label as stored, else derived. Prepare it once and store it; searches then need no Python."""
    derived = F.lower("label") if ascii_labels else search_text(F.col("label"))
    stored = F.nullif(F.col("norm_label"), F.lit("")) if "norm_label" in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn("norm_label", F.coalesce(stored, derived))


def _terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """The query's terms, a handful of rows."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(terms))], "term string, term_no int")


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, term_no, df, idf) with idf = ln(1 + N / (1 + df)); df counts labels that contain the term."""
    t = F.broadcast(_terms(nodes.sparkSession, terms))
    counts = nodes.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.contains("norm_label", F.lit(x)), 1)).alias(f"d{i}") for i, x in enumerate(dict.fromkeys(terms))])
    df = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(set(terms)))]), F.col("term_no") + 1)
    return t.join(counts).select("term", "term_no", df.alias("df"), F.log(1 + F.greatest("n", F.lit(1)) / (1.0 + df)).alias("idf"))


def score_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score, label_len) of the nodes that match, unordered; nodes need norm_label.

    The weights are one row, joined to every node; the terms become columns, not rows, so that a node
    is scored in one pass without a shuffle.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("label_len"))
    weights = idf(nodes, terms).agg(*[F.max(F.when(F.col("term_no") == i, F.col("idf"))).alias(f"_w{i}") for i in range(len(terms))], F.max("idf").alias("_joined_w"))
    j = nodes.join(F.broadcast(weights))
    norm, bare = F.col("norm_label"), F.regexp_replace("norm_label", r"[()]+$", "")
    tokens = F.array_join(word_tokens(F.col("norm_label")), " ")
    source = F.lower(F.coalesce("source_file", F.lit("")))
    whole = F.lit(" ".join(terms))
    any_of = lambda conds: reduce(lambda a, b: a | b, conds)
    full = F.when(any_of([norm == whole, bare == whole, tokens == whole, F.lower("id") == whole]), EXACT * 10 * F.col("_joined_w"))
    full = full.when(any_of([F.startswith(norm, whole), F.startswith(bare, whole), F.startswith(tokens, whole)]), PREFIX * 10 * F.col("_joined_w")).otherwise(0.0)
    tiered, plain, matched = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i, term in enumerate(terms):
        t, w = F.lit(term), F.col(f"_w{i}")
        exact, prefix, inside = (norm == t) | (bare == t), F.startswith(norm, t) | F.startswith(bare, t), F.contains(norm, t)
        tiered = tiered + F.when(exact, EXACT * w).when(prefix, PREFIX * w).otherwise(0.0)
        matched = matched + F.when(exact | prefix | inside, 1).otherwise(0)
        plain = plain + F.when(~exact & ~prefix & inside, SUBSTRING * w).otherwise(0.0) + F.when(F.contains(source, t), SOURCE * w).otherwise(0.0)
    coverage = matched / F.lit(float(len(terms)))
    score = full + plain + tiered * coverage * coverage
    length = F.char_length(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("id")))
    return j.select("id", "label", score.alias("score"), length.alias("label_len")).where("score > 0")


def ranked(scored: DataFrame) -> list:
    return [F.desc("score"), F.asc("label_len"), F.asc("id")]


def top_scored(scored: DataFrame, k: int) -> DataFrame:
    """The k best nodes with their rank."""
    best = scored.orderBy(*ranked(scored)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*ranked(best))))  # k rows


def pick_seeds(scored: DataFrame, k: int = 3, gap: float = 0.2) -> DataFrame:
    """The k best, cut where the score falls below gap times the best."""
    best = top_scored(scored, k)
    return best.withColumn("_top", F.max("score").over(Window.partitionBy())).where((F.col("rank") == 1) | (F.col("score") >= F.col("_top") * gap)).select("id", "score", "rank")


def pick_seeds_diverse(nodes: DataFrame, edges: DataFrame, terms: list[str], k: int = 3, gap: float = 0.2) -> DataFrame:
    """One seed per normalised label within the gap, and the best node of each term (ties by degree)."""
    scored = score_nodes(nodes, terms).join(nodes.select("id", "norm_label"), "id")
    w = Window.partitionBy("_key").orderBy(*ranked(scored))
    per_label = scored.withColumn("_key", F.coalesce(F.nullif(F.col("norm_label"), F.lit("")), F.col("id"))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    top = scored.agg(F.max("score").alias("_top"))
    main = top_scored(per_label.join(F.broadcast(top)).where(F.col("score") >= F.col("_top") * gap), k).select("id", "_key", F.col("rank").cast("int").alias("order"))
    out = main
    degrees = degree_endpoints(edges)
    for i, term in enumerate(sorted(set(terms))):
        one = score_nodes(nodes, [term]).join(nodes.select("id", F.coalesce(F.nullif(F.col("norm_label"), F.lit("")), F.col("id")).alias("_key")), "id")
        best = one.join(F.broadcast(one.agg(F.max("score").alias("_m"))), F.col("score") == F.col("_m")).join(degrees, "id", "left")
        best = best.orderBy(F.desc(F.coalesce("degree", F.lit(0))), "label_len", "id").limit(1).select("id", "_key", F.lit(k + 1 + i).alias("order"))
        out = out.unionByName(best)
    by_id, by_key = Window.partitionBy("id").orderBy("order"), Window.partitionBy("_key").orderBy("order")
    once = out.withColumn("_a", F.row_number().over(by_id)).where("_a = 1").withColumn("_b", F.row_number().over(by_key)).where("_b = 1")
    return once.select("id", "order")


def pick_endpoint(nodes: DataFrame, query: str) -> DataFrame:
    """The best node whose label holds every word of the query, else the best node."""
    terms = query_terms(query)
    scored = score_nodes(nodes, terms)
    words = word_tokens(F.lower("label"))
    full = F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), words)) == 0
    return scored.withColumn("full", full).orderBy(F.desc("full"), *ranked(scored)).limit(1).select("id", "score", "full")


def find_node(nodes: DataFrame, label: str) -> DataFrame:
    """Matches in tiers: exact path (the file's own node first), exact, prefix, substring."""
    term = " ".join(query_terms(label) or [label.lower()])
    query = label.strip().lower().replace("\\", "/")
    path, name = query.rstrip("/"), query.rstrip("/").rsplit("/", 1)[-1]
    norm, bare = F.col("norm_label"), F.regexp_replace("norm_label", r"[()]+$", "")
    tokens = F.array_join(word_tokens(F.col("norm_label")), " ")
    file = F.lower(F.replace(F.coalesce("source_file", F.lit("")), F.lit("\\"), F.lit("/")))
    tier = (
        F.when((file == path) & (file != "") & (norm == name), 0)
        .when((file == path) & (file != "") & F.coalesce(F.col("source_location") == "L1", F.lit(False)), 1)
        .when((file == path) & (file != ""), 2)
        .when((norm == query) | (bare == query) | (tokens == term) | (F.lower("id") == query), 3)
        .when(F.startswith(norm, F.lit(query)) | F.startswith(tokens, F.lit(term)), 4)
        .when(F.contains(norm, F.lit(query)) | F.contains(tokens, F.lit(term)), 5)
    )
    return nodes.withColumn("tier", tier).where("tier is not null").select("id", "label", "tier", "_ord").orderBy("tier", "_ord")


def resolve_seed(nodes: DataFrame, query: str) -> DataFrame:
    """The node of the first tier (id, label, bare label, file, contained) that has exactly one."""
    q = query.strip().lower()
    bare = F.regexp_replace(F.lower("label"), r"\(\)$", "")
    tests = [F.col("id") == query.strip(), F.lower("label") == q, F.ltrim(bare, F.lit(".")) == q, F.lower("source_file") == q, F.contains(F.lower("label"), F.lit(q))]
    tiers = F.filter(F.array(*[F.when(t, i) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    hits = nodes.select("id", F.explode(tiers).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return hits.orderBy("tier").limit(1).select("id", "tier")


def surprise_columns(edges: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Edges with their endpoints' labels, files, communities and degrees (u_*, v_*), concepts and file nodes flagged."""
    def side(p: str) -> DataFrame:
        j = nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        return j.select(
            F.col("id").alias(p), F.coalesce("label", "id").alias(f"{p}_label"), F.coalesce("source_file", F.lit("")).alias(f"{p}_file"), F.col("community").alias(f"{p}_community"),
            F.col("degree").alias(f"{p}_degree"), (is_concept_node() | is_file_node(F.col("degree"))).alias(f"{p}_skip"),
        )

    return edges.withColumnRenamed("source", "u").withColumnRenamed("target", "v").join(side("u"), "u").join(side("v"), "v")


def surprise_score() -> Column:
    """W09 over the columns of surprise_columns."""
    conf, rel = F.coalesce("confidence", F.lit("EXTRACTED")), F.coalesce("relation", F.lit(""))
    cu, cv = file_category(F.col("u_file")), file_category(F.col("v_file"))
    code_doc = ((cu == "code") != (cv == "code")) & ((cu == "doc") | (cv == "doc"))
    hushed = (conf == "INFERRED") & rel.isin("calls", "uses") & (cross_language(F.col("u_file"), F.col("v_file")) | code_doc)
    add = lambda cond, n: F.when(cond & ~hushed, n).otherwise(0)
    base = F.when(hushed, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    base = base + add(cu != cv, 2) + add(top_level_dir(F.col("u_file")) != top_level_dir(F.col("v_file")), 2)
    base = base + add(F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False)), 1)
    base = F.when(rel == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base)
    far = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    return (base + F.when(far, 1).otherwise(0)).cast("int")


def cross_file_surprises(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n most surprising edges between files."""
    j = surprise_columns(edges.where(~F.coalesce("relation", F.lit("")).isin(*STRUCTURAL)), nodes, degree_all(edges))
    kept = j.where("not u_skip and not v_skip and u_file <> '' and v_file <> '' and u_file <> v_file").withColumn("score", surprise_score())
    return kept.orderBy(F.desc("score"), "_ord").limit(n).select("u", "v", "u_label", "v_label", "relation", "confidence", "score")


def confidence_rank(c: Column) -> Column:
    """AMBIGUOUS first."""
    return F.when(c == "AMBIGUOUS", 0).when(c == "INFERRED", 1).otherwise(2)


def cross_community_surprises(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """One edge per pair of communities, the least certain first."""
    j = surprise_columns(edges.where(~F.coalesce("relation", F.lit("")).isin(*STRUCTURAL)), nodes, degree_all(edges))
    pair = j.where("not u_skip and not v_skip and u_community <> v_community").withColumn("cu", F.least("u_community", "v_community")).withColumn("cv", F.greatest("u_community", "v_community"))
    best = pair.groupBy("cu", "cv").agg(F.min_by(F.struct("u", "v", "relation", "confidence", "_ord"), F.struct(confidence_rank(F.col("confidence")), "_ord")).alias("e"))
    return best.select("cu", "cv", "e.*").orderBy(confidence_rank(F.col("confidence")), "_ord").limit(n).select("cu", "cv", "u", "v", "relation", "confidence")


def surprising_connections(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Across files if there are several, and across communities if that finds none."""
    across_files = nodes.where("coalesce(source_file, '') <> ''").select("source_file").distinct().limit(2).count() > 1
    if across_files:
        found = cross_file_surprises(nodes, edges, n)
        if not found.limit(1).isEmpty():
            return found.select("u", "v", "relation", "confidence")
    return cross_community_surprises(nodes, edges, n).select("u", "v", "relation", "confidence")


def _question(df: DataFrame, kind: str, question: Column, why: Column, order) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), question.alias("question"), why.alias("why"), order.alias("position"))


def questions_ambiguous(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """W14."""
    names = lambda p: nodes.select(F.col("id").alias(p), F.coalesce("label", "id").alias(f"{p}_label"))
    j = edges.where("confidence = 'AMBIGUOUS'").withColumnRenamed("source", "u").withColumnRenamed("target", "v").join(names("u"), "u").join(names("v"), "v")
    return _question(
        j, "ambiguous_edge", F.format_string("What is the exact relationship between `%s` and `%s`?", "u_label", "v_label"),
        F.format_string("Edge tagged AMBIGUOUS (relation: %s) - confidence is low.", F.coalesce("relation", F.lit("related to"))), F.col("_ord"),
    )


def questions_bridges(nodes: DataFrame, edges: DataFrame, centrality: DataFrame, n: int = 3) -> DataFrame:
    """The n most central nodes that border on other communities."""
    j = nodes.join(degree_all(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(centrality, "id")
    # Written, as it is used twice: degrees and paths of the whole graph stand behind n rows.
    top = written(j.where(~is_file_node(F.col("degree")) & ~is_concept_node() & (F.col("betweenness") > 0)).orderBy(F.desc("betweenness"), "_ord").limit(n).select("id", "label", "community", "betweenness", "_ord"))
    both = edges.select("source", "target").union(edges.select("target", "source")).toDF("id", "other")
    near = both.join(F.broadcast(top.select("id", F.col("community").alias("own"))), "id").join(nodes.select(F.col("id").alias("other"), F.col("community").alias("c")), "other")
    near = near.where("c is not null and not (c <=> own)").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("c")), lambda c: F.concat(F.lit("`Community "), c, F.lit("`"))), ", ").alias("others"))
    q = top.join(near, "id").withColumn("own_name", F.coalesce(F.concat(F.lit("Community "), F.col("community")), F.lit("unknown")))
    return _question(q, "bridge_node", F.format_string("Why does `%s` connect `%s` to %s?", "label", "own_name", "others"), F.format_string("High betweenness centrality (%.3f) - this node is a cross-community bridge.", "betweenness"), F.col("_ord"))


def questions_inferred(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Of the n nodes of highest degree, those with two inferred edges or more."""
    j = nodes.join(degree_all(edges), "id").where(~is_file_node(F.col("degree"))).orderBy(F.desc("degree"), nodes["_ord"]).limit(n).select("id", "label", F.col("_ord").alias("_pos"), "degree")
    guess = edges.where("confidence = 'INFERRED'")
    ends = guess.select(F.col("source").alias("id"), F.col("target").alias("other"), "_ord").union(guess.where("source <> target").select("target", "source", "_ord"))
    names = nodes.select(F.col("id").alias("other"), F.coalesce("label", "id").alias("other_label"))
    hits = ends.join(F.broadcast(j), "id").join(names, "other")
    w = Window.partitionBy("id").orderBy("_ord")
    g = hits.withColumn("_rn", F.row_number().over(w)).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("count >= 2 and _rn <= 2")
    q = g.groupBy("id", "label", "count", "degree", "_pos").agg(F.max(F.when(F.col("_rn") == 1, F.col("other_label"))).alias("o1"), F.max(F.when(F.col("_rn") == 2, F.col("other_label"))).alias("o2"))
    return _question(
        q, "verify_inferred", F.format_string("Are the %d inferred relationships involving `%s` (e.g. with `%s` and `%s`) actually correct?", "count", "label", "o1", "o2"),
        F.format_string("`%s` has %d INFERRED edges - model-reasoned connections that need verification.", "label", "count"), F.col("_pos"),
    )


def questions_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One question that names three weakly connected nodes."""
    from .aggregate import isolated_nodes

    alone = isolated_nodes(nodes, degree_all(edges, nodes))
    first = alone.orderBy("_ord").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "label"))), lambda s: F.concat(F.lit("`"), s["label"], F.lit("`"))), ", ").alias("names"))
    q = alone.agg(F.count(F.lit(1)).alias("n")).where("n > 0").join(F.broadcast(first))
    return _question(q, "isolated_nodes", F.format_string("What connects %s to the rest of the system?", "names"), F.format_string("%d weakly-connected nodes found - possible documentation gaps or missing edges.", "n"), F.lit(0).cast("bigint"))


def questions_low_cohesion(scores: DataFrame) -> DataFrame:
    """Communities of five or more with cohesion below 0.15; scores as cohesion() gives them."""
    low = scores.where("cohesion < 0.15 and members >= 5")
    return _question(
        low, "low_cohesion", F.concat(F.lit("Should `Community "), F.col("cid"), F.lit("` be split into smaller, more focused modules?")),
        F.concat(F.lit("Cohesion score "), F.regexp_replace(F.round("cohesion", 6).cast("decimal(12,6)").cast("string"), r"\.?0+$", ""), F.lit(" - nodes in this community are weakly interconnected.")), F.col("cid").cast("bigint"),
    )


def suggest_questions(nodes: DataFrame, edges: DataFrame, scores: DataFrame, centrality: DataFrame | None = None, n: int = 7) -> DataFrame:
    """The generators' questions one after the other, the first n."""
    parts = [questions_ambiguous(nodes, edges)]
    if centrality is not None:
        parts.append(questions_bridges(nodes, edges, centrality))
    parts += [questions_inferred(nodes, edges), questions_isolated(nodes, edges), questions_low_cohesion(scores)]
    stacked = reduce(DataFrame.unionByName, [p.orderBy("position", "question").limit(n).withColumn("section", F.lit(i)) for i, p in enumerate(parts)])
    return stacked.orderBy("section", "position", "question").limit(n).select("section", "type", "question", "why")


def hub_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community the label of its node of highest degree (self-loops twice); ties by id."""
    j = nodes.where("community is not null").join(degree_endpoints(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return j.groupBy("community").agg(F.min_by(F.struct("id", "label", "degree"), F.struct((-F.col("degree")).alias("d"), F.col("id"))).alias("h")).select("community", "h.id", "h.label", F.col("h.degree").cast("bigint").alias("degree"))


def diagram_nodes(nodes: DataFrame, edges: DataFrame, per_section: int = 12) -> DataFrame:
    """The best connected nodes of each community."""
    j = nodes.where("community is not null").join(degree_all(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_section).select("community", "id", "label", "degree", "rank")


def section_keywords(nodes: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent words of each community's labels."""
    words = nodes.where("community is not null").select("community", F.explode(word_tokens(F.lower("label"))).alias("word")).where(F.char_length("word") > 2)
    w = Window.partitionBy("community").orderBy(F.desc("n"), "word")
    return words.groupBy("community", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sorted_edges(edges: DataFrame) -> DataFrame:
    """W22."""
    return edges.orderBy("source", "target", "relation", "_ord")


def node_lines(nodes: DataFrame) -> Column:
    community = F.coalesce(F.nullif(F.col("community_name"), F.lit("")), F.col("community").cast("string")) if "community_name" in nodes.columns else F.col("community").cast("string")
    return F.concat(F.lit("NODE "), sanitize_label(F.coalesce("label", "id")), F.lit(" [src="), sanitize_label(F.col("source_file")), F.lit(" loc="), sanitize_label(F.col("source_location")), F.lit(" community="), sanitize_label(community), F.lit("]"))


def within_budget(lines: DataFrame, order: list[str], token_budget: int) -> DataFrame:
    """The first lines, in order, that fit a budget of three characters a token."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.sum(F.char_length("line") + 1).over(w)
    return lines.withColumn("used", cost).where(F.col("used") - 1 <= token_budget * 3)


def pack_chunks(units: DataFrame, budget: int, images_per_chunk: int = 20) -> DataFrame:
    """Units (path, tokens, is_image) in order of directory and path to chunks, greedily.

    The rule is one pass over all units and resets at every chunk, so it is sequential: the sizes of
    all units (a path, a number and a flag each, no texts) go through one worker.
    """
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["directory", "path"])
        chunk, used, images, out = 0, 0, 0, []
        for tokens, image in zip(pdf["tokens"], pdf["is_image"], strict=True):
            if out and (used + tokens > budget or images + int(image) > images_per_chunk) and used:
                chunk, used, images = chunk + 1, 0, 0
            used, images = used + tokens, images + int(image)
            out.append(chunk)
        return pdf.assign(chunk=out)[["path", "chunk"]]

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return units.select("path", "tokens", "is_image", directory.alias("directory")).groupBy(F.lit("all")).applyInPandas(pack, "path string, chunk long")


def slices(text: str, limit: int) -> list[tuple[int, int]]:
    """Cuts of a long text, at the last heading, else blank line, else line end before the limit."""
    out, at = [], 0
    while len(text) - at > limit:
        window = text[at : at + limit]
        cut = next((p + 1 for mark in ("\n#", "\n\n", "\n") if (p := window.rfind(mark, limit // 4)) > 0), limit)
        out.append((at, at + cut))
        at += cut
    return [*out, (at, len(text))]
