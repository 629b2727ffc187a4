"""Smaller operators of the inventory (Z rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import slices


def hyperedge_communities(hyperedges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, communities) that the members of each hyperedge belong to."""
    members = hyperedges.select("id", F.explode("nodes").alias("node_id"))
    return members.join(communities, "node_id").groupBy("id").agg(F.array_sort(F.collect_set("cid")).alias("communities"))


def lessons_fresh(notes: DataFrame, written_at: float) -> bool:
    """Whether no note (mtime) is newer than the lessons."""
    newest = notes.agg(F.max("mtime")).first()[0]
    return newest is None or newest <= written_at


def blast_radius(impact: DataFrame) -> DataFrame:
    """A line per PR about the nodes and communities it touches."""
    n, c = F.coalesce("nodes", F.lit(0)), F.size("communities")
    return impact.select("number", F.when(n == 0, "no graph impact").otherwise(F.concat(n, F.lit(" nodes in "), c, F.when(c == 1, " community").otherwise(" communities"))).alias("text"))


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a label, a file and a community under any of their names."""
    pick = lambda *names: F.coalesce(*[F.col(c) for c in names if c in nodes.columns], F.lit(None).cast("string"))
    return nodes.select("id", F.coalesce(pick("label", "name"), F.col("id")).alias("label"), F.coalesce(pick("source_file", "source", "file"), F.lit("")).alias("source_file"), F.coalesce(pick("file_type", "type"), F.lit("concept")).alias("file_type"))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Edges with their string fields present."""
    pick = lambda *names: F.coalesce(*[F.col(c).cast("string") for c in names if c in edges.columns], F.lit(""))
    return edges.select(pick("source", "from").alias("source"), pick("target", "to").alias("target"), pick("relation", "type").alias("relation"), pick("confidence").alias("confidence"), pick("context").alias("context"), pick("source_file").alias("source_file"), pick("source_location").alias("source_location"))


def common_root(paths: list[str]) -> str:
    """The folder that all paths share."""
    parts = [p.split("/")[:-1] for p in paths]
    shared = []
    for level in zip(*parts, strict=False):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return "/".join(shared)


def expand_oversized(files: DataFrame, limit: int) -> DataFrame:
    """(path, part, text): files cut into slices of at most limit characters."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, k, t[a:b]) for p, t in zip(pdf["path"], pdf["text"], strict=True) for k, (a, b) in enumerate(slices(t or "", limit))]
            yield pd.DataFrame(rows, columns=["path", "part", "text"])

    return files.select("path", "text").mapInPandas(run, "path string, part long, text string")


def bisect(text: str) -> tuple[str, str]:
    """Two halves of a text, cut at the line end nearest before the middle."""
    middle = len(text) // 2
    cut = text.rfind("\n", 0, middle) + 1 or middle
    return text[:cut], text[cut:]


def uncovered(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Files asked about that no result names."""
    return asked.join(answered.select("source_file").distinct(), "source_file", "left_anti")


def placeholder_labels(communities: DataFrame) -> DataFrame:
    """(cid, label) before anyone has named them."""
    return communities.select("cid").distinct().withColumn("label", F.concat(F.lit("Community "), "cid"))


def estimated_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Usage (model, input_tokens, output_tokens) at rates (model, input_rate, output_rate) a million tokens; 0 for unknown models."""
    j = usage.join(rates, "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("input_rate", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_rate", F.lit(0.0))) / 1e6
    return j.select("model", "input_tokens", "output_tokens", cost.alias("cost"))


def is_hollow(response: Column) -> Column:
    """A response without content."""
    return F.coalesce(F.trim(response), F.lit("")).isin("", "{}", "[]", "null")


def without_semantic_documents(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that no model-made document node already covers."""
    covered = nodes.where("file_type in ('document', 'paper') and coalesce(_origin, '') <> 'ast'").select("source_file").distinct()
    return files.join(covered, "source_file", "left_anti")


def rebase_paths(df: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Relative source files of one root as relative to a root above it."""
    above = old_root[len(new_root) :].strip("/") if old_root.startswith(new_root) else ""
    moved = F.concat(F.lit(above + "/"), "source_file") if above else F.col("source_file")
    absolute = F.startswith("source_file", F.lit("/")) | (F.coalesce("source_file", F.lit("")) == "")
    return df.withColumn("source_file", F.when(absolute, F.col("source_file")).otherwise(moved))


def suppression_sites(files: DataFrame) -> DataFrame:
    """(path, line, text) where code drops repeated edges while it makes them."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    return lines.where(F.col("text").rlike(r"(seen|existing|known)\w*\.(insert|contains|add|has)\s*\(.*(edge|pair|source|target)")).select("path", (F.col("no") + 1).alias("line"), F.trim("text").alias("text"))


def worktree_prs(trees: DataFrame, prs: DataFrame) -> DataFrame:
    """Worktrees with the PR of their branch, if any."""
    return trees.join(prs.select("branch", "number", "title"), "branch", "left")


def display_community(name: Column, number: Column) -> Column:
    """A community's name, or its number."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), number.cast("string"))


def community_header(name: Column, number: Column) -> Column:
    """The line above a community's members; a name that only repeats the number is left out."""
    base = F.concat(F.lit("Community "), number.cast("string"))
    clean = F.trim(F.coalesce(name, F.lit("")))
    return F.when((clean != "") & (clean != base), F.concat(base, F.lit(" \u2014 "), clean)).otherwise(base)


def with_learning(lines: DataFrame, lessons: DataFrame) -> DataFrame:
    """Node lines (id, line) with what is known about the node (id, standing, stale) behind them."""
    known = lessons.select("id", "standing", F.coalesce("stale", F.lit(False)).alias("stale"))
    suffix = F.concat(F.lit(" learning="), "standing", F.when(F.col("stale"), F.lit(":stale")).otherwise(F.lit("")))
    return lines.join(known, "id", "left").select("id", F.concat("line", F.coalesce(suffix, F.lit(""))).alias("line"))


def prefer_file_node(matches: DataFrame) -> DataFrame:
    """Of matches (key, id, source_file, source_location) within one file, the one on its first line; several files stay several."""
    per_file = matches.groupBy("key", "source_file").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("source_location") == "L1", 1)).alias("_first"))
    files = matches.groupBy("key").agg(F.count_distinct(F.coalesce("source_file", F.lit(""))).alias("_files"))
    j = matches.join(per_file, ["key", "source_file"]).join(files, "key")
    alone = (F.col("_files") == 1) & (F.col("_n") > 1) & (F.col("_first") == 1)
    return j.where(~alone | (F.col("source_location") == "L1")).select(matches.columns)


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """(source_file) of the files that new chunks speak about."""
    return chunks.where("coalesce(source_file, '') <> ''").select("source_file").distinct()


def merge_root(roots: list[str | None]) -> str | None:
    """The root that merged graphs share: the one all of them name, else the folder above all; None if one names none."""
    if not roots or any(r is None for r in roots):
        return None
    if len(set(roots)) == 1:
        return roots[0]
    return common_root([r.rstrip("/") + "/x" for r in roots]) or None


def resolves_under(path: str, root: str) -> bool:
    """Whether a path, its dots resolved, lies in root."""
    import posixpath

    base = posixpath.normpath(root)
    whole = posixpath.normpath(posixpath.join(base, path))
    return whole == base or whole.startswith(base.rstrip("/") + "/")


def known_nodes(nodes: DataFrame) -> DataFrame:
    """Every id and label by which a node may be cited (name)."""
    return nodes.select(F.col("id").alias("name")).union(nodes.select("label")).where("coalesce(name, '') <> ''").distinct()


def node_community_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node_id, label) of the community each node is in; one without a label goes by its number."""
    return members.join(labels.select("cid", "label"), "cid", "left").select("node_id", display_community(F.col("label"), F.col("cid")).alias("label"))


def flat_calls(files: DataFrame) -> DataFrame:
    """Z111: calls of files (source_file, raw_calls array of structs) as rows."""
    return files.select("source_file", F.explode("raw_calls").alias("call")).select("source_file", "call.*")


def source_key(path: Column) -> Column:
    """Z108: the identifier of a file that sets apart equal ids: its path without extension, in lower case, joined by underscores."""
    stem = F.regexp_replace(F.coalesce(path, F.lit("")), r"\.[^./]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def resolve_link(source: Column, target: Column) -> Column:
    """Z112: a relative link of a document as a path from the root; null for addresses, anchors and what leaves the root."""
    clean = F.regexp_replace(target, "[#?].*$", "")
    whole = F.when(F.startswith(clean, F.lit("/")), F.regexp_replace(clean, "^/+", "")).otherwise(F.concat(F.regexp_replace(source, "[^/]*$", ""), clean))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    step = lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
    path = F.aggregate(parts, none, step)
    return F.when((clean != "") & ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.array_contains(path, ".."), F.array_join(path, "/"))


def relativise(df: DataFrame, root: str) -> DataFrame:
    """Records whose source_file lies under root, relative to it; others stay as they are."""
    base = root.rstrip("/") + "/"
    inside = F.startswith("source_file", F.lit(base))
    return df.withColumn("source_file", F.when(inside, F.expr(f"substring(source_file, {len(base) + 1})")).otherwise(F.col("source_file")))


def word_counts(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, words) of files (path, text) through a cache (hash, words), and the cache with the new ones."""
    from .incremental import content_hash

    hashed = files.select("path", "text", content_hash(F.col("text")).alias("hash"))
    missing = hashed.join(cache.select("hash"), "hash", "left_anti")
    fresh = missing.select("hash", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long").alias("words")).dropDuplicates(["hash"])
    known = cache.select("hash", "words").unionByName(fresh)
    return hashed.select("path", "hash").join(known, "hash").select("path", "words"), known


def cached_files(cache: DataFrame) -> DataFrame:
    """(source_file) of what a cache holds rows of."""
    return cache.select("source_file").distinct()


def clear_cache(spark, path: str) -> None:
    """A cache's folder is dropped through Spark's file system; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def load_fragment(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Z102: nodes and edges of a fragment that pass validation, and the errors (kind, error) of the rest."""
    from ..schema import CONFIDENCES, FILE_TYPES
    from .filters import validate

    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    good = nodes.where(~lacks("id") & ~lacks("label") & F.col("file_type").isin(*FILE_TYPES))
    ids = good.select("id").distinct()
    kept = edges.where(F.col("confidence").isin(*CONFIDENCES) & ~lacks("relation"))
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return good, kept.select(edges.columns), validate(nodes, edges)


def name_communities(communities: DataFrame, backend, batch: int = 20) -> DataFrame:
    """(cid, label) from a backend that names batches of communities (cid, members array); what it leaves unnamed gets a placeholder."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                named = backend([(int(c), list(m)) for c, m in zip(part["cid"], part["members"], strict=True)]) or {}
                yield pd.DataFrame([(c, (named.get(int(c)) or "").strip() or f"Community {c}") for c in part["cid"]], columns=["cid", "label"])

    return communities.select("cid", "members").mapInPandas(run, "cid long, label string")


# Sections in order of priority and the words that speak for them.
ARCHETYPES = {
    "extract-pipeline": "extract extractor tree sitter parser language python javascript typescript rust java go ast calls imports multilang",
    "build-graph": "build graph merge dedup node edge hyperedge json schema normalize confidence",
    "analysis-clustering": "cluster community leiden cohesion analyze god surprise question query path explain benchmark",
    "outputs-docs": "export html wiki obsidian canvas svg graphml report callflow mermaid tree documentation",
    "cli-skills": "main install uninstall skill agent claude codex opencode aider copilot kiro vscode hook command",
    "ingest-cache-update": "ingest fetch download url html markdown cache manifest watch update incremental transcribe video audio google",
    "serve-api": "serve api request response endpoint router handle upload search delete enrich",
    "security-global": "security safe ssrf xss path traversal global prefix prune repo clone",
    "tests-fixtures": "test tests fixture fixtures sample assert pytest mock",
}
SPOKEN = 80  # nodes of a community whose words count, by the rule; a description, not a filter


def community_archetypes(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(community, section): the section that most words of its label and its first SPOKEN nodes speak for, two at least, else `other`."""
    from pyspark.sql import Window

    own = nodes.where("community is not null")
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy("community").orderBy("_ord", "id"))).where(F.col("_rn") <= SPOKEN)
    texts = first.select("community", F.concat_ws(" ", "label", "source_file", "file_type").alias("text"))
    if labels is not None:
        texts = texts.unionByName(labels.select(F.col("cid").alias("community"), F.col("label").alias("text")))
    spoken = texts.select("community", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    rows = [(w, k, i) for i, (k, ws) in enumerate(ARCHETYPES.items()) for w in ws.split()]
    known = nodes.sparkSession.createDataFrame(rows, "word string, section string, priority int")
    votes = spoken.join(F.broadcast(known), "word").groupBy("community", "section", "priority").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")  # the words of ARCHETYPES
    best = votes.groupBy("community").agg(F.min_by("section", F.struct(-F.col("n"), F.col("priority"))).alias("section"))
    return own.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("section", F.lit("other")).alias("section"))
