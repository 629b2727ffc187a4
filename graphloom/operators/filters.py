"""Predicates and filters (F01-F18) and language families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension
from ..schema import CONFIDENCES, EDGE_REQUIRED, FILE_TYPES, NODE_REQUIRED

# Labels of JSON keys that carry no meaning.
JSON_NOISE = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version",
    "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies",
)
# Builtin and mock names.
BUILTIN_NOISE = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False", "MagicMock", "Mock", "AsyncMock",
    "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
)
# Extensions by language family, as the analysis stage has them.
ANALYSIS_FAMILIES = {
    "python": ".py .pyw",
    "js": ".js .jsx .mjs .cjs .ejs .ts .tsx .mts .cts .vue .svelte",
    "go": ".go",
    "rust": ".rs",
    "jvm": ".java .kt .kts .scala",
    "c": ".c .h .cpp .cc .cxx .hpp .cu .cuh .metal",
    "ruby": ".rb",
    "swift": ".swift",
    "dotnet": ".cs",
    "php": ".php",
    "r": ".r",
}
# Extensions by language family, as the build stage has them.
BUILD_FAMILIES = {
    "py": ".py",
    "js": ".js .jsx .mjs .cjs .ts .tsx .mts .cts",
    "go": ".go",
    "rs": ".rs",
    "jvm": ".java .kt .scala .groovy",
    "c": ".c .h .cpp .cc .cxx .hpp .m .mm",
    "rb": ".rb",
    "php": ".php",
    "cs": ".cs",
    "swift": ".swift",
    "lua": ".lua",
}
# Words of a question that hint at an edge context, and other names of contexts.
CONTEXT_HINTS = {
    "call": "call calls called invoke invokes invoked",
    "import": "import imports imported module modules",
    "field": "field fields member members property properties",
    "parameter_type": "parameter parameters param params argument arguments",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
}


def language_family(path: Column, families: dict[str, str] = ANALYSIS_FAMILIES) -> Column:
    """The language family of a path's extension; null if unknown."""
    ext = extension(path)
    out = None
    for family, exts in families.items():
        hit = ext.isin(*exts.split())
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def cross_language(a: Column, b: Column) -> Column:
    """Both families known and different."""
    return F.coalesce(language_family(a) != language_family(b), F.lit(False))


def has_extension(path: Column) -> Column:
    return F.coalesce(F.contains(basename(path), F.lit(".")), F.lit(False))


def is_file_node(degree: Column, label: Column | None = None, source_file: Column | None = None) -> Column:
    """label equals the file's name, is a method stub, or a function stub of degree 1 or less."""
    label = F.coalesce(F.col("label") if label is None else label, F.lit(""))
    file = F.coalesce(F.col("source_file") if source_file is None else source_file, F.lit(""))
    stub = F.endswith(label, F.lit("()"))
    return (label != "") & (((file != "") & (label == basename(file))) | (F.startswith(label, F.lit(".")) & stub) | (stub & (degree <= 1)))


def is_concept_node(source_file: Column | None = None) -> Column:
    """no file, or a file name without a dot."""
    file = F.coalesce(F.col("source_file") if source_file is None else source_file, F.lit(""))
    return (file == "") | ~has_extension(file)


def is_json_key_node(label: Column | None = None, source_file: Column | None = None) -> Column:
    """F03."""
    label = F.col("label") if label is None else label
    file = F.coalesce(F.col("source_file") if source_file is None else source_file, F.lit(""))
    return F.endswith(F.lower(file), F.lit(".json")) & F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*JSON_NOISE)


def file_category(path: Column) -> Column:
    """Code, paper, image or doc, by extension."""
    ext = extension(path)
    code = [x for f in ANALYSIS_FAMILIES.values() for x in f.split()] + [".sql", ".lua", ".sh", ".json", ".zig", ".dart", ".ex", ".jl", ".m", ".ps1"]
    return F.when(ext.isin(*code), "code").when(ext == ".pdf", "paper").when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"), "image").otherwise("doc")


def context_alias(name: str) -> str:
    """The context that a word stands for, or the word itself."""
    word = name.strip().lower()
    return next((c for c, words in CONTEXT_HINTS.items() if word in words.split()), "attribute" if word == "decorator" else word)


def normalize_context_filters(filters: list[str] | None) -> list[str]:
    """distinct contexts by alias, in order."""
    return list(dict.fromkeys(context_alias(f) for f in filters or [] if f.strip()))


def infer_context_filters(question: str) -> list[str]:
    """contexts at which words of the question hint."""
    import re

    words = set(re.findall(r"\w+", question.lower()))
    return [c for c, hints in CONTEXT_HINTS.items() if words & set(hints.split())]


def resolve_context_filters(question: str, explicit: list[str] | None = None) -> list[str]:
    """explicit filters count before inferred ones."""
    return normalize_context_filters(explicit) or infer_context_filters(question)


def filter_by_context(edges: DataFrame, filters: list[str]) -> DataFrame:
    """edges of the given contexts; all if there are none."""
    return edges.where(F.col("context").isin(*filters)) if filters else edges


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose endpoints both exist."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return edges.join(ids, edges["source"] == ids["_id"], "left_semi").join(ids, edges["target"] == ids["_id"], "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that F08 drops, with the endpoint that is missing (the source, if both are)."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    no_source = edges.join(ids, edges["source"] == ids["_id"], "left_anti").withColumn("missing", F.col("source"))
    rest = edges.join(ids, edges["source"] == ids["_id"], "left_semi")
    return no_source.unionByName(rest.join(ids, rest["target"] == ids["_id"], "left_anti").withColumn("missing", F.col("target")))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """one row (kind, ref, error) per violation of the schema."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    row = lambda df, kind, ref, error: df.select(F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), error.alias("error"))
    pair = F.concat_ws("->", "source", "target")
    out = [row(nodes.where(F.col(c).isNull() if c == "source_file" else blank(c)), "node", F.coalesce("id", F.lit("?")), F.lit(f"missing {c}")) for c in NODE_REQUIRED]
    out.append(row(nodes.where(~F.col("file_type").isin(*FILE_TYPES)), "node", F.col("id"), F.concat(F.lit("invalid file_type "), F.col("file_type"))))
    out += [row(edges.where(F.col(c).isNull() if c == "source_file" else blank(c)), "edge", pair, F.lit(f"missing {c}")) for c in EDGE_REQUIRED]
    out.append(row(edges.where(~F.col("confidence").isin(*CONFIDENCES)), "edge", pair, F.concat(F.lit("invalid confidence "), F.col("confidence"))))
    out.append(row(dangling(edges, nodes), "edge", pair, F.concat(F.lit("unknown node "), F.col("missing"))))
    return reduce(DataFrame.unionByName, out)


def assert_valid(nodes: DataFrame, edges: DataFrame) -> None:
    """raises on the first violations."""
    found = validate(nodes, edges).take(10)
    if found:
        raise ValueError("invalid extraction: " + "; ".join(f"{r.kind} {r.ref}: {r.error}" for r in found))


def path_match(a: Column, b: Column) -> Column:
    """equal paths, or one ends with a slash and the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def live_members(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """community members that still exist."""
    return communities.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select(communities.columns)


def in_scope(results: DataFrame, files: DataFrame) -> DataFrame:
    """results of files that were asked about."""
    return results.join(files.select("source_file").distinct(), "source_file", "left_semi").select(results.columns)


FRAGMENT_ID = r"^[A-Za-z0-9._:-]+$"


def validate_fragment(nodes: DataFrame, edges: DataFrame, max_nodes: int = 2000, max_edges: int = 5000) -> DataFrame:
    """violations of the limits on a semantic fragment."""
    over = lambda df, n, what: df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n).select(F.lit(what).alias("kind"), F.col("n").cast("string").alias("ref"), F.lit(f"more than {n}").alias("error"))
    bad_id = nodes.where(~F.coalesce(F.col("id"), F.lit("")).rlike(FRAGMENT_ID) | (F.char_length("id") > 256)).select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.lit("bad id").alias("error"))
    bad_end = edges.where(~F.col("source").rlike(FRAGMENT_ID) | ~F.col("target").rlike(FRAGMENT_ID)).select(F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("ref"), F.lit("bad id").alias("error"))
    return over(nodes, max_nodes, "nodes").unionByName(over(edges, max_edges, "edges")).unionByName(bad_id).unionByName(bad_end)


def sanitize_fragment(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame):
    """drops bad ids, folds rationale nodes into an attribute of what they explain, keeps live edges and hyperedges of two or more."""
    good = nodes.where(F.coalesce(F.col("id"), F.lit("")).rlike(FRAGMENT_ID))
    why = edges.where("relation = 'rationale_for'").join(good.where("file_type = 'rationale'").select(F.col("id").alias("source"), F.col("label").alias("_why"), F.col("_ord").alias("_why_ord")), "source")
    texts = why.groupBy(F.col("target").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_why_ord", "_why"))), lambda s: s["_why"]), "; ").alias("rationale"))
    kept = good.where("file_type <> 'rationale' or file_type is null").join(texts, "id", "left")
    live = prune_dangling(edges.where("relation <> 'rationale_for'"), kept)
    members = hyperedges.select("id", F.posexplode("nodes").alias("pos", "node_id")).join(kept.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    again = members.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("nodes")).where(F.size("nodes") >= 2)
    return kept, live, hyperedges.drop("nodes").join(again, "id")


def validate_url(url: str) -> bool:
    """F16: whether a URL is web-shaped and names no private, loopback or link-local address."""
    import ipaddress
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".localhost", ".internal", ".local")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


def within_size_cap(size: int, cap: int = 512 << 20) -> bool:
    """F17."""
    return size <= cap


def callflow_edges(edges: DataFrame) -> DataFrame:
    """edges that a call-flow view shows."""
    shown = ("calls", "indirect_call", "imports", "imports_from", "uses", "references", "inherits", "implements", "extends", "depends_on", "triggers", "reads_from", "writes_to")
    return edges.where(F.col("relation").isin(*shown) & (F.col("source") != F.col("target")))
