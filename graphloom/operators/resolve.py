"""Cross-file resolution (R01-R31): joins that need exactly one match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, file_stem
from .joins import remap, unique_matches
from .scratch import written

# Extensions by family of languages that call one another, as the extraction stage has them.
CALL_FAMILIES = {
    "python": ".py .pyw", "jsts": ".js .jsx .mjs .cjs .ts .tsx .mts .cts .vue .svelte .astro", "jvm": ".java .kt .kts .scala .groovy .gradle",
    "native": ".c .h .cpp .cc .cxx .hpp .m .mm .cu .cuh .metal .swift", "dotnet": ".cs .xaml .razor .cshtml", "go": ".go", "rust": ".rs", "ruby": ".rb .rake",
    "php": ".php", "lua": ".lua .luau", "pascal": ".pas .pp .dpr .lpr .inc", "fortran": ".f .f90 .f95 .f03 .f08", "shell": ".sh .bash", "sql": ".sql", "apex": ".cls .trigger",
}
CASE_FREE = ("pascal", "fortran", "sql", "php", "apex")


def call_family(path: Column) -> Column:
    """Z106: the family of a path; files of no family form one each by extension."""
    ext, out = extension(path), None
    for family, exts in CALL_FAMILIES.items():
        out = F.when(ext.isin(*exts.split()), family) if out is None else out.when(ext.isin(*exts.split()), family)
    return out.otherwise(ext)


def is_case_free(family: Column) -> Column:
    """Z107."""
    return family.isin(*CASE_FREE)


def callable_label(label: Column) -> Column:
    """A label without its dot and parentheses."""
    return F.regexp_replace(label, r"^\.|\(\)$", "")


def label_index(nodes: DataFrame) -> DataFrame:
    """Ids by callable label and family."""
    return nodes.select(callable_label(F.col("label")).alias("name"), call_family(F.col("source_file")).alias("family"), "id")


def existing_pairs(edges: DataFrame) -> DataFrame:
    """R04."""
    return edges.select("source", "target").distinct()


def resolve_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls (caller, callee, is_member_call, source_file) to edges, if exactly one callable of the family has the name.

    A call counts as EXTRACTED (1.0) if the caller's file imports the callee or its file, or holds
    it, else as INFERRED (0.8); scripts of the JavaScript family need that evidence. Member calls,
    calls of oneself and pairs that have an edge already are left out.
    """
    named = label_index(nodes.where("coalesce(source_file, '') <> ''")).withColumn("_k", F.when(is_case_free(F.col("family")), F.lower("name")).otherwise(F.col("name")))
    only = unique_matches(named.distinct(), ["_k", "family"], "id").withColumnRenamed("id", "target")
    wanted = calls.where("not coalesce(is_member_call, false)").withColumn("family", call_family(F.col("source_file"))).withColumn("_k", F.when(is_case_free(F.col("family")), F.lower("callee")).otherwise(F.col("callee")))
    hit = wanted.join(only, ["_k", "family"]).where("caller <> target").join(existing_pairs(edges).withColumnRenamed("source", "caller"), ["caller", "target"], "left_anti")
    files = nodes.select(F.col("id").alias("target"), F.col("source_file").alias("_callee_file"))
    hit = hit.join(files.dropDuplicates(["target"]), "target")
    imports = edges.where(F.col("relation").isin("imports", "imports_from", "re_exports")).select(F.col("source_file"), F.col("target").alias("_imported")).distinct()
    by_symbol = imports.select("source_file", F.col("_imported").alias("target")).withColumn("_sym", F.lit(True))
    file_id = F.lower(F.regexp_replace(file_stem(F.col("_callee_file")), r"[^A-Za-z0-9_]+", "_"))
    by_file = imports.withColumnRenamed("_imported", "_file_id").withColumn("_by_file", F.lit(True))
    j = hit.withColumn("_file_id", file_id).join(by_symbol, ["source_file", "target"], "left").join(by_file, ["source_file", "_file_id"], "left")
    proof = F.coalesce("_sym", "_by_file", F.col("source_file") == F.col("_callee_file"))
    j = j.withColumn("_proof", F.coalesce(proof, F.lit(False))).where("_proof or family <> 'jsts'")
    rows = j.select(
        F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.when(F.col("_proof"), "EXTRACTED").otherwise("INFERRED").alias("confidence"),
        F.when(F.col("_proof"), 1.0).otherwise(0.8).alias("confidence_score"), F.lit(1.0).alias("weight"), F.lit("call").alias("context"), "source_file",
    )
    return rows.dropDuplicates(["source", "target"]).withColumn("_ord", F.xxhash64("source", "target"))


def split_collisions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R05, R06, Z109: ids that several files use get their file's identifier before them, and a hash if they still meet."""
    clash = nodes.where("coalesce(source_file, '') <> ''").groupBy("id").agg(F.count_distinct("source_file").alias("n")).where("n > 1").select("id")
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.col("source_file"), r"\.[^./]*$", ""), r"[^A-Za-z0-9]+", "_"))
    hit = nodes.join(clash, "id", "left_semi").select("id", "source_file").distinct().withColumn("_new", F.concat_ws("_", stem, "id"))
    again = F.count(F.lit(1)).over(Window.partitionBy("_new")) > 1
    salted = hit.withColumn("_new", F.when(again, F.concat_ws("_", "_new", F.substring(F.sha1("source_file"), 1, 6))).otherwise(F.col("_new")))
    out = nodes.join(salted, ["id", "source_file"], "left").withColumn("id", F.coalesce("_new", "id")).drop("_new").select(nodes.columns)
    moved = edges
    for c in ("source", "target"):
        m = salted.select(F.col("id").alias(c), "source_file", F.col("_new"))
        moved = moved.join(m, [c, "source_file"], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out, moved.select(edges.columns)


def rewire_stubs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node without a file is replaced by the only definition of its label: type-like, then in any case, then a function."""
    stub = nodes.where("coalesce(source_file, '') = ''").select(F.col("id").alias("old"), F.col("label").alias("_l"))
    real = nodes.where("coalesce(source_file, '') <> ''")
    types = real.where("label not like '%()'").select(F.col("label").alias("_l"), F.col("id").alias("_a"))
    loose = real.where("label not like '%()'").select(F.lower("label").alias("_ll"), F.col("id").alias("_b"))
    functions = real.where("label like '%()' and not startswith(label, '.')").select(callable_label(F.col("label")).alias("_l"), F.col("id").alias("_c"))
    supertypes = edges.where(F.col("relation").isin("inherits", "extends", "implements")).select(F.col("target").alias("old")).distinct().withColumn("_super", F.lit(True))
    j = stub.join(unique_matches(types, ["_l"], "_a"), "_l", "left").withColumn("_ll", F.lower("_l")).join(unique_matches(loose, ["_ll"], "_b"), "_ll", "left")
    j = j.join(unique_matches(functions, ["_l"], "_c"), "_l", "left").join(supertypes, "old", "left")
    mapping = j.select("old", F.coalesce("_a", "_b", F.when(F.col("_super").isNull(), F.col("_c"))).alias("new")).where("new is not null and new <> old")
    kept = nodes.join(mapping.select(F.col("old").alias("id")), "id", "left_anti").select(nodes.columns)
    return kept, remap(remap(edges, "source", mapping), "target", mapping).select(edges.columns)


def merge_forward_refs(nodes: DataFrame) -> DataFrame:
    """(old, new) from a placeholder to the only other node of its file and label."""
    holder = F.coalesce(F.col("type"), F.lit("")) == "forward_ref"
    real = unique_matches(nodes.where(~holder).select("source_file", "label", F.col("id").alias("new")), ["source_file", "label"], "new")
    return nodes.where(holder).join(real, ["source_file", "label"]).select(F.col("id").alias("old"), "new")


def merge_declarations(nodes: DataFrame) -> DataFrame:
    """R09, Z110: (old, new) from an implementation's class to that of its only header of the same stem."""
    c = nodes.withColumn("_ext", extension(F.col("source_file"))).withColumn("_stem", file_stem(F.col("source_file"))).where("label not like '%()'")
    head = unique_matches(c.where(F.col("_ext").isin(".h", ".hpp")).select("_stem", "label", F.col("id").alias("new")), ["_stem", "label"], "new")
    return c.where(F.col("_ext").isin(".c", ".cc", ".cpp", ".cxx", ".m", ".mm")).join(head, ["_stem", "label"]).where("id <> new").select(F.col("id").alias("old"), "new")


def merge_extensions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(old, new) from a Swift extension to the only type of its name."""
    swift = nodes.where(extension(F.col("source_file")) == ".swift")
    ext = F.coalesce(F.col("type"), F.lit("")) == "extension"
    real = unique_matches(swift.where(~ext & ~F.endswith("label", F.lit("()"))).select("label", F.col("id").alias("new")), ["label"], "new")
    return swift.where(ext).join(real, "label").select(F.col("id").alias("old"), "new")


def resolve_imports(imports: DataFrame, nodes: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Imports (source, module, name, source_file) to the node of the module's file that has the name."""
    files = nodes.where(extension(F.col("source_file")).isin(*suffixes)).select(F.regexp_replace(file_stem(F.col("source_file")), r"/(__init__|index|mod)$", "").alias("_m"), callable_label(F.col("label")).alias("name"), F.col("id").alias("target"))
    one = unique_matches(files, ["_m", "name"], "target")
    wanted = imports.withColumn("_m", F.regexp_replace("module", r"\.", "/"))
    return wanted.join(one, ["_m", "name"]).select("source", "target", F.lit("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), "source_file").distinct()


def resolve_reexports(reexports: DataFrame, definitions: DataFrame, depth: int = 8) -> DataFrame:
    """(module, name, target) through chains of re-exports (module, name, from_module, from_name)."""
    known = definitions.select("module", "name", "target")
    front = known
    for _ in range(depth):
        step = reexports.join(front.select(F.col("module").alias("from_module"), F.col("name").alias("from_name"), "target"), ["from_module", "from_name"]).select("module", "name", "target")
        front = written(step.join(known.select("module", "name"), ["module", "name"], "left_anti").distinct(), "reexports")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def resolve_types(references: DataFrame, nodes: DataFrame, family: str) -> DataFrame:
    """References (source, name, scopes, source_file) to types, by the first scope that has exactly one."""
    types = nodes.where((call_family(F.col("source_file")) == family) & ~F.endswith("label", F.lit("()"))).select(F.regexp_replace(F.regexp_replace(file_stem(F.col("source_file")), r"/[^/]*$", ""), "/", ".").alias("scope"), F.col("label").alias("name"), F.col("id").alias("target"))
    by_scope, anywhere = unique_matches(types, ["scope", "name"], "target"), unique_matches(types.select("name", "target").distinct(), ["name"], "target")
    r = references.withColumn("_r", F.monotonically_increasing_id())
    scoped = r.select("_r", "source", "name", "source_file", F.posexplode_outer("scopes").alias("rank", "scope")).join(by_scope, ["scope", "name"]).select("_r", "source", "source_file", "rank", "target")
    loose = r.select("_r", "source", "name", "source_file").join(anywhere, "name").select("_r", "source", "source_file", F.lit(1 << 20).alias("rank"), "target")
    best = scoped.unionByName(loose).groupBy("_r", "source", "source_file").agg(F.min_by("target", "rank").alias("target"))
    return best.select("source", "target", F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), "source_file").distinct()


def resolve_members(calls: DataFrame, receivers: DataFrame, nodes: DataFrame, edges: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Member calls to the method of their receiver's type.

    receivers has (source_file, receiver, type_name). The type must be the only one of its name in
    the language, and the method the only one of its name in the type.
    """
    own = nodes.where(extension(F.col("source_file")).isin(*suffixes))
    types = unique_matches(own.where("label not like '%()'").select(F.col("label").alias("type_name"), F.col("id").alias("type_id")), ["type_name"], "type_id")
    methods = edges.where("relation = 'method'").select(F.col("source").alias("type_id"), F.col("target").alias("id")).join(nodes.select("id", callable_label(F.col("label")).alias("callee")), "id").withColumnRenamed("id", "target")
    one = unique_matches(methods, ["type_id", "callee"], "target")
    hit = calls.where("is_member_call").join(receivers, ["source_file", "receiver"]).join(types, "type_name").join(one, ["type_id", "callee"]).where("caller <> target")
    return hit.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), "source_file").distinct()


def resolve_inherited(calls: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """Calls (type_id, caller, callee, source_file) to the nearest ancestor's method of that name."""
    methods = edges.where("relation = 'method'").select(F.col("source").alias("at"), F.col("target").alias("id")).join(nodes.select("id", F.lower(callable_label(F.col("label"))).alias("_k")), "id").withColumnRenamed("id", "target")
    up = edges.where(F.col("relation").isin("inherits", "extends")).select(F.col("source").alias("at"), F.col("target").alias("_up")).distinct()
    open_ = calls.withColumn("_k", F.lower("callee")).withColumn("at", F.col("type_id"))
    out = None
    for _ in range(depth):
        open_ = open_.join(up, "at").drop("at").withColumnRenamed("_up", "at")
        hit = open_.join(methods, ["at", "_k"])
        rows = hit.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), "source_file").distinct()
        out = rows if out is None else out.unionByName(rows)
        open_ = open_.join(methods.select("at", "_k").distinct(), ["at", "_k"], "left_anti")
    return out


class Resolvers:
    """Table-to-table resolvers in order, each run only if a file of its suffixes is there."""

    def __init__(self):
        self.steps: list[tuple[str, tuple[str, ...], Callable]] = []

    def add(self, name: str, suffixes: tuple[str, ...], step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.steps.append((name, suffixes, step))

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        present = {r[0] for r in nodes.select(extension(F.col("source_file"))).distinct().collect()}  # kinds of files
        for _, suffixes, step in self.steps:
            if present & set(suffixes):
                edges = edges.unionByName(step(nodes, edges), allowMissingColumns=True)
        return edges


def resolve_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Import paths through alias prefixes (prefix, to); the longest prefix counts."""
    j = imports.join(F.broadcast(aliases), F.startswith(imports["raw"], aliases["prefix"]), "left")
    w = Window.partitionBy(*imports.columns).orderBy(F.desc(F.char_length("prefix")))
    best = j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select(*imports.columns, F.when(F.col("prefix").isNotNull(), F.concat("to", F.expr("substring(raw, char_length(prefix) + 1)"))).otherwise(F.col("raw")).alias("path"))
