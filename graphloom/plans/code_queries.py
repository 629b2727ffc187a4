"""Queries on code: extraction from a file of each language for every nation, and the resolution of names across files.

The SQL of an extraction states the records that a reader of the sample finds, for every nation's number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources import extract as XT
from ..sources.tables import table
from .catalog import query
from .code_samples import SAMPLES


def numbers(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))


def sample_files(spark, d, language: str) -> DataFrame:
    path, text, _ = SAMPLES[language]
    filled = lambda s: F.replace(F.lit(s), F.lit("{k}"), F.col("k"))
    return numbers(spark, d).select(filled(path).alias("path"), filled(text).alias("text"))


FIELDS = ("kind", "id", "label", "file_type", "source_file", "source_location", "source", "target", "relation", "confidence", "callee", "is_member_call", "receiver")


def expected_sql(language: str) -> str:
    """The sample's records for every nation as a SELECT."""
    path, _, found = SAMPLES[language]
    rows = []
    for line in found.strip().split("\n"):
        kind, a, b, c, e, at = line.split("|")
        if kind == "N":
            row = dict(kind="node", id=a, label=b, file_type=c, source_file=path if e else "", source_location=f"L{at}")
        elif kind == "E":
            row = dict(kind="edge", source=a, target=b, relation=c, confidence=e, source_file=path, source_location=f"L{at}")
        else:
            row = dict(kind="raw_call", source=a, callee=b, is_member_call=c, receiver=e or None, source_file=path, source_location=f"L{at}")
        rows.append("(" + ", ".join("NULL" if row.get(f) is None else "'" + row[f].replace("'", "''") + "'" for f in FIELDS) + ")")
    shown = ", ".join(f"replace({f}, '{{k}}', k) AS {f}" for f in FIELDS)
    return f"SELECT {shown} FROM (VALUES {', '.join(rows)}) v({', '.join(FIELDS)}), (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation)"


def _extraction(language: str):
    @query(f"extract_{language}", expected_sql(language), graph=False)
    def run(spark, d):
        return XT.extract(sample_files(spark, d, language)).withColumn("is_member_call", F.col("is_member_call").cast("string")).select(*FIELDS)


for _language in SAMPLES:
    _extraction(_language)


def _n(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))


def text_of(template: str):
    """A template over k, {k} being its number and {k+1} the next, as a column."""
    return F.replace(F.replace(F.lit(template), F.lit("{k+1}"), (F.col("k") + 1).cast("string")), F.lit("{k}"), F.col("k").cast("string"))


def rows_of(spark, d, *templates: dict) -> DataFrame:
    """One row per nation and template, the fields filled in."""
    frames = [_n(spark, d).select(*[(text_of(v) if isinstance(v, str) else F.array(*map(text_of, v)) if isinstance(v, list) else F.lit(v)).alias(c) for c, v in t.items()]) for t in templates]
    return reduce(DataFrame.unionByName, frames)


def node(id_: str, label: str, file: str) -> dict:
    return {"id": id_, "label": label, "source_file": file}


# Per language its suffix and how a module is written: modules n0, n1, ... each import `run` of the next one.
IMPORTS = {"python": (".py", "pkg.n{k+1}"), "java": (".java", "pkg.n{k+1}"), "cs": (".cs", "pkg.n{k+1}"), "js": (".ts", "pkg/n{k+1}")}


def _imports(language: str, suffix: str, module: str):
    @query(
        f"resolve_imports_{language}",
        f"SELECT 'app_n' || k AS source, 'pkg_n' || (k + 1) || '_run' AS target, 'imports' AS relation, 'EXTRACTED' AS confidence, 'app/n' || k || '{suffix}' AS source_file FROM (SELECT n_nationkey AS k FROM nation) WHERE k + 1 IN (SELECT n_nationkey FROM nation) AND (k + 1) % 5 <> 0",
        graph=False,
    )
    def run(spark, d):
        """Every module has a function `run`; in every fifth there are two, so that it is not the only one. Other languages' files do not count."""
        own = rows_of(spark, d, node("pkg_n{k}_run", "run()", f"pkg/n{{k}}{suffix}"), node("other_n{k}", "run()", "pkg/n{k}.zz"))
        twice = rows_of(spark, d, node("pkg_n{k}_run_2", "run()", f"pkg/n{{k}}{suffix}")).where(F.regexp_extract("id", r"n(\d+)_", 1).cast("int") % 5 == 0)
        wanted = rows_of(spark, d, {"source": "app_n{k}", "module": module, "name": "run", "source_file": f"app/n{{k}}{suffix}"}, {"source": "app_n{k}", "module": module, "name": "missing", "source_file": f"app/n{{k}}{suffix}"})
        return R.resolve_imports(wanted, own.unionByName(twice), (suffix,))


for _language, (_suffix, _module) in IMPORTS.items():
    _imports(_language, _suffix, _module)


@query("resolve_reexports", "SELECT 'n' || k AS module, 'x' AS name, 'def_x' AS target FROM (SELECT n_nationkey AS k, max(n_nationkey) OVER () AS top FROM nation) WHERE top - k < 8 UNION ALL SELECT 'n' || (max(n_nationkey) + 1), 'x', 'def_x' FROM nation", graph=False)
def resolve_reexports(spark, d):
    """Module k passes on x of module k + 1; the last one defines it, eight steps back it is still found."""
    chain = rows_of(spark, d, {"module": "n{k}", "name": "x", "from_module": "n{k+1}", "from_name": "x"}, {"module": "n{k}", "name": "y", "from_module": "gone", "from_name": "y"})
    last = _n(spark, d).agg(F.max("k").alias("k")).select(text_of("n{k+1}").alias("module"), F.lit("x").alias("name"), F.lit("def_x").alias("target"))
    return R.resolve_reexports(chain, last)


TYPES = {"java": ("jvm", ".java"), "cs": ("dotnet", ".cs"), "php": ("php", ".php")}


def _types(language: str, family: str, suffix: str):
    @query(
        f"resolve_types_{language}",
        f"SELECT 'use_' || k AS source, CASE k % 3 WHEN 0 THEN 'a_' || k WHEN 1 THEN 'b_' || k ELSE 'c_' || k END AS target, 'references' AS relation, 'EXTRACTED' AS confidence, 'use/n' || k || '{suffix}' AS source_file FROM (SELECT n_nationkey AS k FROM nation)",
        graph=False,
    )
    def run(spark, d):
        """Type T<k> lies in package a (k % 3 = 0, and in b as well), in b (1) or, as the only one anywhere, in c (2); a file sees a, then b."""
        n = _n(spark, d)
        kind = lambda p, keep: n.where(keep).select(text_of(f"{p}_{{k}}").alias("id"), text_of("T{k}").alias("label"), text_of(f"{p}/n{{k}}{suffix}").alias("source_file"))
        types = kind("a", F.col("k") % 3 == 0).unionByName(kind("b", F.col("k") % 3 < 2)).unionByName(kind("c", F.col("k") % 3 == 2)).unionByName(kind("z", F.lit(True)).withColumn("source_file", F.lit("z/other.zz")))
        wanted = rows_of(spark, d, {"source": "use_{k}", "name": "T{k}", "scopes": ["a", "b"], "source_file": f"use/n{{k}}{suffix}"})
        return R.resolve_types(wanted, types, family)


for _language, (_family, _suffix) in TYPES.items():
    _types(_language, _family, _suffix)


MEMBERS = {"python": ".py", "java": ".java", "cs": ".cs", "ts": ".ts", "ruby": ".rb", "swift": ".swift", "cpp": ".cpp", "objc": ".m"}


def _members(language: str, suffix: str):
    @query(
        f"resolve_members_{language}",
        f"SELECT 'app_' || k AS source, 'type_' || (k + 1) || '_go' AS target, 'calls' AS relation, 'INFERRED' AS confidence, CAST(0.8 AS DOUBLE) AS confidence_score, 'app/n' || k || '{suffix}' AS source_file FROM (SELECT n_nationkey AS k FROM nation) WHERE k + 1 IN (SELECT n_nationkey FROM nation) AND (k + 1) % 4 <> 0",
        graph=False,
    )
    def run(spark, d):
        """x.go() where x is of type Type<k + 1>; every fourth type has a namesake and is not resolved, nor is a method that a type lacks."""
        n = rows_of(spark, d, node("type_{k}", "Type{k}", f"lib/n{{k}}{suffix}"), node("type_{k}_go", ".go()", f"lib/n{{k}}{suffix}"), node("app_{k}", "main()", f"app/n{{k}}{suffix}"))
        twin = rows_of(spark, d, node("twin_{k}", "Type{k}", f"lib/twin{{k}}{suffix}")).where(F.regexp_extract("id", r"(\d+)", 1).cast("int") % 4 == 0)
        e = rows_of(spark, d, {"source": "type_{k}", "target": "type_{k}_go", "relation": "method"})
        calls = rows_of(spark, d, *[{"caller": "app_{k}", "callee": c, "is_member_call": m, "receiver": r, "source_file": f"app/n{{k}}{suffix}"} for c, m, r in (("go", True, "x"), ("stay", True, "x"), ("go", True, "unknown"), ("go", False, "x"))])
        receivers = rows_of(spark, d, {"source_file": f"app/n{{k}}{suffix}", "receiver": "x", "type_name": "Type{k+1}"})
        return R.resolve_members(calls, receivers, n.unionByName(twin), e, (suffix,))


for _language, _suffix in MEMBERS.items():
    _members(_language, _suffix)


@query("resolve_inherited", "SELECT 'call_' || k AS source, 'type_' || ((k // 5 + 1) * 5) || '_run' AS target, 'calls' AS relation, 'INFERRED' AS confidence, 'n' || k || '.pas' AS source_file FROM (SELECT n_nationkey AS k FROM nation) WHERE (k // 5 + 1) * 5 IN (SELECT n_nationkey FROM nation)", graph=False)
def resolve_inherited(spark, d):
    """Type k descends from type k + 1; every fifth has a method Run, and `inherited run` means the nearest one above."""
    n = rows_of(spark, d, node("type_{k}", "T{k}", "n{k}.pas"), node("type_{k}_run", ".Run()", "n{k}.pas"))
    up = rows_of(spark, d, {"source": "type_{k}", "target": "type_{k+1}", "relation": "inherits"})
    has = rows_of(spark, d, {"source": "type_{k}", "target": "type_{k}_run", "relation": "method"}).where(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 == 0)
    calls = rows_of(spark, d, {"type_id": "type_{k}", "caller": "call_{k}", "callee": "run", "source_file": "n{k}.pas"})
    return R.resolve_inherited(calls, n, up.unionByName(has))


@query("resolve_aliases", "SELECT '@app/n' || k AS raw, 'src/app/n' || k AS path FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT '@app/deep/n' || k, 'src/other/n' || k FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'plain' || k, 'plain' || k FROM (SELECT n_nationkey AS k FROM nation)", graph=False)
def resolve_aliases(spark, d):
    raw = rows_of(spark, d, {"raw": "@app/n{k}"}, {"raw": "@app/deep/n{k}"}, {"raw": "plain{k}"})
    return R.resolve_aliases(raw, spark.createDataFrame([("@app", "src/app"), ("@app/deep", "src/other")], "prefix string, to string"))


@query("rewire_stubs", "SELECT 'use_' || k AS source, 'real_' || k AS target, 'inherits' AS relation FROM (SELECT n_nationkey AS k FROM nation) WHERE k % 2 = 0 UNION ALL SELECT 'use_' || k, 'stub_' || k, 'inherits' FROM (SELECT n_nationkey AS k FROM nation) WHERE k % 2 = 1", graph=False)
def rewire_stubs(spark, d):
    """A base class without a file becomes the only class of its name; where two have it, it stays."""
    n = rows_of(spark, d, node("stub_{k}", "Base{k}", ""), node("real_{k}", "Base{k}", "a{k}.py"), node("use_{k}", "Use{k}", "u{k}.py"))
    twin = rows_of(spark, d, node("twin_{k}", "Base{k}", "b{k}.py")).where(F.regexp_extract("id", r"(\d+)", 1).cast("int") % 2 == 1)
    e = rows_of(spark, d, {"source": "use_{k}", "target": "stub_{k}", "relation": "inherits"})
    return R.rewire_stubs(n.unionByName(twin), e)[1].select("source", "target", "relation")


@query(
    "resolve_calls",
    "SELECT 'main_' || k AS source, 'run_' || (k + 1) AS target, 'calls' AS relation, CASE WHEN k % 2 = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence_score, 'm' || k || '.py' AS source_file FROM (SELECT n_nationkey AS k FROM nation) WHERE k + 1 IN (SELECT n_nationkey FROM nation)",
    graph=False,
)
def resolve_calls(spark, d):
    """main of file k calls run<k + 1> of file k + 1; files with an even number import it, which makes the call certain."""
    n = rows_of(spark, d, node("main_{k}", "main()", "m{k}.py"), node("run_{k}", "run{k}()", "m{k}.py"))
    e = rows_of(spark, d, {"source": "m{k}", "target": "run_{k+1}", "relation": "imports", "source_file": "m{k}.py"}).where(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0)
    calls = rows_of(spark, d, *[{"caller": "main_{k}", "callee": c, "is_member_call": m, "source_file": "m{k}.py"} for c, m in (("run{k+1}", False), ("main", False), ("run{k}", True), ("nobody", False))])
    return R.resolve_calls(calls, n, e).select("source", "target", "relation", "confidence", "confidence_score", "source_file")
