"""Extraction of nodes, edges and raw calls from source files (X00-X57), as one table function.

Python is parsed with its own grammar and Markdown and JSON by theirs. Languages with nested blocks
are walked block by block (`scopes`), so that a definition belongs to what is around it. The rest have
no parser here; they are read by line patterns that state what a definition, an import and a base
class look like, and their edges say so by the confidence INFERRED where a pattern can err.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scopes

RECORD = (
    "kind string, id string, label string, file_type string, source_file string, source_location string, source string, target string, relation string, "
    "confidence string, callee string, is_member_call boolean, receiver string"
)
WORD = r"[A-Za-z_$][\w$]*"

# What definitions (type, function), imports and bases look like, by language: a language is one line
# of patterns with the name in group 1. `{w}` is an identifier.
LANGUAGES = {
    "js": ("js jsx mjs cjs ejs ts tsx mts cts vue svelte astro ets", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+({w})", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({w})|^\s*(?:export\s+)?(?:const|let|var)\s+({w})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{w})\s*=>", r"""(?:from|require\(|import)\s*["']([^"']+)["']""", r"\bextends\s+({w})"),
    "java": ("java groovy gradle cls trigger", r"^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record|trigger)\s+({w})", r"^\s+(?:[\w<>\[\],@]+\s+)+({w})\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{{", r"^\s*import\s+(?:static\s+)?([\w.]+)", r"\b(?:extends|implements)\s+({w})"),
    "c": ("c h cpp cc cxx hpp cu cuh metal m mm", r"^\s*(?:typedef\s+)?(?:class|struct|enum|union|@interface|@implementation|@protocol)\s+({w})", r"^(?:[\w:<>*&~]+\s+)+\**({w})\s*\([^;]*\)\s*(?:const)?\s*\{{", r"""^\s*#\s*(?:include|import)\s*[<"]([^>"]+)[>"]""", r"class\s+{w}\s*:\s*(?:public|private|protected)?\s*({w})"),
    "cs": ("cs razor cshtml xaml", r"^\s*(?:[\w\[\]]+\s+)*(?:class|interface|struct|enum|record)\s+({w})", r"^\s+(?:[\w<>\[\],?]+\s+)+({w})\s*\([^;]*\)\s*(?:=>|\{{|$)", r"^\s*@?using\s+([\w.]+)", r"class\s+{w}\s*:\s*({w})"),
    "go": ("go", r"^type\s+({w})\s+(?:struct|interface)", r"^func\s+(?:\([^)]*\)\s*)?({w})\s*\(", r"""^\s*(?:import\s+)?(?:{w}\s+)?"([^"]+)"\s*$""", None),
    "rust": ("rs", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|type)\s+({w})", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+({w})", r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"impl(?:<[^>]*>)?\s+({w})[\w<>]*\s+for"),
    "kotlin": ("kt kts", r"^\s*(?:[\w]+\s+)*(?:class|interface|object)\s+({w})", r"^\s*(?:[\w]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:{w}\.)?({w})\s*\(", r"^\s*import\s+([\w.]+)", r"class\s+{w}[^:]*:\s*({w})"),
    "scala": ("scala", r"^\s*(?:[\w]+\s+)*(?:class|trait|object)\s+({w})", r"^\s*(?:[\w]+\s+)*def\s+({w})", r"^\s*import\s+([\w.]+)", r"\b(?:extends|with)\s+({w})"),
    "swift": ("swift", r"^\s*(?:[\w@]+\s+)*(?:class|struct|enum|protocol|extension|actor)\s+({w})", r"^\s*(?:[\w@]+\s+)*func\s+({w})", r"^\s*import\s+({w})", r"(?:class|struct|enum)\s+{w}\s*:\s*({w})"),
    "ruby": ("rb rake", r"^\s*(?:class|module)\s+({w})", r"^\s*def\s+(?:self\.)?({w}[?!=]?)", r"""^\s*require(?:_relative)?\s+["']([^"']+)["']""", r"class\s+{w}\s*<\s*({w})"),
    "php": ("php", r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+({w})", r"^\s*(?:[\w]+\s+)*function\s+&?({w})", r"^\s*use\s+([\w\\]+)", r"\b(?:extends|implements)\s+({w})"),
    "lua": ("lua luau toc", None, r"^\s*(?:local\s+)?function\s+([\w.:]+)", r"""require\s*\(?\s*["']([^"']+)["']""", None),
    "shell": ("sh bash", None, r"^\s*(?:function\s+)?({w})\s*\(\)\s*\{{?", r"^\s*(?:source|\.)\s+(\S+)", None),
    "powershell": ("ps1 psm1 psd1", r"^\s*class\s+({w})", r"(?i)^\s*function\s+([\w-]+)", r"(?i)^\s*(?:using module|import-module)\s+(\S+)", None),
    "elixir": ("ex exs", r"^\s*defmodule\s+([\w.]+)", r"^\s*defp?\s+({w}[?!]?)", r"^\s*(?:alias|import|use|require)\s+([\w.]+)", None),
    "julia": ("jl", r"^\s*(?:mutable\s+)?(?:struct|module|abstract type)\s+({w})", r"^\s*function\s+([\w.!]+)|^({w}!?)\([^)]*\)\s*=[^=]", r"^\s*(?:using|import)\s+([\w.]+)", r"struct\s+{w}\s*<:\s*({w})"),
    "zig": ("zig", r"^\s*(?:pub\s+)?const\s+({w})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)", r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+({w})", r"""@import\("([^"]+)"\)""", None),
    "dart": ("dart", r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+({w})", r"^\s*(?:[\w<>?]+\s+)+({w})\s*\([^;]*\)\s*(?:async\s*)?\{{", r"""^\s*(?:import|export)\s+["']([^"']+)["']""", r"\b(?:extends|with|implements)\s+({w})"),
    "fortran": ("f f90 f95 f03 f08", r"(?i)^\s*(?:module|program|type)\s+(?!procedure)(?:::)?\s*({w})", r"(?i)^\s*(?:[\w()]+\s+)*(?:subroutine|function)\s+({w})", r"(?i)^\s*use\s+({w})", r"(?i)extends\(({w})\)"),
    "pascal": ("pas pp dpr dpk lpr inc dfm lfm lpk", r"(?i)^\s*({w})\s*=\s*(?:class|record|interface)", r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+([\w.]+)", r"(?i)^\s*uses\s+({w})", r"(?i)=\s*class\s*\(({w})"),
    "verilog": ("v sv svh", r"^\s*(?:module|interface|package|class)\s+({w})", r"^\s*(?:function|task)\s+(?:[\w\[\]:]+\s+)*({w})", r"""^\s*`include\s+"([^"]+)\"""", r"class\s+{w}\s+extends\s+({w})"),
    "terraform": ("tf tfvars hcl", r"""^\s*(?:resource|data)\s+"[^"]+"\s+"([^"]+)\"""", r"""^\s*(?:module|variable|output|provider)\s+"([^"]+)\"""", r"""^\s*source\s*=\s*"([^"]+)\"""", None),
    "dm": ("dm dme dmm dmf dmi", r"^(/[\w/]+)\s*$", r"^\s*(?:proc|verb)/({w})", r"""^\s*#include\s+"([^"]+)\"""", None),
    "dotnet": ("sln slnx csproj fsproj vbproj", r"""Project\([^)]*\)\s*=\s*"([^"]+)"|<Project\s+Path="([^"]+)\"""", None, r"""<(?:Package|Project)Reference\s+Include="([^"]+)\"""", None),
    "r": ("r", None, r"^\s*({w}[\w.]*)\s*(?:<-|=)\s*function", r"^\s*(?:library|require)\(\s*[\"']?({w})", None),
}


# Of the languages of `scopes`, files whose definitions have no braces of their own, or are markup around code.
LINE_READ = (".m", ".mm", ".xaml", ".razor", ".cshtml", ".toc")


def language_of(path: str, text: str = "") -> str | None:
    """The language of a file by compound suffix, name, extension or first line."""
    import re

    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if name.endswith(".blade.php"):
        return "php"
    if name in ("mcp.json", ".mcp.json", "claude_desktop_config.json"):
        return "mcp"
    if name in ("pyproject.toml", "go.mod", "pom.xml", "apm.yml", "apm.yaml"):
        return "manifest"
    if name == "cargo.toml":
        return "cargo"
    if ext in ("py", "pyw"):
        return "python"
    if ext in ("md", "mdx", "qmd"):
        return "markdown"
    if ext in ("json", "sql"):
        return ext
    for language, (exts, *_) in LANGUAGES.items():
        if ext in exts.split():
            return language
    first = re.match(r"#!\s*(\S+)(?:\s+(?:-S\s+)?(\S+))?", text)
    if not ext and first:
        tool = (first[2] if first[1].endswith("/env") and first[2] else first[1]).rsplit("/", 1)[-1]
        return "python" if tool.startswith("python") else "shell" if tool in ("sh", "bash", "zsh", "dash", "ksh") else "js" if tool in ("node", "nodejs") else "ruby" if tool == "ruby" else "lua" if tool == "lua" else None
    return None


def slug(*parts: str) -> str:
    import re
    import unicodedata

    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", unicodedata.normalize("NFKC", "_".join(p for p in parts if p)))).strip("_").lower()


class Records:
    """Collects the records of one file."""

    def __init__(self, path: str, kind: str = "code"):
        self.path, self.kind, self.rows, self.seen = path, kind, [], set()
        self.file = slug(path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path)
        self.node(self.file, path.rsplit("/", 1)[-1], 1)

    def node(self, id_: str, label: str, line: int, file_type: str | None = None, source_file: str | None = None) -> str:
        if id_ not in self.seen:
            self.seen.add(id_)
            self.rows.append({"kind": "node", "id": id_, "label": label, "file_type": file_type or self.kind, "source_file": self.path if source_file is None else source_file, "source_location": f"L{line}"})
        return id_

    def edge(self, source: str, target: str, relation: str, line: int, confidence: str = "EXTRACTED") -> None:
        self.rows.append({"kind": "edge", "source": source, "target": target, "relation": relation, "confidence": confidence, "source_file": self.path, "source_location": f"L{line}"})

    def call(self, caller: str, callee: str, line: int, member: bool, receiver: str | None = None) -> None:
        self.rows.append({"kind": "raw_call", "source": caller, "callee": callee, "is_member_call": member, "receiver": receiver, "source_file": self.path, "source_location": f"L{line}"})


def python_records(path: str, text: str) -> list[dict]:
    """Modules, classes, functions, imports, bases, calls and docstrings."""
    import ast

    out = Records(path)
    tree = ast.parse(text)

    def why(owner: str, node) -> None:
        doc = ast.get_docstring(node)
        if doc:
            line = getattr(node, "lineno", 1)
            out.edge(out.node(f"{owner}_rationale_{line}", doc.strip().split("\n")[0][:120], line, "rationale"), owner, "rationale_for", line)

    def calls(owner: str, node) -> None:
        for c in ast.walk(node):
            if isinstance(c, ast.Call):
                f = c.func
                if isinstance(f, ast.Name):
                    out.call(owner, f.id, c.lineno, False)
                elif isinstance(f, ast.Attribute):
                    out.call(owner, f.attr, c.lineno, True, f.value.id if isinstance(f.value, ast.Name) else None)

    def walk(body, owner: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                me = out.node(slug(owner, n.name), n.name, n.lineno)
                out.edge(owner, me, "contains", n.lineno)
                for b in n.bases:
                    name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                    if name:
                        out.edge(me, out.node(slug(name), name, n.lineno, source_file=""), "inherits", n.lineno)
                why(me, n)
                walk(n.body, me, True)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                me = out.node(slug(owner, n.name), f".{n.name}()" if in_class else f"{n.name}()", n.lineno)
                out.edge(owner, me, "method" if in_class else "contains", n.lineno)
                why(me, n)
                calls(me, n)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.edge(out.file, slug(a.name), "imports", n.lineno)
            elif isinstance(n, ast.ImportFrom):
                base = "/".join(path.split("/")[: -n.level] if n.level else [])
                module = slug(base, (n.module or "").replace(".", "/")) if n.level else slug((n.module or "").replace(".", "/"))
                out.edge(out.file, module, "imports_from", n.lineno)
                for a in n.names:
                    out.edge(out.file, slug(module, a.name), "imports", n.lineno, "INFERRED")

    why(out.file, tree)
    walk(tree.body, out.file, False)
    return out.rows


def pattern_records(path: str, text: str, language: str) -> list[dict]:
    """What the language's line patterns find."""
    import re

    out = Records(path)
    _, type_of, function_of, import_of, base_of = (p.format(w=WORD) if p and i else p for i, p in enumerate(LANGUAGES[language]))
    owner, within = out.file, 0
    words = set()
    functions: list[tuple[int, str]] = []
    for no, line in enumerate(text.split("\n"), 1):
        if type_of and (m := re.search(type_of, line)):
            name = next(g for g in m.groups() if g)
            owner, within = out.node(slug(out.file, name), name, no), len(line) - len(line.lstrip())
            out.edge(out.file, owner, "contains", no)
            if base_of and (b := re.search(base_of, line)) and b[1] != name:
                out.edge(owner, out.node(slug(b[1]), b[1], no, source_file=""), "inherits", no, "INFERRED")
        elif function_of and (m := re.search(function_of, line)):
            name = next(g for g in m.groups() if g)
            if name in ("if", "for", "while", "switch", "return", "catch", "else", "new"):
                continue
            inner = owner != out.file and len(line) - len(line.lstrip()) > within
            home = owner if inner else out.file
            me = out.node(slug(home, name), f".{name}()" if inner else f"{name}()", no)
            out.edge(home, me, "method" if inner else "contains", no)
            functions.append((no, me))
            words.add(name)
        elif import_of and (m := re.search(import_of, line)):
            out.edge(out.file, slug(re.sub(r"^[./]+", "", m[1])), "imports", no)
    for at, (no, me) in enumerate(functions):
        body = text.split("\n")[no : functions[at + 1][0] - 1 if at + 1 < len(functions) else None]
        for k, line in enumerate(body, no + 1):
            for m in re.finditer(r"(?:(" + WORD + r")\s*(?:\.|->|::)\s*)?(" + WORD + r")\s*\(", line):
                if m[2] not in ("if", "for", "while", "switch", "return", "catch", "function", "sizeof"):
                    out.call(me, m[2], k, m[1] is not None, m[1])
    return out.rows


def markdown_records(path: str, text: str) -> list[dict]:
    """Headings by level, and links to files."""
    import posixpath
    import re

    out = Records(path, "document")
    stack, fenced = [(0, out.file)], False
    for no, line in enumerate(text.split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line):
            while stack[-1][0] >= len(m[1]):
                stack.pop()
            me = out.node(slug(out.file, m[2]), m[2], no)
            out.edge(stack[-1][1], me, "contains", no)
            stack.append((len(m[1]), me))
        for target in [*re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s#]+)[^)]*\)", line), *re.findall(r"^\s*\[[^\]]+\]:\s*(\S+)", line), *re.findall(r"\[\[([^\]|#]+)", line)]:
            if not re.match(r"[a-z][a-z0-9+.-]*:", target):
                full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
                out.edge(stack[-1][1], slug(full.rsplit(".", 1)[0]), "references", no)
    return out.rows


def mask_sql_noise(text: str) -> str:
    """Z113: comments and string contents as blanks of the same length."""
    import re

    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def sql_records(path: str, text: str) -> list[dict]:
    """Tables, views, functions and triggers, with what they refer to, read, write and fire on."""
    import re

    out, name = Records(path), r"[\"`\[]?([\w.]+)[\"`\]]?"
    clean = mask_sql_noise(text)
    line_of = lambda at: clean.count("\n", 0, at) + 1
    end = lambda at: (clean.find(";", at) + 1) or len(clean)
    item = lambda n: slug(out.file, n.split(".")[-1])
    for m in re.finditer(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+|unique\s+)*(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?{name}", clean):
        no, kind = line_of(m.start()), m[1].lower()
        me = out.node(item(m[2]), m[2].split(".")[-1] + ("()" if kind in ("function", "procedure") else ""), no)
        out.edge(out.file, me, "contains", no)
        body = clean[m.end() : end(m.end())]
        for pattern, relation in ((r"references\s+", "references"), (r"(?:from|join)\s+", "reads_from"), (r"(?:insert\s+into|update|delete\s+from)\s+", "writes_to")):
            for t in re.finditer(rf"(?i)\b{pattern}{name}", body):
                if t[1].lower() not in ("select", "set", "lateral", "unnest"):
                    out.edge(me, item(t[1]), relation, no)
        if kind == "trigger" and (t := re.search(rf"(?i)\bon\s+{name}", body)):
            out.edge(me, item(t[1]), "triggers", no)
    return out.rows


def json_records(path: str, text: str, limit: int = 500) -> list[dict]:
    """Keys as nodes below their parents."""
    import json

    out = Records(path)

    def walk(value, owner: str, depth: int) -> None:
        items = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
        for k, v in items:
            if len(out.seen) >= limit or depth > 6:
                return
            me = owner
            if k is not None:
                me = out.node(slug(owner, str(k)), str(k), 1)
                out.edge(owner, me, "contains", 1)
            walk(v, me, depth + 1)

    walk(json.loads(text), out.file, 0)
    return out.rows


def mcp_records(path: str, text: str) -> list[dict]:
    """Servers of a tool configuration, their commands, and the names (never values) of their variables."""
    import json

    out = Records(path)
    for name, server in (json.loads(text).get("mcpServers") or {}).items():
        me = out.node(slug("mcp_server", name), name, 1)
        out.edge(out.file, me, "contains", 1)
        if server.get("command"):
            out.edge(me, out.node(slug("command", server["command"]), server["command"], 1), "uses", 1)
        for variable in server.get("env") or {}:
            out.edge(me, out.node(slug("env", variable), variable, 1, "concept"), "references", 1)
    return out.rows


def manifest_records(path: str, text: str) -> list[dict]:
    """A package and what it depends on."""
    import re

    out, name = Records(path), path.rsplit("/", 1)[-1].lower()
    deps: list[str] = []
    package = path
    if name == "pyproject.toml":
        import tomllib

        d = tomllib.loads(text)
        package = d.get("project", {}).get("name") or d.get("tool", {}).get("poetry", {}).get("name") or path
        deps = [re.match(r"[\w.-]+", x)[0] for x in d.get("project", {}).get("dependencies", []) if re.match(r"[\w.-]+", x)] + [k for k in d.get("tool", {}).get("poetry", {}).get("dependencies", {}) if k != "python"]
    elif name == "go.mod":
        package = (re.search(r"(?m)^module\s+(\S+)", text) or [0, path])[1]
        block = "\n".join(re.findall(r"(?s)require\s*\((.*?)\)", text)) + "\n" + "\n".join(re.findall(r"(?m)^require\s+([^(\n]+)$", text))
        deps = re.findall(r"(?m)^\s*([\w./-]+\.[\w./-]+)\s+v", block)
    elif name == "pom.xml":
        from xml.etree import ElementTree

        root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
        package = root.findtext("artifactId") or path
        deps = [d.findtext("artifactId") or "" for d in root.iter("dependency")]
    else:
        package = (re.search(r"(?m)^name:\s*(\S+)", text) or [0, path])[1]
        deps = re.findall(r"(?m)^\s+-\s+([\w./@-]+)", text)
    me = out.node(slug("package", package), package, 1)
    out.edge(out.file, me, "contains", 1)
    for d in dict.fromkeys(filter(None, deps)):
        out.edge(me, out.node(slug("package", d), d, 1, source_file=""), "depends_on", 1)
    return out.rows


def cargo_records(path: str, text: str) -> list[dict]:
    """A crate, its workspace members and its dependencies."""
    import tomllib

    out, d = Records(path), tomllib.loads(text)
    me = out.node(slug("crate", d.get("package", {}).get("name") or path), d.get("package", {}).get("name") or path, 1)
    out.edge(out.file, me, "contains", 1)
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for dep in d.get(section, {}):
            out.edge(me, out.node(slug("crate", dep), dep, 1, source_file=""), "depends_on", 1)
    for m in d.get("workspace", {}).get("members", []):
        out.edge(me, slug(m, "cargo"), "contains", 1, "INFERRED")
    return out.rows


EXTRACTORS = {"python": python_records, "markdown": markdown_records, "sql": sql_records, "json": json_records, "mcp": mcp_records, "manifest": manifest_records, "cargo": cargo_records}


def file_records(path: str, text: str) -> list[dict]:
    """The records of one file; a file that cannot be read yields an `error` record."""
    language = language_of(path, text)
    if language is None:
        return []
    if path.lower().endswith((".vue", ".svelte", ".astro")):
        import re

        scripts = re.findall(r"(?is)<script[^>]*>(.*?)</script>", text) or re.findall(r"(?s)\A---\n(.*?)\n---", text)
        text = "\n".join(scripts)
    try:
        if language in scopes.LANGUAGES and not path.lower().endswith(LINE_READ):
            return scopes.scope_records(Records(path), text, language, slug)
        return EXTRACTORS[language](path, text) if language in EXTRACTORS else pattern_records(path, text, language)
    except (SyntaxError, ValueError, KeyError, RecursionError, AttributeError) as e:
        return [{"kind": "error", "source_file": path, "label": f"{type(e).__name__}: {e}"[:200]}]


def extract(files: DataFrame) -> DataFrame:
    """Records of files (path, text); one row per node, edge, raw call or error."""
    import pandas as pd

    columns = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in file_records(p, t or "")]
            yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)

    return files.select("path", "text").mapInPandas(run, RECORD)


def extracted_graph(records: DataFrame):
    """Nodes and edges out of records, with resolved calls."""
    from ..operators.resolve import resolve_calls
    from ..schema import Graph

    order = F.xxhash64("source_file", "source_location", F.coalesce("id", "target"))
    nodes = records.where("kind = 'node'").select("id", "label", "file_type", "source_file", "source_location", F.lit("ast").alias("_origin"), order.alias("_ord"))
    edges = records.where("kind = 'edge'").select("source", "target", "relation", "confidence", F.lit(1.0).alias("weight"), "source_file", "source_location", order.alias("_ord"))
    calls = records.where("kind = 'raw_call'").select(F.col("source").alias("caller"), "callee", "is_member_call", "receiver", "source_file", "source_location")
    found = resolve_calls(calls, nodes, edges)
    return Graph(nodes, edges.unionByName(found, allowMissingColumns=True))
