"""File and web sources (S01-S34) as tables: scans, classifiers, conversions and parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension, strings

# Extensions by kind of file, manifest names and interpreters.
CODE = (
    "py ts tsx mts cts js jsx mjs cjs ejs ets go rs java groovy gradle cpp cc cxx c h hpp cu cuh metal rb rake swift kt kts cs scala php lua luau toc zig "
    "ps1 psm1 psd1 ex exs m mm jl vue svelte astro dart v sv svh sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc dfm lfm lpk sh bash json tf tfvars hcl "
    "dm dme dmi dmm dmf sln slnx csproj fsproj vbproj xaml razor cshtml cls trigger"
).split()
DOCUMENTS = "md mdx qmd skill txt rst html yaml yml".split()
IMAGES = "png jpg jpeg gif webp svg".split()
OFFICE = "docx xlsx gdoc gsheet gslides".split()
VIDEO = "mp4 mov webm mkv avi m4v mp3 wav m4a ogg".split()
MANIFESTS = "apm.yml apm.yaml pyproject.toml go.mod pom.xml".split()
INTERPRETERS = "python python3 python2 ruby perl node nodejs bash sh dash zsh fish ksh tcsh lua php julia Rscript".split()
ASSET_DIRS = (".imageset", ".xcassets", ".appiconset", ".colorset", ".launchimage")
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]",
    r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
NOISE_DIRS = "node_modules .git .hg .svn __pycache__ .venv venv env dist build target .next .nuxt .cache .tox .mypy_cache .pytest_cache .idea .vscode vendor coverage site-packages".split()
SECRET_NAMES = r"(?i)(^|/)(\.env(\..*)?|.*\.(pem|key|p12|pfx|jks|keystore)|id_(rsa|dsa|ecdsa|ed25519)|credentials(\.json)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd)$"
SECRET_DIRS = r"(?i)(^|/)(\.ssh|\.gnupg|\.aws|\.kube|secrets?)/"


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, content) below root, listed in parallel."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def corpus(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Scanned files without noise, secrets and ignored ones, with kind and words."""
    kept = files.where(~is_noise_path(F.col("path")) & ~is_sensitive(F.col("path")))
    if excludes:
        kept = kept.where(~is_ignored(F.col("path"), excludes))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head = F.substring(text, 1, 3000)
    return kept.select("path", "size", "modified", classify_file(F.col("path"), head).alias("kind"), count_words(text).alias("words"), F.md5("content").alias("ast_hash")).where("kind is not null")


def looks_like_paper(text: Column) -> Column:
    """Three of the signs of a paper in the first 3000 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    return sum((head.rlike(p).cast("int") for p in PAPER_SIGNALS), F.lit(0)) >= 3


def shebang_interpreter(text: Column) -> Column:
    """The interpreter of a first line, through env and its -S."""
    line = F.regexp_extract(text, r"\A#!\s*([^\r\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: (w != "") & ~F.startswith(w, F.lit("-")) & ~F.contains(w, F.lit("=")))
    names = F.filter(F.transform(words, lambda w: F.substring_index(w, "/", -1)), lambda n: n != "env")
    return F.get(names, F.lit(0))


def classify_file(path: Column, text: Column | None = None) -> Column:
    """Code, document, paper, image, video, or null."""
    name, ext = F.lower(basename(path)), F.regexp_replace(extension(path), r"^\.", "")
    text = F.lit(None).cast("string") if text is None else text
    in_assets = F.exists(F.split(path, "/"), lambda p: F.coalesce(p.rlike(r"(" + "|".join(a.replace(".", r"\.") for a in ASSET_DIRS) + r")$"), F.lit(False)))
    return (
        F.when(name.isin(*MANIFESTS) | F.endswith(name, F.lit(".blade.php")), "code")
        .when((ext == "") & F.coalesce(shebang_interpreter(text).isin(*INTERPRETERS), F.lit(False)), "code")
        .when(ext.isin(*CODE), "code")
        .when((ext == "pdf") & ~in_assets, "paper")
        .when(ext.isin(*IMAGES), "image")
        .when(ext.isin(*DOCUMENTS), F.when(looks_like_paper(text), "paper").otherwise("document"))
        .when(ext.isin(*OFFICE), "document")
        .when(ext.isin(*VIDEO), "video")
    )


def is_package_manifest(path: Column) -> Column:
    """Z48."""
    return F.lower(basename(path)).isin(*MANIFESTS)


def count_words(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")


def is_sensitive(path: Column) -> Column:
    """Files that hold credentials by name or folder."""
    return path.rlike(SECRET_NAMES) | path.rlike(SECRET_DIRS)


def is_noise_path(path: Column) -> Column:
    """Below a folder of dependencies, caches or build results."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in NOISE_DIRS])) | path.rlike(r"\.egg-info(/|$)")


def parse_ignore_line(line: str) -> tuple[bool, str] | None:
    """(negated, regular expression) of an ignore pattern, or None for blanks and comments."""
    import re

    line = line.rstrip("\r\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    only_dirs, anchored = body.endswith("/"), "/" in body.rstrip("/")
    body = body.strip("/") if anchored or only_dirs else body
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return negated, ("^" if anchored else "(^|.*/)") + out + ("/.*" if only_dirs else "(/.*)?") + "$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches a path decides; a negated one takes it back in."""
    out = F.lit(False)
    for negated, regex in filter(None, map(parse_ignore_line, patterns)):
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def is_included(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; no pattern lets all in."""
    return is_ignored(path, patterns) if patterns else F.lit(True)


def could_contain_included(folder: str, patterns: list[str]) -> bool:
    """Whether something below a folder may match: the pattern's fixed part lies above or below it."""
    import re

    fixed = [re.split(r"[*?\[]", p.lstrip("!/"))[0].rsplit("/", 1)[0] if "/" in p else "" for p in patterns]
    return not patterns or any(f == "" or f.startswith(folder) or folder.startswith(f) for f in fixed)


def url_type(url: Column) -> Column:
    """Tweet, arxiv, github, youtube, pdf, image or webpage."""
    low = F.lower(url)
    path = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    has = lambda *names: low.rlike("|".join(n.replace(".", r"\.") for n in names))
    return (
        F.when(has("twitter.com", "x.com"), "tweet").when(has("arxiv.org"), "arxiv").when(has("github.com"), "github").when(has("youtube.com", "youtu.be"), "youtube")
        .when(path.rlike(r"/[^/]+\.pdf$"), "pdf").when(path.rlike(r"/[^/]+\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def safe_filename(url: Column, suffix: str = ".md") -> Column:
    """Host and path with odd characters as underscores, 80 characters at most."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(host, F.when(path == "", "/").otherwise(path))).otherwise(url)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\w\-]", "_"), r"^_+|_+$", ""), r"_+", "_")
    return F.concat(F.substring(tidy, 1, 80), F.lit(suffix))


def _markdown(html: str) -> str:
    import re
    from html.parser import HTMLParser

    class Writer(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden, self.links, self.lists = [], 0, [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("script", "style", "head", "title"):
                self.hidden += 1
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "section", "article", "table", "blockquote"):
                self.out.append("\n\n")
            elif tag == "br":
                self.out.append("\n")
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li":
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.out.append("\n" + ("* " if kind[0] == "ul" else f"{kind[1]}. "))
            elif tag == "a":
                self.links.append(a.get("href") or "")
                self.out.append("[")
            elif tag == "img":
                self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head", "title"):
                self.hidden = max(0, self.hidden - 1)
            elif tag == "a" and self.links:
                self.out.append(f"]({self.links.pop()})")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(re.sub(r"\s+", " ", data))

    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html)
    w = Writer()
    w.feed(html)
    w.close()
    text = "".join(w.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


html_to_markdown = strings(_markdown)  # S19


def html_text(html: Column) -> Column:
    """The text of a page without Python: scripts, styles and tags out, white space joined."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, href): the links of each page, each once, also where several rows have one url.

    White space and the end of the tag's name are spelt out: Java's \\b, unlike other engines', takes letters beyond ASCII for parts of a word.
    """
    links = F.regexp_extract_all("html", F.lit(r"""<a(?![0-9A-Za-z_])[^>]*?(?<![0-9A-Za-z_])href[\t\n\f\r ]*=[\t\n\f\r ]*["']([^"']*)["']"""), F.lit(1))
    return pages.select("url", F.explode(F.array_distinct(links)).alias("href")).distinct()


def ingest_pages(pages: DataFrame, captured: str = "1970-01-01") -> DataFrame:
    """(path, text) of pages as markdown with front matter; pages come from a table, nothing is fetched."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    front = F.concat(F.lit('---\ntitle: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\nsource_url: "'), F.col("url"), F.lit('"\ntype: '), url_type(F.col("url")), F.lit(f"\ncaptured_at: {captured}\n---\n\n"))
    return pages.select(safe_filename(F.col("url")).alias("path"), F.concat(front, html_to_markdown(F.col("html"))).alias("text"))


def _zip_ok(content: bytes) -> bool:
    """A readable archive within size and inflation caps."""
    import io
    import zipfile

    if len(content) > 50 << 20:
        return False
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            size = sum(i.file_size for i in z.infolist())
    except (zipfile.BadZipFile, OSError):
        return False
    return size <= 512 << 20 and size <= 200 * max(1, len(content))


def docx_markdown(content: bytes) -> str:
    """Paragraphs and headings of a word file."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    if not _zip_ok(content):
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.match(r"Heading(\d)", style.get(f"{w}val", "")) if style is not None else None
        if text.strip():
            out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(out)


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets of a workbook as rows of strings."""
    import io
    import zipfile
    from xml.etree import ElementTree

    if not _zip_ok(content):
        return []
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [("".join(t.text or "" for t in si.iter(f"{m}t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")]
        out = []
        for i, title in enumerate(titles, 1):
            part = f"xl/worksheets/sheet{i}.xml"
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{m}row") if part in names else []:
                cells = []
                for c in row.iter(f"{m}c"):
                    v = c.find(f"{m}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{m}t"))
                    cells.append(shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else inline)
                rows.append(cells)
            out.append((title, rows))
    return out


def xlsx_markdown(content: bytes) -> str:
    """S13."""
    blocks = []
    for title, rows in xlsx_sheets(content):
        table = [f"## {title}", ""]
        for i, r in enumerate(rows):
            table.append("| " + " | ".join(r) + " |")
            if i == 0:
                table.append("|" + " --- |" * len(r))
        blocks.append("\n".join(table))
    return "\n\n".join(blocks)


def office_text(files: DataFrame) -> DataFrame:
    """S12, S13 over scanned files: (path, text)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [docx_markdown(c) if p.lower().endswith(".docx") else xlsx_markdown(c) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})

    return files.where(F.lower("path").rlike(r"\.(docx|xlsx)$")).select("path", "content").mapInPandas(run, "path string, text string")


def google_shortcuts(spark: SparkSession, path: str) -> DataFrame:
    """Shortcut files as (url, doc_id, email)."""
    return spark.read.schema("url string, doc_id string, email string, resource_id string").json(path).select("url", F.coalesce("doc_id", F.regexp_extract("url", r"/d/([^/]+)", 1)).alias("doc_id"), "email")


def load_graph(spark: SparkSession, path: str):
    """A node-link file, its edges under `links` or `edges`."""
    from ..schema import EDGES, HYPEREDGES, NODES, Graph

    inner = lambda ddl: ", ".join(f"{f.rsplit(' ', 1)[0]}: {f.rsplit(' ', 1)[1]}" for f in ddl.replace("map<string,string>", "map<string;string>").split(", ")).replace(";", ",")
    shape = f"directed boolean, multigraph boolean, nodes array<struct<{inner(NODES)}>>, links array<struct<{inner(EDGES)}>>, edges array<struct<{inner(EDGES)}>>, hyperedges array<struct<{inner(HYPEREDGES)}>>"
    raw = spark.read.schema(shape).option("multiLine", "true").json(path)
    numbered = lambda c: raw.select(F.posexplode(c).alias("_pos", "r")).select("r.*", "_pos").withColumn("_ord", F.coalesce("_ord", F.col("_pos").cast("bigint"))).drop("_pos")
    kind = raw.select("directed", "multigraph").first()
    hyper = raw.select(F.explode("hyperedges").alias("r")).select("r.*")
    return Graph(numbered("nodes"), numbered(F.coalesce("links", "edges")), hyper, bool(kind["directed"]), bool(kind["multigraph"]))


def scip_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S22, S23, Z103-Z105: nodes and edges of an index (relative_path, symbols).

    A relationship's target is the symbol of the same file, else the only one of that name, else a
    stub node.
    """
    d = documents.select("relative_path", F.explode("symbols").alias("s"))
    suffix = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"([^/#.`() ]+)[#.`()/]*$", 1)), r"[^a-z0-9]+", "_")
    node_id = lambda sym, file: F.concat_ws("_", F.lit("scip"), suffix(sym), F.substring(F.sha2(F.concat(file, F.lit("\0"), sym), 256), 1, 12))
    line = F.get(F.get(F.col("s.occurrences"), F.lit(0))["range"], F.lit(0))
    defs = d.select(node_id(F.col("s.symbol"), F.col("relative_path")).alias("id"), F.col("s.symbol").alias("symbol"), F.coalesce(F.nullif(F.col("s.display_name"), F.lit("")), "s.symbol").alias("label"), "relative_path", F.concat(F.lit("L"), line + 1).alias("source_location"))
    rel = d.select(node_id(F.col("s.symbol"), F.col("relative_path")).alias("source"), "relative_path", F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "implements").when(F.col("r.is_type_definition"), "type_definition").when(F.col("r.is_definition"), "defines").when(F.col("r.is_reference"), "references")
    rel = rel.select("source", "relative_path", F.col("r.symbol").alias("symbol"), kind.alias("relation")).where("relation is not null")
    same = defs.groupBy("relative_path", "symbol").agg(F.min("id").alias("_same"))
    only = defs.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_only")).where("_n = 1").drop("_n")
    found = rel.join(same, ["relative_path", "symbol"], "left").join(only, "symbol", "left")
    found = found.withColumn("target", F.coalesce("_same", "_only", node_id(F.col("symbol"), F.lit("external"))))
    edges = found.select("source", "target", "relation", F.col("relative_path").alias("source_file")).dropDuplicates(["source", "target", "relation"])
    nodes = defs.select("id", "label", F.lit("code").alias("file_type"), F.col("relative_path").alias("source_file"), "source_location").dropDuplicates(["id"])
    stubs = found.where("_same is null and _only is null").select(F.col("target").alias("id"), F.col("symbol").alias("label"), F.lit("code").alias("file_type"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location")).dropDuplicates(["id"])
    return nodes.unionByName(stubs), edges


def postgres_graph(spark: SparkSession, url: str, properties: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A live catalogue over JDBC, as a schema graph."""
    read = lambda t: spark.read.jdbc(url, f"information_schema.{t}", properties=properties or {})
    return catalog_graph(read("tables"), read("referential_constraints").join(read("key_column_usage"), ["constraint_name"]), "postgres")


def catalog_graph(tables: DataFrame, references: DataFrame, database: str) -> tuple[DataFrame, DataFrame]:
    """Tables (table_schema, table_name, table_type) and references (table_name, unique_table) as nodes and edges."""
    file = F.lit(f"{database}.sql")
    nodes = tables.select(F.lower(F.concat_ws("_", "table_schema", "table_name")).alias("id"), F.col("table_name").alias("label"), F.lit("code").alias("file_type"), file.alias("source_file"), F.lower(F.coalesce("table_type", F.lit("table"))).alias("type"))
    if "unique_table" not in references.columns:
        return nodes, nodes.sparkSession.createDataFrame([], "source string, target string, relation string, confidence string, source_file string")
    by_name = nodes.select("label", "id")
    edges = references.join(by_name.toDF("table_name", "source"), "table_name").join(by_name.toDF("unique_table", "target"), "unique_table")
    return nodes, edges.select("source", "target", F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), file.alias("source_file")).distinct()


def memory_documents(files: DataFrame) -> DataFrame:
    """Notes with front matter (path, text) as question, date, outcome, correction and source_nodes."""
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*\"?(.*?)\"?\s*$", 1)), F.lit(""))
    listed = F.regexp_extract_all(F.regexp_extract(front, r"(?s)source_nodes:\s*(\[[^\]]*\]|(?:\n\s*-\s*[^\n]*)*)", 1), F.lit(r"""["']?([A-Za-z0-9_.:\-]+)["']?"""), F.lit(1))
    return files.select(F.col("path").alias("doc_id"), field("question").alias("question"), field("date").alias("date"), field("outcome").alias("outcome"), field("correction").alias("correction"), F.filter(listed, lambda x: x != "-").alias("source_nodes")).where("question is not null")


def pr_list(raw: DataFrame) -> DataFrame:
    """A JSON list of pull requests (column json) as the PR relation."""
    shape = "array<struct<number:bigint,baseRefName:string,isDraft:boolean,reviewDecision:string,updatedAt:string,headRefName:string,title:string,files:array<struct<path:string>>,statusCheckRollup:array<struct<conclusion:string,status:string>>>>"
    from ..operators.aggregate import ci_rollup

    p = raw.select(F.explode(F.from_json("json", shape)).alias("p"))
    checks = F.transform("p.statusCheckRollup", lambda c: F.coalesce(F.nullif(c["conclusion"], F.lit("")), c["status"]))
    return p.select(
        "p.number", F.col("p.baseRefName").alias("base_branch"), F.coalesce("p.isDraft", F.lit(False)).alias("is_draft"), F.col("p.reviewDecision").alias("review_decision"), ci_rollup(checks).alias("ci_status"),
        F.try_to_timestamp("p.updatedAt", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).alias("updated_at"), F.transform("p.files", lambda f: f["path"]).alias("files_changed"), F.col("p.headRefName").alias("branch"), F.col("p.title").alias("title"),
    )


def worktrees(porcelain: DataFrame) -> DataFrame:
    """(path, head, branch) of the records in a porcelain listing (column text)."""
    r = porcelain.select(F.explode(F.split("text", r"\n\s*\n")).alias("r")).where("trim(r) <> ''")
    get = lambda k: F.nullif(F.regexp_extract("r", rf"(?m)^{k} (.*)$", 1), F.lit(""))
    return r.select(get("worktree").alias("path"), get("HEAD").alias("head"), F.regexp_replace(get("branch"), "^refs/heads/", "").alias("branch"))


def salvage_json(raw: str) -> str | None:
    """The JSON object in a model's answer: in a fence, or the first balanced one that parses."""
    import json
    import re

    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", raw, re.S), raw]:
        for start in (m.start() for m in re.finditer(r"\{", part)):
            try:
                value, _ = json.JSONDecoder().raw_decode(part[start:])
            except ValueError:
                continue
            if isinstance(value, dict):
                return json.dumps(value)
    return None


parse_llm_json = strings(salvage_json)


def extract_with_model(chunks: DataFrame, backend, retries: int = 3) -> DataFrame:
    """A backend's answers (chunk_id, json) per chunk (chunk_id, text).

    A chunk whose answer cannot be read is asked about again in halves.
    """
    import pandas as pd

    def ask(text: str, left: int) -> list[str]:
        answer = salvage_json(backend(text) or "")
        if answer is not None or left == 0 or len(text) < 2:
            return [answer] if answer is not None else []
        half = text.rfind("\n", 0, len(text) // 2 + 1) + 1 or len(text) // 2
        return ask(text[:half], left - 1) + ask(text[half:], left - 1)

    def run(batches):
        for pdf in batches:
            rows = [(c, a) for c, t in zip(pdf["chunk_id"], pdf["text"], strict=True) for a in ask(t, retries)]
            yield pd.DataFrame(rows, columns=["chunk_id", "json"])

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, json string")


def external_text(files: DataFrame, convert) -> DataFrame:
    """(path, text) through a given converter of bytes, for formats whose parsers are not part of this library."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [convert(c) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
