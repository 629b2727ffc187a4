"""Queries on text functions, sources, extraction, entity resolution, streams and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import GraphQueries
from ..functions import text as S
from ..operators import entity as E
from ..operators import filters as X
from ..operators import rank as W
from ..schema import Graph
from ..sinks import export as K
from ..sources import extract as XT
from ..sources import files as FS
from ..sources.tables import edges, graph, nodes, table
from ..streaming import watch as ST
from .catalog import query
from .graph_queries import DEGREE_ALL


@query(
    "url_type",
    r"""SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github'
    WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]*[^?#]*/[^/?#]+\.pdf([?#]|$)') THEN 'pdf' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]*[^?#]*/[^/?#]+\.(png|jpg|jpeg|webp|gif)([?#]|$)') THEN 'image' ELSE 'webpage' END AS kind FROM pages""",
    graph=False,
)
def url_type(spark, d):
    return table(spark, d, "pages").select("page_id", FS.url_type(F.col("url")).alias("kind"))


@query(
    "safe_filename",
    r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END, '[^\w\-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'), 1, 80) || '.md' AS name FROM pages""",
    graph=False,
)
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", FS.safe_filename(F.col("url")).alias("name"))


@query("word_count", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents", graph=False)
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", FS.count_words(F.col("text")).alias("words"))


PAPER = " + ".join(f"CAST(regexp_matches(h, '{p}') AS INTEGER)" for p in FS.PAPER_SIGNALS)


@query("paper_signal", f"WITH x AS (SELECT doc_id, substr(text, 1, 3000) AS h FROM documents) SELECT doc_id, {PAPER} >= 3 AS paper FROM x", graph=False)
def paper_signal(spark, d):
    return table(spark, d, "documents").select("doc_id", FS.looks_like_paper(F.col("text")).alias("paper"))


@query("classify_files", "SELECT id, CASE WHEN ends_with(source_file, '.py') THEN 'code' WHEN ends_with(source_file, '.md') THEN 'document' END AS kind FROM nodes")
def classify_files(spark, d):
    return nodes(spark, d).select("id", FS.classify_file(F.col("source_file")).alias("kind"))


@query("ignored_paths", "SELECT id, (starts_with(source_file, 'parts/') AND NOT contains(source_file, 'Brand#1')) OR ends_with(source_file, '5.md') AS ignored FROM nodes")
def ignored_paths(spark, d):
    return nodes(spark, d).select("id", FS.is_ignored(F.col("source_file"), ["parts/", "!parts/Brand#1*.py", "*5.md"]).alias("ignored"))


@query("normalize_ids", r"SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM pages", graph=False)
def normalize_ids(spark, d):
    return table(spark, d, "pages").select("url", S.normalize_id_ascii(F.col("url")).alias("id"))


@query("make_ids", r"SELECT id, trim(regexp_replace(lower(source_file || '_' || label), '[^a-z0-9]+', '_', 'g'), '_') AS made FROM nodes")
def make_ids(spark, d):
    return nodes(spark, d).select("id", S.make_id(F.col("source_file"), F.col("label")).alias("made"))


@query("file_stems", r"SELECT DISTINCT source_file, regexp_replace(source_file, '\.[^./]*$', '') AS stem, split_part(source_file, '/', 1) AS top FROM nodes")
def file_stems(spark, d):
    return nodes(spark, d).select("source_file", S.file_stem(F.col("source_file")).alias("stem"), S.top_level_dir(F.col("source_file")).alias("top")).distinct()


@query("language_families", "SELECT id, CASE WHEN ends_with(source_file, '.py') THEN 'python' END AS family, CASE WHEN ends_with(source_file, '.py') THEN 'code' ELSE 'doc' END AS category FROM nodes")
def language_families(spark, d):
    return nodes(spark, d).select("id", X.language_family(F.col("source_file")).alias("family"), X.file_category(F.col("source_file")).alias("category"))


@query("sanitized_labels", r"SELECT page_id, substr(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '[\x00-\x1f\x7f]', '', 'g'), 1, 40) AS label, replace(replace(replace(replace(replace(substr(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '[\x00-\x1f\x7f]', '', 'g'), 1, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages", graph=False)
def sanitized_labels(spark, d):
    title = F.regexp_extract("html", r"<title[^>]*>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", S.sanitize_label(title, 40).alias("label"), S.sanitize_metadata_string(title, 40).alias("escaped"))


@query("token_estimates", "SELECT doc_id, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS tokens FROM documents", graph=False)
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash, md5(text) AS md5 FROM documents", graph=False)
def content_hashes(spark, d):
    from ..operators.incremental import content_hash

    return table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"), F.md5("text").alias("md5"))


@query("search_words", "SELECT doc_id, CAST(len(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')) AS BIGINT) AS words FROM documents", graph=False)
def search_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(S.search_tokens(F.col("text"))).cast("bigint").alias("words"))


def labels(spark, d):
    """The distinct labels of all nodes, in lower case."""
    return nodes(spark, d).select(F.lower("label").alias("norm")).distinct()


def name_pairs(spark, d):
    """The distinct labels at the two ends of every edge."""
    n = nodes(spark, d)
    side = lambda end, name: n.select(F.col("id").alias(end), F.lower("label").alias(name))
    return edges(spark, d).select("source", "target").join(side("source", "x"), "source").join(side("target", "y"), "target").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


NAMES = "l AS (SELECT DISTINCT lower(label) AS norm FROM nodes), pr AS (SELECT DISTINCT least(lower(x.label), lower(y.label)) AS a, greatest(lower(x.label), lower(y.label)) AS b FROM edges JOIN nodes x ON x.id = source JOIN nodes y ON y.id = target)"


@query("label_entropy", f"{NAMES}, c AS (SELECT norm, unnest(string_split(norm, '')) AS ch FROM l), p AS (SELECT norm, count(*) AS k FROM c GROUP BY norm, ch), t AS (SELECT norm, sum(k) AS n FROM p GROUP BY norm) SELECT norm, round(-sum((k / n) * log2(k / n)), 9) AS entropy FROM p JOIN t USING (norm) GROUP BY norm")
def label_entropy(spark, d):
    return labels(spark, d).select("norm", F.round(S.entropy(F.col("norm")), 9).alias("entropy"))


@query("shingle_jaccard", f"{NAMES}, s AS (SELECT norm, list_distinct(list_transform(range(1, length(replace(norm, ' ', '')) - 1), lambda i: substr(replace(norm, ' ', ''), i, 3))) AS sh FROM l) SELECT a, b, round(len(list_intersect(x.sh, y.sh)) / len(list_distinct(list_concat(x.sh, y.sh))), 9) AS jaccard FROM pr JOIN s x ON x.norm = a JOIN s y ON y.norm = b")
def shingle_jaccard(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(E.jaccard(S.shingles(F.col("a")), S.shingles(F.col("b"))), 9).alias("jaccard"))


@query("jaro_scores", f"{NAMES} SELECT a, b, round(jaro_similarity(a, b) * 100, 6) AS jaro, round(jaro_winkler_similarity(a, b) * 100, 6) AS jaro_winkler FROM pr")
def jaro_scores(spark, d):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, d).select("a", "b", F.round(S.jaro_score(a, b), 6).alias("jaro"), F.round(S.jaro_winkler_score(a, b), 6).alias("jaro_winkler"))


@query(
    "entity_guards",
    rf"""{NAMES},
    t AS (SELECT *, list_sort(list_transform(regexp_extract_all(a, '\d+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0'))) AS ta, list_sort(list_transform(regexp_extract_all(b, '\d+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0'))) AS tb FROM pr)
    SELECT a, b, ta <> tb AS numbers, (starts_with(b, a) OR starts_with(a, b)) AND a <> b AS extension FROM t""",
)
def entity_guards(spark, d):
    return name_pairs(spark, d).select("a", "b", S.numeric_tokens_differ(F.col("a"), F.col("b")).alias("numbers"), S.is_prefix_extension(F.col("a"), F.col("b")).alias("extension"))


def _entities(spark, d):
    """All nodes, and those with a `t` in their label once more with it doubled, as a slip of another chunk."""
    n = nodes(spark, d)
    slips = n.where("contains(label, 't')").withColumn("id", F.concat("id", F.lit("_c1"))).withColumn("label", F.regexp_replace("label", "^([^t]*)t", "$1tt"))
    return n.unionByName(slips)


@query(
    "fuzzy_pairs",
    """e AS (SELECT id AS a, id || '_c1' AS b, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS a_norm, trim(regexp_replace(lower(regexp_replace(label, 't', 'tt')), '[^a-z0-9]+', ' ', 'g')) AS b_norm FROM nodes WHERE contains(label, 't') AND file_type <> 'code')
    SELECT a, b, a_norm, b_norm, round(jaro_winkler_similarity(a_norm, b_norm) * 100, 6) AS score, FALSE AS blocked FROM e""",
)
def fuzzy_pairs(spark, d):
    return E.fuzzy_scores(_entities(spark, d), S.entity_norm_ascii(F.col("label"))).withColumn("score", F.round("score", 6))


@query("exact_entities", "e AS (SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm, source_file FROM nodes WHERE source_file <> ''), w AS (SELECT *, first_value(id) OVER (PARTITION BY norm, source_file ORDER BY length(id), id) AS new FROM e WHERE norm <> '') SELECT id AS old, new FROM w WHERE id <> new")
def exact_entities(spark, d):
    return E.exact_pairs(nodes(spark, d).withColumn("file_type", F.lit("document")), S.entity_norm_ascii(F.col("label")))


@query("id_collisions", "SELECT replace(id, ':', '_') AS id, CASE WHEN starts_with(id, 'part:') THEN label || ' copy' ELSE label END AS label, CASE WHEN starts_with(id, 'part:') THEN 'lib/part.py' ELSE source_file END AS source_file FROM nodes")
def id_collisions(spark, d):
    n = nodes(spark, d).withColumn("id", F.replace("id", F.lit(":"), F.lit("_")))
    copies = n.withColumn("label", F.concat("label", F.lit(" copy"))).withColumn("source_file", F.lit("lib/part.py"))
    return E.resolve_id_collisions(n.unionByName(copies)).select("id", "label", "source_file")


@query(
    "entity_resolution",
    "SELECT id, label FROM nodes UNION ALL SELECT id || '_c1', regexp_replace(label, 't', 'tt') FROM nodes WHERE contains(label, 't') AND file_type = 'code'",
)
def entity_resolution(spark, d):
    g = Graph(_entities(spark, d), edges(spark, d))
    out = E.deduplicate_entities(g, norm=S.entity_norm_ascii(F.col("label")))
    return out.nodes.select("id", "label")


@query("cypher_edges", "SELECT 'MATCH (a {id: ''' || source || '''}), (b {id: ''' || target || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' AS line FROM edges")
def cypher_edges(spark, d):
    return K.cypher_lines(graph(spark, d)).where("section = 1").select("line")


@query("cypher_nodes", "SELECT 'MERGE (n:' || upper(file_type[1]) || file_type[2:] || ' {id: ''' || id || '''}) SET n.label = ''' || label || ''', n.source_file = ''' || source_file || ''';' AS line FROM nodes")
def cypher_nodes(spark, d):
    return K.cypher_lines(graph(spark, d)).where("section = 0").select("line")


@query("neo4j_edges", "SELECT upper(relation) AS type, source, target FROM edges")
def neo4j_edges(spark, d):
    return K.neo4j_edges(graph(spark, d)).select("type", "source", "target")


@query("node_link_scores", "SELECT source, target, relation, _ord, CASE confidence WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END::DOUBLE AS confidence_score FROM edges")
def node_link_scores(spark, d):
    return K.node_link(graph(spark, d))[1].select("source", "target", "relation", "_ord", "confidence_score")


@query("note_names", "SELECT id, CASE WHEN n = 1 THEN base ELSE base || '_' || (n - 1) END AS name FROM (SELECT id, base, row_number() OVER (PARTITION BY lower(base) ORDER BY _ord, id) AS n FROM (SELECT *, replace(label, '#', '_') AS base FROM nodes))")
def note_names(spark, d):
    return K.note_names(nodes(spark, d))


ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def data_sql(domain: str, columns: dict[str, str]) -> str:
    """The data elements of a node or an edge, in order; columns that are null are left out."""
    return " || ".join(f"coalesce('<data key=\"{domain}_{c}\">' || {e} || '</data>', '')" for c, e in columns.items())


GRAPHML_NODE = data_sql("n", {"label": ESCAPED.format("label"), "file_type": "file_type", "source_file": ESCAPED.format("source_file"), "source_location": "source_location", "community": "CAST(community AS VARCHAR)"})
GRAPHML_EDGE = data_sql("e", {"relation": "relation", "confidence": "confidence", "weight": "CAST(weight AS VARCHAR)", "context": "context", "source_file": ESCAPED.format("source_file")})
GRAPHML_HEAD = [
    *[f'<key id="n_{c}" for="node" attr.name="{c}" attr.type="{t}"/>' for c, t in (("label", "string"), ("file_type", "string"), ("source_file", "string"), ("source_location", "string"), ("community", "long"))],
    *[f'<key id="e_{c}" for="edge" attr.name="{c}" attr.type="{t}"/>' for c, t in (("relation", "string"), ("confidence", "string"), ("weight", "double"), ("context", "string"), ("source_file", "string"))],
    '<graph edgedefault="directed">',
]
GRAPHML_FRAME = [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), *[(1, i, h) for i, h in enumerate(GRAPHML_HEAD)], (4, 0, "</graph>"), (4, 1, "</graphml>")]


@query(
    "graphml",
    f"""SELECT 2 AS section, _ord, '<node id="' || {ESCAPED.format("id")} || '">' || {GRAPHML_NODE} || '</node>' AS line FROM nodes
    UNION ALL SELECT 3, _ord, '<edge source="' || {ESCAPED.format("source")} || '" target="' || {ESCAPED.format("target")} || '">' || {GRAPHML_EDGE} || '</edge>' FROM edges
    UNION ALL SELECT * FROM (VALUES {", ".join(f"({a}, {b}, '{c}')" for a, b, c in GRAPHML_FRAME)}) f(section, _ord, line)""",
)
def graphml(spark, d):
    return K.graphml_lines(graph(spark, d))


NAMED = "named AS (SELECT id, CASE WHEN n = 1 THEN base ELSE base || '_' || (n - 1) END AS name FROM (SELECT id, base, row_number() OVER (PARTITION BY lower(base) ORDER BY _ord, id) AS n FROM (SELECT *, replace(label, '#', '_') AS base FROM nodes)))"


@query(
    "obsidian_notes",
    f"""{NAMED}, link AS (SELECT source AS id, string_agg(line, chr(10) ORDER BY line) AS links FROM (SELECT DISTINCT source, '- ' || relation || ': [[' || name || ']]' AS line FROM edges JOIN named ON named.id = target) GROUP BY source)
    SELECT name || '.md' AS path, '---' || chr(10) || 'id: ' || id || chr(10) || 'source: ' || source_file || chr(10) || 'tags: [' || file_type || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || label || chr(10) || chr(10) || coalesce(links, '') AS text
    FROM nodes JOIN named USING (id) LEFT JOIN link USING (id)""",
)
def obsidian_notes(spark, d):
    return K.obsidian_notes(graph(spark, d))


@query(
    "wiki_pages",
    f"""{DEGREE_ALL}, r AS (SELECT community, label, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY community) AS n, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS k FROM nodes LEFT JOIN deg USING (id) WHERE community IS NOT NULL)
    SELECT 'community_' || community || '.md' AS path, '# Community ' || community || chr(10) || chr(10) || any_value(n) || ' nodes' || chr(10) || chr(10) || string_agg('- ' || label || ' (' || degree || ')', chr(10) ORDER BY k) AS text FROM r WHERE k <= 20 GROUP BY community""",
)
def wiki_pages(spark, d):
    return K.wiki_pages(graph(spark, d))


@query("callflow_sections")
def callflow_sections(spark, d):
    return K.callflow_sections(graph(spark, d))


@query("page_links", r"""SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages""", graph=False)
def page_links(spark, d):
    return FS.page_links(table(spark, d, "pages"))


@query("page_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""", graph=False)
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", FS.html_text(F.col("html")).alias("text"))


@query("page_markdown")
def page_markdown(spark, d):
    return FS.ingest_pages(table(spark, d, "pages"))


@query("extract_records")
def extract_records(spark, d):
    """Pages and documents as files of a repository: markdown, with a heading each."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("text"))
    return XT.extract(docs)


@query(
    "session_debounce",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS first_ts, max(ts) + INTERVAL 3600 SECOND AS quiet_ts, CAST(count(*) AS BIGINT) AS changes FROM s GROUP BY user_id, k""",
    graph=False,
)
def session_debounce(spark, d):
    return ST.debounced(table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts"), "3600 seconds")


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3", graph=False)
def windowed_counts(spark, d):
    return ST.windowed_counts(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 6))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", graph=False)
def stream_windowed_counts(spark, d):
    """The same counts through a stream that reads the table to its end."""
    import uuid

    name = f"windowed_{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = ST.windowed_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("start", "event_type", "n")


@query("first_seen", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, ts FROM events", graph=False)
def first_seen(spark, d):
    return ST.first_seen(table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts"))


@query("pack_chunks")
def pack_chunks(spark, d):
    units = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), S.token_estimate(F.col("text")).alias("tokens"), F.lit(False).alias("is_image"))
    return W.pack_chunks(units, 20_000)


@query("chunk_slices")
def chunk_slices(spark, d):
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, a, b) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b in W.slices(t or "", 4000)], columns=["doc_id", "start", "end"])

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, start long, end long")


def _queries(spark, d):
    return GraphQueries(graph(spark, d))


@query("query_graph")
def query_graph(spark, d):
    answer = _queries(spark, d).query_graph("Which customer is in the nation?", depth=2, token_budget=500)
    return spark.createDataFrame([(answer,)], "answer string")


@query("explain_node", "x AS (SELECT 'in' AS direction, source AS id, relation FROM edges WHERE target = 'nation:3' UNION ALL SELECT 'out', target, relation FROM edges WHERE source = 'nation:3') SELECT direction, id, label, relation FROM x JOIN nodes USING (id)")
def explain_node(spark, d):
    return _queries(spark, d).get_neighbors("nation:3").select("direction", "id", "label", "relation")


@query("get_community", "SELECT id, label, source_file FROM nodes WHERE community = 7")
def get_community(spark, d):
    return _queries(spark, d).get_community(7)
