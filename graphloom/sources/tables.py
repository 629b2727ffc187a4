"""The property graph that the star-schema tables describe.

Nodes are regions, nations, customers, suppliers, parts and orders. Edges: nation part_of region,
customer and supplier located_in nation, order references customer, order contains part (one per
line item, so parallel edges occur) and part uses supplier. `_ord` numbers rows in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Its schema is read from the files once per path, which saves a job per reading."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _nodes(df, kind, key, label, file_type, source_file, community, base):
    return df.select(
        F.concat(F.lit(kind + ":"), F.col(key)).alias("id"),
        label.alias("label"),
        F.lit(file_type).alias("file_type"),
        source_file.alias("source_file"),
        F.concat(F.lit("L"), F.col(key) % 500 + 1).alias("source_location"),
        community.cast("bigint").alias("community"),
        (F.lit(base * 10**15) + F.col(key)).cast("bigint").alias("_ord"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None)
    parts = [
        _nodes(t("region"), "region", "r_regionkey", F.col("r_name"), "concept", F.lit(""), none, 1),
        _nodes(t("nation"), "nation", "n_nationkey", F.col("n_name"), "concept", F.lit(""), F.col("n_nationkey"), 2),
        _nodes(t("customer"), "customer", "c_custkey", F.col("c_name"), "document", F.concat(F.lit("customers/"), F.lower("c_mktsegment"), F.lit(".md")), F.col("c_nationkey"), 3),
        _nodes(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "code", F.concat(F.lit("suppliers/nation_"), F.col("s_nationkey"), F.lit(".py")), F.col("s_nationkey"), 4),
        _nodes(t("part"), "part", "p_partkey", F.col("p_name"), "code", F.concat(F.lit("parts/"), F.col("p_brand"), F.lit(".py")), F.col("p_size") + 100, 5),
        _nodes(t("orders"), "order", "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit("()")), "document", F.concat(F.lit("orders/"), F.year("o_orderdate"), F.lit(".md")), none, 6),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """The edges; with repeated, those of `uses` once a line item, for what takes each pair once anyway."""
    t = lambda name: table(spark, sf_dir, name)

    def edge(df, source, target, relation, confidence, weight, context, source_file, order):
        return df.select(
            source.alias("source"),
            target.alias("target"),
            F.lit(relation).alias("relation"),
            confidence.alias("confidence"),
            weight.cast("double").alias("weight"),
            context.cast("string").alias("context"),
            source_file.alias("source_file"),
            order.cast("bigint").alias("_ord"),
        )

    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c))
    at = lambda base, c: F.lit(base * 10**15) + c
    sure, one, none, empty = F.lit("EXTRACTED"), F.lit(1.0), F.lit(None), F.lit("")
    lines = t("lineitem")
    used = lines.select("l_partkey", "l_suppkey")
    by_flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    parts = [
        edge(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "part_of", sure, one, none, empty, at(1, F.col("n_nationkey"))),
        edge(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "located_in", sure, one, none, F.concat(F.lit("customers/"), F.lower("c_mktsegment"), F.lit(".md")), at(2, F.col("c_custkey"))),
        edge(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "located_in", sure, one, none, F.concat(F.lit("suppliers/nation_"), F.col("s_nationkey"), F.lit(".py")), at(3, F.col("s_suppkey"))),
        edge(t("orders"), key("order", "o_orderkey"), key("customer", "o_custkey"), "references", sure, one, none, F.concat(F.lit("orders/"), F.year("o_orderdate"), F.lit(".md")), at(4, F.col("o_orderkey"))),
        edge(lines, key("order", "l_orderkey"), key("part", "l_partkey"), "contains", by_flag, F.col("l_quantity"), F.when(F.col("l_linestatus") == "O", "call").otherwise("import"), empty, at(5, (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("bigint") * 3 + F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2))),
        edge(used if repeated else used.distinct(), key("part", "l_partkey"), key("supplier", "l_suppkey"), "uses", F.lit("INFERRED"), one, F.lit("field"), empty, at(6, F.col("l_partkey") * 10**6 + F.col("l_suppkey"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


#: The same two relations for the SQL counterparts, as common table expressions.
GRAPH_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, '' AS source_file, 'L' || (r_regionkey % 500 + 1) AS source_location,
         CAST(NULL AS BIGINT) AS community, 1000000000000000 + r_regionkey AS _ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'concept', '', 'L' || (n_nationkey % 500 + 1), n_nationkey, 2000000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'document', 'customers/' || lower(c_mktsegment) || '.md', 'L' || (c_custkey % 500 + 1), c_nationkey, 3000000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'suppliers/nation_' || s_nationkey || '.py', 'L' || (s_suppkey % 500 + 1), s_nationkey, 4000000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'code', 'parts/' || p_brand || '.py', 'L' || (p_partkey % 500 + 1), p_size + 100, 5000000000000000 + p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order_' || o_orderkey || '()', 'document', 'orders/' || year(o_orderdate) || '.md', 'L' || (o_orderkey % 500 + 1), NULL, 6000000000000000 + o_orderkey FROM orders),
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS weight,
         CAST(NULL AS VARCHAR) AS context, '' AS source_file, 1000000000000000 + n_nationkey AS _ord FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL, 'customers/' || lower(c_mktsegment) || '.md', 2000000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL, 'suppliers/nation_' || s_nationkey || '.py', 3000000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'references', 'EXTRACTED', 1.0, NULL, 'orders/' || year(o_orderdate) || '.md', 4000000000000000 + o_orderkey FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
         l_quantity, CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'import' END, '', 5000000000000000 + (l_orderkey * 100 + l_linenumber) * 1000 + CAST(l_quantity AS BIGINT) * 3 + CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'uses', 'INFERRED', 1.0, 'field', '', 6000000000000000 + l_partkey * 1000000 + l_suppkey FROM lineitem)
"""
