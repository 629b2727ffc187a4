"""Mixing sources to target weights [native].

Every document gets a hash-random key. Within its source the documents are dealt to ranges of
that key (about the square root of the source's rows, so that neither a range nor the list of
range totals of one source is large), each range is sorted, and prefix sums of word counts are
taken in two steps: inside the ranges and over the range totals. A source's budget is then cut
exactly at its prefix sum; budgets above the source's size repeat it in whole epochs first.

Defined results: a null text has size 0; a null source is a source of its own, listed last;
repeated rows count as often as they occur; an empty table gives an empty result; other columns
of the input are not looked at. Equal keys are ordered by doc_id (null first), then by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize, spare, table

WORD = r"[^\x20\x09-\x0D]+"


def sized_rows(docs: DataFrame, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words, a 60-bit key that depends on doc_id and seed alone, and the columns in carry."""
    return docs.select(
        *carry,
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10)
        .cast("long")
        .alias("sort_key"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: its size, rows, weight, capped target, and the budget in epochs and rest.

    Sources are capped in the order of cap * size / weight: one is capped when its bound lies
    below its share of what the sources before it have left, which is where repeated resharing
    ends. The comparison is made on exact decimals.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")).withColumn("weight", w.cast("long"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(19,0)")
    bound = F.lit(cap) * F.col("source_size")
    ranked = totals.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum(bound).over(before), F.lit(0)).alias("bound_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    ).withColumn("capped", exact(bound) * exact(F.col("all_weight") - F.col("weight_before")) <= exact(F.col("weight")) * exact(F.col("all_size") - F.col("bound_before")))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    free_size = F.col("all_size") - F.sum(F.when(F.col("capped"), bound).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), bound.cast("double")).otherwise((F.col("weight") * free_size).cast("double") / free_weight.cast("double"))
    out = ranked.select("source", "source_size", "source_rows", "weight", target.alias("target"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words of the document that the mix takes; after the columns in carry."""
    rows = materialize(sized_rows(docs, seed, carry), "mix-rows")
    targets = materialize(source_targets(rows, weights, cap), "mix-targets")
    null_free = [F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().alias("src_null")]
    ranges = F.ceil(F.sqrt(F.col("source_rows").cast("double")))
    keyed = rows.select(*carry, "doc_id", "size", "sort_key", *null_free).join(targets.select(*null_free, "source_rows"), ["src", "src_null"])
    keyed = keyed.withColumn("range_no", F.least(F.floor(F.col("sort_key") / F.lit(float(2**60)) * ranges), ranges - 1).cast("long"))
    in_range = Window.partitionBy("src", "src_null", "range_no").orderBy("sort_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.select(*carry, "doc_id", "size", "src", "src_null", "range_no", F.coalesce(F.sum("size").over(in_range), F.lit(0)).alias("inside"))
    before = Window.partitionBy("src", "src_null").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("src", "src_null", "range_no")
        .agg(F.sum("size").alias("range_size"))
        .select("src", "src_null", "range_no", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
        .join(targets.select(*null_free, "source_size", "target", "epochs", "rest"), ["src", "src_null"])
    )
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inside")))
    return ordered.join(materialize(offsets, "mix-offsets"), ["src", "src_null", "range_no"]).select(
        *carry, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken")
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs as the mix takes them: one that it takes n times occurs n times.

    The row at a source's cut, of which the mix takes a part, is taken whole if the part is at least
    half of it. Rows without words are in no mix.
    """
    row, times, copy = spare(docs, "__row"), spare(docs, "__times"), spare(docs, "__copy")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    taken = mix(rows, weights, cap, seed, (row,)).where("taken > 0")
    taken = taken.select(row, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    # The hashed side is a row number and a count; texts are neither sorted nor held.
    copies = rows.join(materialize(taken, "mix-taken").hint("shuffle_hash"), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(docs.columns)


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS sort_key
  FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight
  FROM r GROUP BY source),
b AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(3 * source_size) OVER w, 0) AS bound_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM t WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (all_weight - weight_before) <= weight * (all_size - bound_before) AS capped FROM b),
g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * (all_size - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM c),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g),
p AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY sort_key, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM r)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + greatest(0, least(p.size, CAST(floor(e.target + 0.5) AS BIGINT) - e.epochs * e.source_size - p.inside)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
