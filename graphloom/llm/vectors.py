"""What the vector searches share: which vectors take part, blocks of queries, merging of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize, scratch_path

QUERY_VALUES = 1 << 21  # components of the queries that are searched for at once
ANSWERS = "query_row long, query_id long, vec_id long, score {score}"


def usable(vectors: DataFrame, zero_too: bool, label: str) -> DataFrame:
    """(row, vec_id, n, v array<double>) of the vectors that take part, n their length, as a written table.

    Left out are null ids, null and empty vectors, those with a null or non-finite component, and zero
    vectors unless zero_too. Vectors are searched among those of their own length. Rows that repeat a
    vec_id are vectors of their own, told apart by row: each is a query, and a candidate of the other.
    """
    v = F.col("embedding").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("n"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.col("n") > 0) & ~F.exists("v", odd))
    if not zero_too:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "n", "v"), label)


def lengths(rows: DataFrame) -> list[tuple[int, int]]:
    """(length, number of vectors) for every length that occurs."""
    return [(r[0], r[1]) for r in rows.groupBy("n").count().orderBy("n").collect()]


def query_blocks(rows: DataFrame, n: int, modulus: int) -> Iterator[tuple]:
    """(rows, ids, matrix) of the vectors of length n whose id is divisible by modulus, about QUERY_VALUES components at a time.

    The queries are written once, by block; only the block at work is on the driver.
    """
    import numpy as np

    spark = rows.sparkSession
    asked = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0)
    blocks = -(-asked.count() * n // QUERY_VALUES)
    if not blocks:
        return
    path = scratch_path(spark, "query-blocks")
    asked.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).write.partitionBy("block").parquet(path)
    written = spark.read.schema("row long, vec_id long, v array<double>, block int").parquet(path)
    for b in range(blocks):
        part = written.where(F.col("block") == b).orderBy("row").select("row", "vec_id", "v").toArrow()  # one block
        if part.num_rows:
            yield part.column("row").to_numpy(), part.column("vec_id").to_numpy(), np.concatenate([matrix(c) for c in part.column("v").chunks if len(c)])


def matrix(column):
    """A list column of equal lengths as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def search_all(searches: Iterator[tuple], task: Callable, k: int, score: str, spark) -> DataFrame:
    """query_id, rank, vec_id and score: the k best answers of every search.

    A search is an index table and a block of queries (rows, ids, matrix), which goes to the workers;
    its answers are written before the next block is read, so that neither the plan nor the driver
    grows with the queries. task(sent) is the function over Arrow batches of an index.
    """
    schema, path = ANSWERS.format(score=score), scratch_path(spark, "answers")
    final = f"query_id long, rank int, vec_id long, score {score}"
    spark.createDataFrame([], final).write.parquet(path)
    for index, queries, model in searches:
        sent = spark.sparkContext.broadcast((queries, model))  # one block of queries and a model of fixed size
        best(index.mapInArrow(task(sent, k), schema), k).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(final).parquet(path)


def best(answers: DataFrame, k: int) -> DataFrame:
    """The k best answers of each query, ranked; ties go to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Found:
    """The k best answers so far of every query of a block."""

    def __init__(self, queries: int, k: int, dtype):
        import numpy as np

        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, dtype)] * queries

    def add(self, q: int, ids, scores) -> None:
        import numpy as np

        ids, scores = np.append(self.ids[q], ids), np.append(self.scores[q], scores)
        order = np.lexsort((-ids, scores))[::-1][: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]

    def batches(self, rows, ids):
        """Arrow batches of ANSWERS."""
        import numpy as np
        import pyarrow as pa

        for at in range(0, len(ids), 1024):
            part = slice(at, at + 1024)
            size = [len(x) for x in self.ids[part]]
            columns = [np.repeat(rows[part], size), np.repeat(ids[part], size), np.concatenate(self.ids[part]), np.concatenate(self.scores[part])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])
