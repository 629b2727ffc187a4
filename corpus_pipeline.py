"""The corpus pipeline over documents.

Each stage works on all rows that its predecessor kept and returns the columns of documents, but for
the last, which returns token ids. run() writes every stage's rows as Parquet in the shared scratch
folder and reads them again, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, pieces, quality, secrets, simhash
from graphloom.llm.support import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; n_chars follows the text."""
    from pyspark.sql import functions as F

    hidden = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("text").contains("[SECRET]")
        hidden = hidden.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return hidden.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix of sources takes them; a row that it takes n times occurs n times."""
    return mixing.take_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and the proof that they decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
