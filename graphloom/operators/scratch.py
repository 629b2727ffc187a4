"""Tables written between the steps of iterative operators.

They lie in the folder that spark.checkpoint.dir names, which all executors see, so that neither a
long lineage nor the loss of an executor costs more than a step. A temporary folder is made only
where none is named and the master is local, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch_folder(spark) -> str:
    """The folder that steps are written to."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df, written once and read back."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
