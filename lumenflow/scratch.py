"""Written tables that cut the lineage of rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_folder: list[str] = []


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names, and read back; a folder of our own, on one machine only, where it is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="lumenflow-rounds-"))
        base = _own_folder[0]
    path = f"{base.rstrip('/')}/lumenflow-rounds-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
