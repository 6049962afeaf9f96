"""Cutting lineage by written tables in the folder that all machines share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

LOCAL = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written and read back; the folder is spark.checkpoint.dir, or a local one on a local master.

    Unlike a checkpoint, which computes its input twice and forgets its size,
    a written table tells joins how small it is: a small frontier is broadcast
    when the plan is made, and a large edge table stays where it is.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs(LOCAL, exist_ok=True)
        at = "file://" + LOCAL
    path = f"{at.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
