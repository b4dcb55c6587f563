"""Counts that grow with a stream: each micro-batch of productions is aggregated and added to the table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["lhs", "rhs", "word"]


def grow_grammar(productions: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps rule counts (lhs, rhs, word, n) of a stream of productions. Each batch writes its own counts
    to path/batch=<id>, replacing them if the batch is run again, so a restart counts nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*KEY).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return productions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def grammar_so_far(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy(*KEY).agg(F.sum("n").alias("n"))
