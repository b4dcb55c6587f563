"""Tables that a plan is cut at: written to the shared folder, read back, and dropped by whoever made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. A session in one process, as in tests, gets a folder of its own where
    none is named; on a cluster that is an error, since other executors could not read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dendrium-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df as a written table: nothing before it is computed again, and losing executors loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


#: Rows that a partition of spread() has on average, at most.
PART_ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df by keys, in as many partitions as its rows ask for, the session's number at least: a task that sorts its part does not
    grow with the table. rows is their number, if it is known; a table's footers tell it without a scan."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-(df.count() if rows is None else rows) // PART_ROWS)), *keys)


def once(df: DataFrame) -> DataFrame:
    """df as a written table, or df itself if it is one; for tables that whoever made them drops."""
    return df if getattr(df, "_stage", None) else staged(df)


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; what is not staged is passed over. A union of
    staged tables names them in _parts."""
    for t in [part for t in tables for part in getattr(t, "_parts", [t])]:
        if path := getattr(t, "_stage", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
