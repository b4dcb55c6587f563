"""What the training-data operators share: table access, cutting lineage, fixed patterns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: what separates words, and a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage. Where none is named, a session in one process, as in tests, gets a
    folder of its own; on a cluster that would lose data, so it is an error there."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dendrium-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and lost
    executors lose nothing of it. Its true size is known to later joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._dendrium_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame | None) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_dendrium_path", None)
    if path:
        remove(df.sparkSession, path)


def _give_back() -> None:
    """Memory that is free in this process goes back to the system, as far as its allocators can do that."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, without what it has freed: workers are kept for later tasks, of later operators too, and
    would hold on to the largest amount that any of them took."""

    def lean_run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(each())
        _give_back()

    return lean_run


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 2 modulo 4; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
