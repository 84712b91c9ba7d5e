"""Helpers that the corpus operators share: the shared folder, materialised tables and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.functions.shared import new_folder, shared_folder  # noqa: F401  the operators take them from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that go to a Python worker at once; texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of whole texts, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores before it as make it differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids that are sent to every executor at most (some 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
