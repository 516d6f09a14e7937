"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: A white-space character and a word, as the contracts define them (Java and DuckDB read both patterns alike).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint.

    It goes to the shared folder, which is set for the session if it isn't yet. With ``free``, the shuffle files that
    it was computed through are deleted once it is written; Spark else keeps them for as long as the driver may refer to them.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if not free:
        return df.checkpoint()
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()  # the setting is taken when a DataFrame is made


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run within pass ``rows`` rows at a time to Python, so that batches of long texts take less memory on both sides."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def whole(text_col: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def row_ids(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a row number that is unique, and the same whenever the same files are scanned again.

    It is made directly over a file scan, whose splits and row order the driver plans alike each time, so a
    task that is run again after a lost executor numbers its rows as before. ``name`` gets underscores until
    it is free.
    """
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.monotonically_increasing_id())
