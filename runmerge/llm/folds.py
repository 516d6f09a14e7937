"""Label folds, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text, _y`` of at most ``bound`` labelled rows outside the held-out fold, spread by hash of the id.

    The label side has ``bound`` rows of two numbers at most and is broadcast. Of labels of one id the largest
    counts; null labels and ids are left out.
    """
    some = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (remainder("_id", folds) != held_out))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(some), "_id")
