"""Shared pieces of the training-data operators: tables and sizes; storage is the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shipping import ship
from ..storage import shared_dir, store, store_alone

#: Largest side, in bytes, that an operator broadcasts; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

__all__ = ["by_row", "crc_mod", "shared_dir", "sized_broadcast", "small_enough", "store", "store_alone", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows take at most `limit` bytes; row_bytes gives each row's size. One aggregate over a stored table."""
    size = df.select(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0]
    return (size or 0) <= limit


def sized_broadcast(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough, else unchanged, so that the join is shuffled and AQE can split hot keys."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def crc_mod(id_column: str, n: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def by_row(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *ids: str) -> DataFrame:
    """work(docs) as if every row had an id of its own, in the columns doc_id and `ids` of the result.

    Whole-number ids that are unique and not null serve as they are. Otherwise rows are
    numbered in the order of (doc_id, text), null ids first, by one sort by range, and
    the numbers in the result are exchanged for the rows' ids. Rows that are equal in
    both may change places.
    """
    ids = ("doc_id", *ids)
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        rows, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
        if rows == distinct:
            return work(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.sha2(F.col("text").cast("binary"), 256).asc_nulls_first()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = store(docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    names = numbered.select("__row", F.col("doc_id").alias("__id"))
    out = work(numbered.withColumn("doc_id", F.col("__row")).drop("__row"))
    columns = out.columns
    for c in ids:
        out = out.join(names.withColumnRenamed("__row", c), c, "left").drop(c).withColumnRenamed("__id", c)
    return out.select(columns)
