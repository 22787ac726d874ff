"""Intermediate tables as Parquet in the folder that driver and executors share, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a dimension that is broadcast; larger ones are joined by shuffle.
DIMENSION_ROWS = 200_000
#: Spark's setting by which the shuffle files of a query are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_stored: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or on a local master a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tapelens-")
    return f"file://{_local_dirs[app]}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # what is stored needs its shuffles no more; left to the driver's garbage collector they would pile up beside the tables
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store_alone(spark: SparkSession, work: Callable[[], DataFrame], name: str) -> DataFrame:
    """work() as store() writes it; the tables that work() has stored on its way are deleted then, so they must not be read by anything else."""
    paths = _stored.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    out = store(work(), name)
    _delete(spark, paths[before:-1])
    del paths[before:-1]
    return out


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that store() has written for this application; call it when the results that read them are written."""
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def is_small(df: DataFrame, rows: int = DIMENSION_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def dimension(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is of dimension size, which is checked, else unchanged, so that the join is shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if is_small(df) else df
