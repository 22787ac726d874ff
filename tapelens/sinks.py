"""Where results go: tables by partition, stream batches that may come twice, JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.constraints import RULES, observed

PARTITIONS = ("root", "contract_symbol")
REPORT = "table_name string, rule string, violations long, n_rows long"


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = PARTITIONS) -> None:
    """Write rows below path by partition; partitions that rows do not touch keep their files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = PARTITIONS) -> list[tuple[str, str, int, int]]:
    """Write each table and count its violations in the same pass; returns the report (table_name, rule, violations, n_rows), which reports/constraints holds as JSON."""
    report: list[tuple[str, str, int, int]] = []
    spark: SparkSession | None = None
    for name, rows in tables.items():
        spark = rows.sparkSession
        if name not in RULES:
            write_table(rows, f"{path}/{name}", by)
            continue
        watched, seen = observed(rows, name)
        write_table(watched, f"{path}/{name}", by)
        counts = seen.get
        report += [(name, rule, counts[rule], counts["n_rows"]) for rule in RULES[name]]
    if spark is not None:
        write_report(spark.createDataFrame(report, REPORT), path, "constraints")
    return report


def write_report(rows: DataFrame, path: str, name: str, order: tuple[str, ...] = ()) -> None:
    """A report, which is small, as one sorted file of JSON lines; nulls are written."""
    ordered = rows.orderBy(*order) if order else rows
    ordered.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/reports/{name}")


def batch_sink(path: str, by: tuple[str, ...] = ("root",)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is the partition of its number, so one that comes again replaces itself and changes nothing.

    Rows of a batch that was killed stay in the staging folder and are never read;
    the batch is written whole when the stream takes it up again.
    """

    def write(rows: DataFrame, batch: int) -> None:
        write_table(rows.withColumn("batch_id", F.lit(batch).cast("long")), path, ("batch_id", *by))

    return write
