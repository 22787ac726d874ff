"""Trade tapes: typed readers, and the tape that is derived from the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks import batch_sink
from ..storage import dimension

SCHEMA = (
    "root string, contract_symbol string, exchange_time timestamp_ntz, available_at timestamp_ntz, price double, quantity double, minimum_tick double, "
    "source_event_id string, source_sequence long, trade_condition string, source_flags array<string>, tick_type string, arrival long"
)


#: Columns that a tick cannot do without.
REQUIRED = ("root", "contract_symbol", "exchange_time", "available_at", "price", "quantity", "minimum_tick", "tick_type", "arrival")
CORRUPT = "corrupt_record"


def judged(raw: DataFrame) -> DataFrame:
    """raw ticks with `fault`: corrupt (the reader kept its text alone), missing:<first required column without a value>, known_late (delivered before it happened), or null for a sound row."""
    late = F.when(F.col("exchange_time") > F.col("available_at"), "known_late")
    missing = [F.when(F.col(c).isNull(), f"missing:{c}") for c in REQUIRED]
    corrupt = [F.when(F.col(CORRUPT).isNotNull(), "corrupt")] if CORRUPT in raw.columns else []
    return raw.withColumn("fault", F.coalesce(*corrupt, *missing, late))


def kept(rows: DataFrame) -> DataFrame:
    """The sound rows of judged(), without its columns."""
    return rows.filter("fault is null").drop("fault", CORRUPT)


def rejects(rows: DataFrame) -> DataFrame:
    """The other rows of judged(): they go to a table of their own, and none is lost."""
    return rows.filter("fault is not null")


def reject_counts(rows: DataFrame) -> DataFrame:
    """(root, fault, n) of judged() rows; sound rows have a null fault, so the counts add up to all rows in."""
    return rows.groupBy("root", "fault").agg(F.count("*").alias("n"))


def _permissive(reader, kind: str):
    """A reader of the declared schema that keeps what it cannot read as text, where the format has text."""
    schema = SCHEMA if kind == "parquet" else f"{SCHEMA}, {CORRUPT} string"
    reader = reader.schema(schema).format(kind)
    return reader if kind == "parquet" else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def read_tape(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """All rows of a tape (parquet, json) with their `fault`; kept() and rejects() divide them."""
    return judged(_permissive(spark.read, kind).load(path))


def read_tape_stream(spark: SparkSession, path: str, kind: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return judged(_permissive(spark.readStream, kind).option("maxFilesPerTrigger", files_per_trigger).load(path))


def dividing_sink(kept_path: str, rejects_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over read_tape_stream(): sound rows and rejects to a table each, both safe to repeat."""
    good, bad = batch_sink(kept_path), batch_sink(rejects_path, ("fault",))

    def write(rows: DataFrame, batch: int) -> None:
        good(kept(rows), batch)
        bad(rejects(rows), batch)

    return write


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """The sound rows of a Parquet tape; read_tape() has the others too."""
    return kept(read_tape(spark, path))


def read_trades_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return kept(read_tape_stream(spark, path, files_per_trigger=files_per_trigger))


def split_ticks(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, other ticks)."""
    return ticks.filter("tick_type = 'TRADE'"), ticks.filter("tick_type <> 'TRADE'")


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a tape of two roots with one roll each; some rows are bad or delivered twice, so each check has work."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    root = F.when(F.col("event_type").isin("click", "view", "purchase"), "ES").otherwise("6E")
    e = e.withColumn("root", root).withColumn("copy", F.explode(F.when(F.col("event_id") % 83 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    month = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "H24").otherwise("M24")
    price = 100 + F.floor(F.col("value") * 4) / F.lit(4.0) + F.when(F.col("event_id") % 101 == 0, 0.1).otherwise(0.0)
    quantity = F.when(F.col("event_id") % 89 == 0, 0).otherwise(1 + F.col("event_id") % 5).cast("double")
    flags = F.when(F.col("event_id") % 97 == 0, F.array(F.lit("SOURCE_SUSPICIOUS"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        "root",
        F.concat("root", month).alias("contract_symbol"),
        F.col("ts").alias("exchange_time"),
        (F.col("ts") + F.expr("interval 1 second")).alias("available_at"),
        price.alias("price"),
        quantity.alias("quantity"),
        F.lit(0.25).alias("minimum_tick"),
        F.col("event_id").cast("string").alias("source_event_id"),
        F.lit(None).cast("long").alias("source_sequence"),
        flags.alias("source_flags"),
        F.when(F.col("event_type") == "error", "QUOTE").otherwise("TRADE").alias("tick_type"),
        (F.col("event_id") * 2 + F.col("copy")).alias("arrival"),
    )


def front_contract(trades: DataFrame, mappings: DataFrame) -> DataFrame:
    """Trades of the contract that was mapped for their root at that time; trades without a mapping are dropped.

    mappings(root, new_mapped_symbol, observed_at, effective_at): a mapping holds
    from when it is both observed and effective to the next. The mapping table is
    a few rows a root, so its intervals are broadcast.
    """
    visible = mappings.withColumn("visible_at", F.greatest("observed_at", "effective_at"))
    until = F.lead("visible_at").over(Window.partitionBy("root").orderBy("visible_at"))
    spans = visible.select(F.col("root").alias("m_root"), F.col("new_mapped_symbol").alias("mapped"), F.col("visible_at").alias("since"), until.alias("until"))
    at = F.col("exchange_time")
    on = (F.col("root") == F.col("m_root")) & (F.col("contract_symbol") == F.col("mapped")) & (at >= F.col("since")) & (F.col("until").isNull() | (at < F.col("until")))
    return trades.join(dimension(spans), on).drop("m_root", "mapped", "since", "until")


def mapped_contracts(mappings: DataFrame) -> DataFrame:
    """Distinct (root, contract_symbol) of both ends of all mapping changes; blank symbols are rejected."""
    both = mappings.select("root", F.col("old_mapped_symbol").alias("contract_symbol")).unionByName(mappings.select("root", F.col("new_mapped_symbol").alias("contract_symbol")))
    return both.filter("trim(contract_symbol) <> ''").distinct()
