"""Views over the test tables that stand in for a market feed.

Events act as ticks: four event types are the option legs, ``error`` is the underlying, and the user
picks one of five strikes. Parts act as the instrument master, orders as broker orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.operators.bars import ohlc_bars
from strikelake.schemas import EXCHANGE, FUTURES_SEGMENT, OPTIONS_SEGMENT, STRIKE

SHORT_EXPIRY, LONG_EXPIRY = "2024-02-01", "2024-02-08"
BAR_WIDTH = "6 hours"

# Read from a column: a literal would be folded out of the keys, and plans would no longer be those of
# a table with many underlyings.
def _underlying():
    return F.when(F.col("event_id").isNotNull(), "IDX").alias("name")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _leg_columns(events: DataFrame) -> DataFrame:
    slot, kind = F.col("user_id") % 5, F.col("event_type")
    order = F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "purchase", 2).otherwise(3)
    return events.where(kind != "error").select(
        "ts", "event_id", _underlying(),
        (F.lit(54100) + 100 * slot).cast(STRIKE).alias("strike"),
        F.when(kind.isin("click", "purchase"), "CE").otherwise("PE").alias("instrument_type"),
        F.when(kind.isin("click", "view"), F.lit(SHORT_EXPIRY)).otherwise(F.lit(LONG_EXPIRY))
        .cast("date").alias("expiry"),
        (F.lit(100) + 4 * slot + order).cast("bigint").alias("instrument_token"),
        F.col("value").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leg_columns(table(spark, sf_dir, "events"))


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ticks as a stream over the event files."""
    schema = table(spark, sf_dir, "events").schema
    return _leg_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        "ts", "event_id", _underlying(), (F.lit(54300) + F.col("value")).alias("price"))


def bars(spark: SparkSession, sf_dir: str, width: str = BAR_WIDTH) -> DataFrame:
    return ohlc_bars(ticks(spark, sf_dir), width)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts that traded, as an instrument master."""
    return (ticks(spark, sf_dir)
            .select("instrument_token", "name", "expiry", "strike", "instrument_type").distinct()
            .withColumns({"lot_size": F.lit(15), "segment": F.lit(OPTIONS_SEGMENT),
                          "exchange": F.lit(EXCHANGE)}))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, is_future = F.col("p_partkey"), F.col("p_type") == "STANDARD"
    return table(spark, sf_dir, "part").select(
        key.alias("instrument_token"),
        key.cast("string").alias("exchange_token"),
        F.concat("p_name", F.lit("-"), key.cast("string")).alias("tradingsymbol"),
        F.col("p_brand").alias("name"),
        F.col("p_retailprice").alias("last_price"),
        F.date_add(F.lit(SHORT_EXPIRY).cast("date"), (7 * (key % 4)).cast("int")).alias("expiry"),
        (100 * F.col("p_size")).cast(STRIKE).alias("strike"),
        F.lit(0.05).alias("tick_size"),
        F.lit(15).alias("lot_size"),
        F.when(is_future, "FUT").when(key % 2 == 0, "CE").otherwise("PE").alias("instrument_type"),
        F.when(is_future, FUTURES_SEGMENT).otherwise(OPTIONS_SEGMENT).alias("segment"),
        F.lit(EXCHANGE).alias("exchange"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        F.floor(key / 2).cast("bigint").alias("parent_order_id"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("tradingsymbol"),
        F.when(F.col("o_orderstatus") == "P", "TRIGGER PENDING").otherwise("COMPLETE").alias("status"),
        F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("transaction_type"),
        (1 + key % 50).alias("quantity"),
        F.col("o_totalprice").alias("average_price"),
        "o_orderdate",
    )
