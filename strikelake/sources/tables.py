"""Readers: landed text to typed tables, and the partitioned candle table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.schemas import CANDLES, INSTRUMENTS, as_landing


def typed(landed: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their types; what does not parse becomes NULL instead of failing the load."""
    return landed.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A landing folder of JSON or CSV files, read with a fixed schema and without inference."""
    reader = spark.read.schema(as_landing(schema))
    if fmt == "csv":
        reader = reader.option("header", True)
    return typed(reader.format(fmt).load(path), schema)


CORRUPT, REASONS, RECORD = "_corrupt", "reasons", "record"
# What a row is worth nothing without.
REQUIRED = {"candles": ("instrument_token", "expiry", "date", "close"), "instruments": ("instrument_token", "name", "expiry", "instrument_type")}


def judged(landed: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Landed text with ``reasons``: the columns whose text is no value of their type, and required ones without any.

    A record that is no row at all, which the reader puts into ``_corrupt``, has the reason ``record``.
    """
    found = []
    if CORRUPT in landed.columns:
        found.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(RECORD)))
    for f in schema:
        if f.name in landed.columns:
            text = F.col(f.name)
            wrong = text.isNotNull() & text.try_cast(f.dataType).isNull()
            missing = text.isNull() if f.name in required else F.lit(False)
            found.append(F.when(wrong | missing, F.lit(f.name)))
    reasons = F.array_compact(F.array(*found))
    if CORRUPT in landed.columns:  # of a broken record the missing columns say nothing more
        reasons = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit(RECORD))).otherwise(reasons)
    return landed.withColumn(REASONS, reasons)


def read_judged(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", required: Sequence[str] = ()) -> DataFrame:
    """A landing folder as text with ``reasons``; nothing is dropped, not even lines that are no record."""
    text = T.StructType([*as_landing(schema).fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        reader = reader.option("header", True)
    return judged(reader.format(fmt).load(path), schema, required)


def accepted(judged_rows: DataFrame, schema: T.StructType) -> DataFrame:
    return typed(judged_rows.where(F.size(REASONS) == 0), schema)


def rejected(judged_rows: DataFrame) -> DataFrame:
    """The rows to be looked at, as they landed."""
    return judged_rows.where(F.size(REASONS) > 0)


def load_instruments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_landed(spark, path, INSTRUMENTS, fmt)


def load_candles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed candles; ``day`` is derived from the bar time."""
    return read_landed(spark, path, CANDLES, fmt).withColumn("day", F.to_date("date"))


def read_instruments(spark: SparkSession, path: str, name: str | None = None,
                     segment: str | None = None) -> DataFrame:
    """The instrument snapshot; both filters prune its partitions."""
    df = spark.read.schema(INSTRUMENTS).parquet(path)
    if name is not None:
        df = df.where(F.col("name") == name)
    if segment is not None:
        df = df.where(F.col("segment") == segment)
    return df


def read_candles(spark: SparkSession, path: str, refresh: bool = False) -> DataFrame:
    """The candle table, partitioned by (expiry, day). ``refresh`` drops file listings cached by a
    long-lived session."""
    if refresh:
        spark.catalog.refreshByPath(path)
    return spark.read.schema(CANDLES).parquet(path)
