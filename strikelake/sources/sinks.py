"""Writers: snapshots and the key-wise upsert into a partitioned Parquet table."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.schemas import SERIES

CANDLE_KEY = ["instrument_token", "expiry", "date"]
CANDLE_PARTITIONS = ["expiry", "day"]
# The record of batches is kept in so many files, each with those whose ids fall to its slot.
COMMIT_SLOTS = 64
_COMMIT = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("rows", T.LongType()),
                        T.StructField("mark", T.DecimalType(38, 0)), T.StructField("slot", T.IntegerType())])


def write_snapshot(df: DataFrame, path: str, partitions: Sequence[str] = ("name", "segment")) -> None:
    """Replace a snapshot table. Rows are gathered per partition value first, so a partition is
    written as few files; AQE splits a partition value that is too large for one task."""
    (df.hint("rebalance", *partitions).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(path))


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = (*SERIES, "day")) -> None:
    """Replace a catalogue table whose rows lie in buckets by (series, day), so that what is grouped or joined by these is not
    shuffled again: ``bars.straddle_bars`` with ``dealt``, and the joins on its days."""
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table as it is now, or None if there is none yet."""
    spark.catalog.refreshByPath(path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def commits_path(path: str) -> str:
    """Where the batches that a table has taken in are recorded."""
    return f"{path.rstrip('/')}_commits"


def _recorded(spark: SparkSession, path: str, slot: int) -> list[tuple]:
    """The batches recorded in a slot: the one file of it is read, however many batches there have been."""
    done = read_table(spark, commits_path(path), _COMMIT)
    return [] if done is None else [tuple(r) for r in done.where(F.col("slot") == slot).collect()]


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, and of equal ones by all other columns, so that the choice
    never depends on the order of the rows. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    picked = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(
    batch: DataFrame,
    path: str,
    batch_id: str,
    key: Sequence[str] = CANDLE_KEY,
    partitions: Sequence[str] = CANDLE_PARTITIONS,
    version: str | None = None,
) -> None:
    """Insert new keys and replace known ones; rows that the batch does not mention stay.

    Per key the row with the greatest ``version`` stays, whichever batch brings it and in whatever
    order batches land; the table keeps the column for that. Without a version, and between equal
    ones, the later batch wins.

    Only the partitions the batch touches are read and rewritten, in one job that replaces them as it
    commits. A batch is recorded beside the table with its id, its number of rows and a checksum of them; the
    same batch again is skipped, so replaying an old one undoes nothing, while other rows under a used
    id are taken in. The record is one file per slot of ids, so it neither grows in files nor is read whole. After a crash before the record the batch runs again and gives the same table.
    """
    spark = batch.sparkSession
    order = [version] if version else []
    new = newest(batch, key, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        names = [F.coalesce(F.xxhash64(*sorted(new.columns)), F.lit(0)).cast("decimal(38,0)")]
        bounds = [f(c).alias(f"{f.__name__}_{c}") for c in partitions for f in (F.min, F.max)]
        seen = new.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(names[0]), F.lit(0)).cast("decimal(38,0)").alias("mark"), *bounds).first()
        slot = zlib.crc32(batch_id.encode()) % COMMIT_SLOTS
        done, commit = _recorded(spark, path, slot), (batch_id, seen["rows"], seen["mark"], slot)
        if commit in done:
            return
        if seen["rows"]:
            merged = new
            table = read_table(spark, path, new.schema)
            if table is not None:
                # Literal bounds prune the listing, the semi join keeps exactly the touched partitions.
                for c in partitions:
                    table = table.where(F.col(c).between(seen[f"min_{c}"], seen[f"max_{c}"]))
                old = table.join(new.select(*partitions).distinct(), list(partitions), "left_semi")
                both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
                merged = newest(both, key, [*order, "_late"]).drop("_late")
            (merged.hint("rebalance", *partitions).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))
        (spark.createDataFrame([*done, commit], _COMMIT).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(commits_path(path)))
    finally:
        new.unpersist()


def replace_series(rows: DataFrame, path: str, series: DataFrame, keys: Sequence[str], partitions: Sequence[str] = ("expiry",)) -> None:
    """All rows of the given series replaced by ``rows``; those of other series in the same partitions stay.

    Doing it again gives the same table, so a job that failed half way just runs again. The partitions are columns of the key.
    """
    spark, bounds = rows.sparkSession, [f(c).alias(f"{f.__name__}_{c}") for c in partitions for f in (F.min, F.max)]
    table = read_table(spark, path, rows.schema)
    if table is not None:
        seen = series.agg(*bounds).first()
        for c in partitions:
            table = table.where(F.col(c).between(seen[f"min_{c}"], seen[f"max_{c}"]))
        old = table.join(series.select(*partitions).distinct(), list(partitions), "left_semi").join(series.select(*keys).distinct(), list(keys), "left_anti")
        rows = old.select(*rows.columns).unionByName(rows)
    (rows.hint("rebalance", *partitions).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))
