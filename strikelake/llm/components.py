"""Connected components by alternating large and small stars, every step a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.session import fresh_dir


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows written once to the shared folder and read again, which also cuts their lineage."""
    path = fresh_dir(df.sparkSession, label)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("u", "m")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; the root is the component's smallest node.

    Self-loops don't count. A node with very many edges only meets aggregations with a map-side combine and
    joins against one row per node, whose large side AQE splits. The number of steps grows with the
    logarithm of the longest path.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        now = stored(_small_star(_large_star(now)), "stars")
    return now.toDF("node", "root").union(now.select("b", "b").distinct())
