"""Tables in and out, and generators of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def as_queries(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("id").alias("query_id"), "vec")


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """n rows of independent standard normal components."""
    return spark.range(n).select("id", F.array(*[F.randn(seed + i).cast("float") for i in range(dim)]).alias("vec"))


def uniform(spark: SparkSession, n: int, dim: int, low: float, high: float, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", F.array(*[(F.rand(seed + i) * (high - low) + low).cast("float") for i in range(dim)]).alias("vec"))


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, spread: float = 5.0, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """Rows around Gaussian centres; row i belongs to centre i mod clusters."""
    centres = gaussian(spark, clusters, dim, seed).select(F.col("id").alias("cluster"), F.col("vec").alias("centre"))
    rows = gaussian(spark, n, dim, seed + 1000).withColumn("cluster", F.col("id") % clusters)
    return rows.join(F.broadcast(centres), "cluster").select("id", F.zip_with("vec", "centre", lambda x, c: (x * noise + c * spread).cast("float")).alias("vec"))


def write_records(df: DataFrame, path: str) -> None:
    """Benchmark rows as JSON lines."""
    df.write.mode("overwrite").json(path)
