"""Clouds and meshes from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators import clouds


def cloud_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per event: its value, its user and its hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("point_id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))


def cloud_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per line: quantity, price in thousands, discount in percent. Order and line don't name a row alone."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = [F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z")]
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("point_id"), *at)


def cloud_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per vector: its first three dimensions, its label as red."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("point_id"), *at, F.col("label").cast("short").alias("red"))


def unit_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.normalize(cloud_embeddings(spark, sf_dir))


def mesh_grid(spark: SparkSession, m: int = 64) -> tuple[DataFrame, DataFrame]:
    """A sheet of m x m cells, two triangles each, with values from a formula: (vertices, faces)."""
    side = m + 1
    i, j = (F.col("id") / side).cast("int"), (F.col("id") % side).cast("int")
    value = ((F.col("id") * 7919) % 1000 / 100.0).alias("value")
    height = ((i * j) % 5 / 10.0).alias("z")
    vertices = spark.range(side * side).select(F.col("id").alias("vid"), (i / float(m)).alias("x"), (j / float(m)).alias("y"), height, value)
    c, r = (F.col("id") / 2).cast("int"), F.col("id") % 2
    a = (c / m).cast("int") * side + c % m
    ring = F.when(r == 0, F.array(a, a + side, a + 1)).otherwise(F.array(a + 1, a + side, a + side + 1))
    return vertices, spark.range(2 * m * m).select(F.col("id").alias("fid"), ring.cast("array<int>").alias("vids"))


def islands(faces: DataFrame, m: int = 64) -> DataFrame:
    """The sheet's faces without every eighth row of cells: it falls into strips."""
    return faces.where((F.col("fid") / (2 * m)).cast("int") % 8 != 7)
