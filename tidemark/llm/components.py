"""Connected components of an edge table by alternating star contraction, and joins with the hubs that stars have."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ensure_checkpoint_dir, remove_folder


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hung on the smallest of the node and its neighbours; may repeat rows."""
    least = _least(edges).withColumnRenamed("a", "b")
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hung on the smallest of them."""
    least = _least(edges)
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` but the roots themselves.

    ``component`` is the smallest node reachable.  Each round hangs neighbours on
    their smallest neighbour; the number of rounds grows with the logarithm of
    the longest chain.  Only a row count and a checksum reach the driver.
    Loops and repeated edges are allowed; nulls must be gone.
    """
    spark = edges.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen, rounds = None, 0
    while True:
        # files are read by size: a round has few tasks where few edges are left, however many partitions there are
        edges.write.parquet(f"{folder}/{rounds}")
        edges = spark.read.schema(edges.schema).parquet(f"{folder}/{rounds}")
        if rounds:
            remove_folder(spark, f"{folder}/{rounds - 1}")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            found = cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")))
            remove_folder(spark, folder)
            return found
        seen, rounds = tuple(mark), rounds + 1
        edges = _small(_large(edges))


def lookup(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` with the one row of ``table`` for their key; a key of very many rows is dealt over ``salts`` tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    asked = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(asked, [key, "_salt"], how).drop("_salt")
