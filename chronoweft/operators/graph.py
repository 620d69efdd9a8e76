"""Entity resolution on edges: connected components and the row that stands for each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir; a local one of our own only where it is unset and Spark runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chronoweft-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    Each round every id takes the smallest label among its neighbours and then that label's label, until no label changes.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = cut_lineage(spread.join(above, "component", "left").select("id", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def keepers(rows: DataFrame, classes: DataFrame, quality: Sequence, key: str = "id") -> DataFrame:
    """rows (key, ...) with their component and whether each is the one to keep: the first by quality, then by key; rows without an edge stand alone."""
    from pyspark.sql import Window

    named = rows.join(classes.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))
    best = F.row_number().over(Window.partitionBy("component").orderBy(*quality, key))
    return named.withColumn("keep", best == 1)
