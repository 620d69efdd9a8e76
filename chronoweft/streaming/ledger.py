"""A ledger of the newest row of each key, kept by buckets of the key's hash: a batch reads and writes only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweft.operators.catalog import upsert

_MANIFEST = "bucket int, version long, number long"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _child(spark: SparkSession, folder, child: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, child)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders path/name=number; for name `manifest` only of those that were finished."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return []
    found = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if name != "manifest" or fs.exists(_child(spark, p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Version of each bucket after a batch; at most one entry a bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest={number}").collect()}


def _rows(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{path}/version={v}/__bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _expire(spark: SparkSession, path: str, keep: int) -> None:
    """Removes the manifests but for the last `keep`, and the buckets of versions that none of those names."""
    finished = _numbers(spark, path, "manifest")
    kept, old = finished[-keep:], finished[:-keep]
    named = {(v, b) for n in kept for b, v in _manifest(spark, path, n).items()}
    fs, _ = _folder(spark, path)
    for n in old:
        fs.delete(_folder(spark, f"{path}/manifest={n}")[1], True)
    for v in _numbers(spark, path, "version"):
        if v > kept[-1]:
            continue
        where = _folder(spark, f"{path}/version={v}")[1]
        held = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("__bucket=")]
        gone = [p for p in held if (v, int(p.getName().split("=")[1])) not in named]
        for p in gone:
            fs.delete(p, True)
        if len(gone) == len(held):
            fs.delete(where, True)


def apply_batch(batch: DataFrame, number: int, path: str, keys: list[str], newest: str, buckets: int = 256, keep: int = 2) -> None:
    """Brings the rows of a batch into the ledger below path; a batch without rows changes nothing.

    Rows of the touched buckets are read, merged as catalog.upsert does (the newest of a key; of equally new ones that of the later batch) and written as version=number,
    one folder a bucket. Then manifest=number says which version holds each bucket: the batch counts once that is finished. A batch that is run again starts from the
    manifest before it and writes the same rows again. Buckets that the last `keep` manifests don't name are removed, so that readers of the manifest before aren't cut off.
    The number of buckets is fixed when the ledger begins, and a bucket is written by one task, so it should grow with the ledger; manifests have one row a bucket.
    Rows with null keys share a key.
    """
    if buckets < 1 or keep < 2:
        raise ValueError("at least one bucket and two manifests: a batch that is run again starts from the manifest before it")
    spark = batch.sparkSession
    before = [n for n in _numbers(spark, path, "manifest") if n < number]
    versions = _manifest(spark, path, before[-1]) if before else {}
    bucket = bucket_of(keys, buckets)
    batch = batch.persist()
    try:
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return
        old = _rows(spark, path, {b: versions[b] for b in touched if b in versions}, batch.schema)
        new = upsert(old, upsert(batch.limit(0), batch, keys, newest), keys, newest)
        new.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/version={number}")
        after = versions | dict.fromkeys(touched, number)
        rows = [(b, v, number) for b, v in sorted(after.items())]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number}")
    finally:
        batch.unpersist()
    _expire(spark, path, keep)


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the ledger after its last finished batch; empty before the first."""
    finished = _numbers(spark, path, "manifest")
    return _rows(spark, path, _manifest(spark, path, finished[-1]) if finished else {}, schema)


def ledger_stream(updates: DataFrame, path: str, keys: list[str], newest: str, checkpoint: str, buckets: int = 256, keep: int = 2):
    """Starts a query that brings each batch of updates into the ledger below path, as apply_batch does, and ends when all there is has been read."""
    merge = lambda batch, number: apply_batch(batch, number, path, keys, newest, buckets, keep)
    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
