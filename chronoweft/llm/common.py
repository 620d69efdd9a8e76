"""What the operators of this subpackage share: scratch tables, batch mapping, sampling."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.operators.graph import scratch_dir

#: Words are maximal runs of anything but these six ASCII white-space characters (bytes.split() cuts at the same ones).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_HASH_SPAN = 1 << 30
#: So many values may be sampled by with a broadcast; more, e.g. of a dirty column, with a shuffle.
_BROADCAST_VALUES = 10_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()  # plans that nothing refers to any more let go of their shuffle files
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows in an Arrow batch at most: batches of Spark's usual 10,000 whole texts take too much memory outside the heap.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_held: dict[str, dict] = {}


def held_by(operator: str) -> dict:
    """What an operator keeps in a worker process from task to task, e.g. caches of words; another operator's first task there lets go of it."""
    if operator not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[operator] = {}
    return _held[operator]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512, operator: str = "") -> DataFrame:
    """mapInArrow in slices of `rows` rows, so that Python holds few texts at once. make() builds the function once a task; operator: see held_by."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by(operator)
        f = make()
        for b in batches:
            for start in range(0, b.num_rows, rows):
                yield f(b.slice(start, rows))

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def held_out(id_column: str = "doc_id") -> Column:
    """True for the fifth of the rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def one_label(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(key, label) with labels of 0 or 1; of several labels of a key the larger."""
    return labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND key IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))


def bounded_sample(df: DataFrame, by: str, bound: int, key: str, seed: str) -> DataFrame:
    """About `bound` rows of each value of `by` at most, chosen by a hash of `key`; any number of values.

    Rows of one key are taken or left together, so a key that very many rows share is in the sample with all of them or with none:
    callers that bring the sample to the driver deduplicate it by key first.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("__n"))
    shares = counts.select(F.col(by).alias("__by"), (F.lit(_HASH_SPAN) * F.least(F.lit(1.0), F.lit(float(bound)) / F.col("__n"))).cast("long").alias("__share"))
    few = shares.limit(_BROADCAST_VALUES + 1).collect()
    if len(few) <= _BROADCAST_VALUES:
        shares = F.broadcast(df.sparkSession.createDataFrame(few, shares.schema))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(_HASH_SPAN))
    return df.join(shares, F.col(by) == F.col("__by")).filter(place < F.col("__share")).drop("__by", "__share")
