"""Incremental runs: landed files as streams, replay-safe sinks, feedback upserts."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ludomill.operators.ordered import last_per_key
from ludomill.session import SETTINGS, fresh_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Pause between runs and titles per flush of the periodic job.
RUN_EVERY = "10 minutes"
FLUSH_FILES = 10
# Rows of a batch that wait until the first of their keys are picked.
_PICK_ROWS = 1 << 18
# 0 where a key was known before the stream began.
_NEW = "_new"


def landed_stream(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*", files_per_batch: int = FLUSH_FILES
) -> DataFrame:
    """New parquet files of a folder as a stream, a few files per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _first_of_batch(keys: list[str], order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first row by ``order`` of each key of a partition; missing values come first."""

    def first(table: pa.Table) -> pa.Table:
        by_order = pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
        table = table.take(by_order)
        codes = np.zeros(table.num_rows, np.int64)
        for key in keys:
            column = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
            # Few numbers again before the next key.
            codes = codes * max(len(column.dictionary), 1) + column.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes, return_inverse=True)[1]
        return table.take(pa.array(np.unique(codes, return_index=True)[1]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        kept = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting > kept + _PICK_ROWS:
                held = first(pa.Table.from_batches(held)).to_batches()
                kept = waiting = sum(x.num_rows for x in held)
        if waiting:
            yield from first(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)

    return pick


def unseen(stream: DataFrame, keys: list[str], order: list[str], held: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose key was never seen before; of equal keys in a batch the first by ``order``.

    The keys are state of the stream, without a time limit: a late row counts and no key is forgotten.  A batch costs what
    the batch holds, whatever was seen, and calls Python once for some thousand rows.  ``held`` is a stream of keys that are
    known from the first batch on.
    """
    rows = stream.withColumn(_NEW, F.lit(1))
    if held is not None:
        known = held.select(*keys).withColumn(_NEW, F.lit(0))
        rows = rows.unionByName(known, allowMissingColumns=True)
    first = rows.repartition(*keys).mapInArrow(_first_of_batch(keys, [_NEW, *order]), rows.schema)
    return first.dropDuplicates(keys).filter(F.col(_NEW) == 1).select(*stream.columns)


def unseen_run(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Append the unseen rows of a stream to a table until all that has landed is in.

    The table is read once, when the checkpoint is new, to know the keys it holds; they stay beside the checkpoint
    (``-held``), where each run looks for them.  Every batch is a partition of its own (``batch``), so a replayed batch
    writes the same rows in the same place.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    if not _exists(spark, checkpoint):
        known = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
        known.select(*keys).distinct().write.mode("overwrite").parquet(f"{checkpoint}-held")
    held = spark.readStream.schema(stream.select(*keys).schema).parquet(f"{checkpoint}-held")
    label = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("batch", F.lit(f"{label}-{batch_id}"))
        named.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    rows = unseen(stream, keys, order, held)
    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
    return _with_rocksdb(spark, writer.trigger(availableNow=True).start)


def _with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state needs RocksDB, whatever store the session names; a query keeps the settings it was started with."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, periodic: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table, going on where the last run ended.

    One run handles what has landed and stops; ``periodic`` keeps it up every
    ten minutes.
    """
    trigger = {"processingTime": RUN_EVERY} if periodic else {"availableNow": True}
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything landed and read back the table it wrote."""
    folder = fresh_folder(stream.sparkSession, label)
    table = os.path.join(folder, "table")
    run_to_table(stream, table, os.path.join(folder, "checkpoint")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_feedback(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest version of every bucket of a feedback table (``before``: only older ones)."""
    rows = spark.read.schema(f"{schema}, bucket int, version long").parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    # At most one pair per bucket; as plain conditions they keep old versions from being read.
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()
    current = [(F.col("bucket") == n.bucket) & (F.col("version") == n.version) for n in newest]
    return rows.filter(reduce(or_, current, F.lit(False)))


def apply_feedback(
    batch: DataFrame, version: int, path: str, keys: list[str], order: list[str], buckets: int = 64
) -> None:
    """Upsert a micro-batch: the last row per key by ``order`` wins.

    Every touched bucket is written anew as ``version``; nothing older
    is changed, so a batch that dies half way leaves the table as it was, and
    its replay writes the same version again.
    """
    spark = batch.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    incoming = batch.withColumn("bucket", _bucket(keys, buckets))
    touched = [row.bucket for row in incoming.select("bucket").distinct().collect()]
    if not touched:
        return
    both = incoming
    if _exists(spark, path):
        current = read_feedback(spark, path, schema, before=version)
        both = incoming.unionByName(current.filter(F.col("bucket").isin(touched)).drop("version"))
    # Only older versions are read, so a replay may replace its own while it runs.
    merged = last_per_key(both, keys, order).withColumn("version", F.lit(version).cast("long"))
    writer = merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket", "version")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    _drop_superseded(spark, path, touched, version)


def _drop_superseded(spark: SparkSession, path: str, touched: list[int], version: int) -> None:
    """Of the touched buckets keep the version just written and the one before, which readers may still hold."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for bucket in touched:
        folder = hadoop.Path(f"{path}/bucket={bucket}")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        older = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        older = [v for v in older if v < version]
        for past in older[:-1]:
            files.delete(hadoop.Path(folder, f"version={past}"), True)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def feedback_run(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    order: list[str],
    buckets: int = 64,
    first_version: int = 0,
) -> StreamingQuery:
    """Upsert a stream of plays and ratings into a feedback table and stop when all landed rows are in.

    Batches are numbered from 0 by each checkpoint; a further stream into the
    same table needs a ``first_version`` above the versions already there.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        apply_feedback(batch, first_version + batch_id, path, keys, order, buckets)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
