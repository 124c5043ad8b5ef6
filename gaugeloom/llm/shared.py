"""Helpers that several operators share: shared storage, Arrow mapping, sampling of labels."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import mix

#: Upper bound, in characters, of what one numpy pass works on; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 18
#: Bytes that a task sends to Python at once.
BATCH_BYTES = 8 << 20
#: Most bits of a Bloom filter that is sent to all tasks (8 MB).
SIEVE_BITS = 1 << 26
#: Texts of more characters than this are not learnt from (they are scored whole), which bounds what a driver gathers.
TRAIN_CHARS = 50_000


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``. Only in local mode, where it may be unset, a temporary folder stands for it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; it is removed when the driver ends, if nothing has dropped it before."""
    path = f"{shared_root(spark)}/gaugeloom/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; a session that has ended is no error."""
    try:
        jvm, jsc = spark._jvm, spark._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone when the interpreter exits
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it again: the lineage is cut, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def dropped(*stored: DataFrame | None) -> None:
    """Delete the folders of DataFrames from ``written`` that nothing reads any more."""
    for df in stored:
        if df is not None and "_folder" in df.__dict__:
            drop_folder(df.sparkSession, df._folder)


def swept(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage: shuffle files that nothing reads any more stay on the executors' disks until it does."""
    spark.sparkContext._jvm.System.gc()


def sieve(keys: DataFrame, n: int, most_bits: int = SIEVE_BITS) -> Callable[[Column], Column]:
    """A test that every long in the one column of ``keys`` (about ``n``) passes, and few others: a Bloom filter of three bits a key, ten or more bits wide a key up to ``most_bits``.

    It is put together in slabs by tasks and is at most ``most_bits`` in all, on the driver too; with more keys than that serves, more others pass.
    """
    bits = min(most_bits, 1 << max(13, (10 * n).bit_length()))
    slab = min(bits, 1 << 19)

    def places(key: np.ndarray) -> np.ndarray:
        first, step = mix(key), mix(key ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(3)]).astype(np.int64)

    def dealt(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).drop_null().to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(at // slab), pa.array(at % slab)], names=["slab", "at"])

    def filled(batches):
        slabs = {}
        for batch in batches:
            which, at = batch.column("slab").to_numpy(), batch.column("at").to_numpy()
            for one in np.unique(which).tolist():
                slabs.setdefault(one, np.zeros(slab, bool))[at[which == one]] = True
        for one, held in slabs.items():
            yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["slab", "bits"])

    table = np.zeros((bits // slab, slab // 8), np.uint8)
    for row in keys.mapInArrow(dealt, "slab long, at long").repartition("slab").mapInArrow(filled, "slab long, bits binary").toLocalIterator():
        table[row["slab"]] = np.frombuffer(row["bits"], np.uint8)
    known = keys.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def passes(column: pa.Array) -> pa.Array:
        at = places(column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array((known.value[at >> 3] >> (7 - (at & 7)) & 1).all(axis=0))

    return F.arrow_udf(passes, "boolean")


def bound_batches(spark: SparkSession) -> None:
    """From now on a task of this session sends at most about BATCH_BYTES at once to Python, whatever the length of the rows; a smaller bound of the session stays.

    Rows are bounded in number only by default, and a thousand long texts are much at once for both sides.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns (or yields) dicts of columns in the order of ``schema``."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            for cols in [out] if isinstance(out, dict) else out:
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in cols.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(cols))

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def size_chunks(lengths, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose lengths add up to about ``limit`` at most; one long row is alone."""
    a = total = 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32(doc_id as text) mod 3 is 1. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents per label value, none of them held out, one row each.

    The sample is taken by the md5 of the id, so it is the same in every run. A document with several
    labels has the largest, one with several texts the first in their order; texts over ``longest`` characters, null ids and null
    labels are left out. So no more than 2 * per_class * longest characters are learnt from. The ids are few enough (twice
    ``per_class``) to be broadcast whatever the size of the tables.
    """
    y = (
        labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
        .withColumn("h", F.md5(F.col("doc_id").cast("string")))
    )
    picked = None
    for value in (0, 1):
        part = y.filter(F.col("y") == value).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= longest)
    rows = docs.join(F.broadcast(picked.select("doc_id", "y")), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").select("doc_id", "text", "y")
