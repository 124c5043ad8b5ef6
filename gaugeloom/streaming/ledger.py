"""A ledger as a stream: the newest successful row of every run is kept by the stream's state, and what a batch changes is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dedupe import latest_grade
from ..schema import LEDGER
from ..sources.ledger import exists

#: The order of a run's rows, as ``latest_grade`` has it.
NEWEST = ("ts", "grader_version")


def _newest(rows: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """One row a run, the largest by time, version and ``ties``; a null is older than any value. Partial and whole results may be put in again."""
    rest = [c for c in LEDGER.names if c != "run_id"]
    found = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct(*NEWEST, *ties)).alias("r"))
    return found.select("run_id", "r.*").select(*LEDGER.names)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _whole(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, name) of the folders that were written to their end, and that no later base stands for: the last base and the batches after it."""
    store, target = _path(spark, table)
    if not store.exists(target):
        return []
    names = [f.getPath().getName() for f in store.listStatus(target)]
    done = sorted((int(n.split("=")[1]), n) for n in names if n.startswith(("batch=", "base=")) and exists(spark, f"{table}/{n}/_SUCCESS"))
    base = max((number for number, n in done if n.startswith("base=")), default=-1)
    return [(number, n) for number, n in done if number > base or n == f"base={base}"]


def stream_latest(spark: SparkSession, source: str, table: str, checkpoint: str, ties: tuple[str, ...] = (), files_per_batch: int | None = None) -> DataStreamWriter:
    """A stream over the JSON files of ``source`` that keeps ``table`` at the newest successful row of every run seen.

    The rows by run are the state of a streaming aggregate, which Spark spreads over its shuffle partitions and checkpoints by
    differences; only runs that a batch changes leave it, so what a batch writes grows with the batch and not with the table. A batch has its own folder,
    which is written over when the batch is done again, and which readers see once it is whole. For many runs set
    ``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider, which keeps state on disk. Equal times and versions fall back on ``ties``, columns of the ledger.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    reader = spark.readStream.schema(LEDGER)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    newest = _newest(reader.json(source).filter(F.col("run_status") == "ok"), ties)
    return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_rows(spark: SparkSession, table: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest successful row of each run after the last whole batch, whatever its grade."""
    found = [f"{table}/{name}" for _, name in _whole(spark, table)]
    return _newest(spark.read.schema(LEDGER).parquet(*found), ties) if found else spark.createDataFrame([], LEDGER)


def latest_state(spark: SparkSession, table: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Definitive grades after the last whole batch: as ``latest_grade`` of all files that the stream has read."""
    return latest_grade(newest_rows(spark, table, ties), ties)


def compact(spark: SparkSession, table: str, ties: tuple[str, ...] = ()) -> None:
    """Fold the batches that are there into one base, by one job. May run beside the stream, which only adds batches, and again after it broke off.

    Folders that a base stands for are deleted at the next call after it, so a reader that began before has until then.
    """
    found = _whole(spark, table)
    store, target = _path(spark, table)
    stale = [f.getPath() for f in store.listStatus(target) if f.getPath().getName() not in {n for _, n in found}] if found else []
    for path in stale:
        name = path.getName()
        if name.startswith(("batch=", "base=")) and int(name.split("=")[1]) <= found[0][0]:
            store.delete(path, True)
    if len(found) > 1:
        newest_rows(spark, table, ties).write.mode("overwrite").parquet(f"{table}/base={found[-1][0]}")
