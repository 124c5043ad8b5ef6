"""Files beside a ledger: stored outputs, transcripts and artifacts that runs leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import exists


def write_outputs(rows: DataFrame, path: str, key: str = "run_id", text: str = "output") -> None:
    """Append (key, text) of runs to a table beside the ledger; a file for each run would be more files than a store likes."""
    rows.select(key, text).write.mode("append").parquet(path)


def read_outputs(spark: SparkSession, path: str, key: str = "run_id", text: str = "output") -> DataFrame:
    """The stored outputs; the last of a run that was stored twice can't be told, so its largest counts. A missing path has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {text} string")
    return spark.read.parquet(path).groupBy(key).agg(F.max(text).alias(text))


def with_outputs(rows: DataFrame, outputs: DataFrame, key: str = "run_id") -> DataFrame:
    """Ledger rows with their stored output, null where there is none."""
    return rows.join(outputs, key, "left")


def read_files(spark: SparkSession, rows: DataFrame, root: str, column: str = "output_path", text: str = "output") -> DataFrame:
    """``rows`` with the content of the text file under ``root`` that ``column`` names by its relative path; null if it can't be found."""
    if not exists(spark, root):
        return rows.withColumn(text, F.lit(None).cast("string"))
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias(text))
    base = F.regexp_extract("_file", rf"(?:^|/)\Q{root.rstrip('/').rpartition('/')[2]}\E/(.*)$", 1)
    return rows.join(files.withColumn("_name", base).drop("_file"), F.col(column) == F.col("_name"), "left").drop("_name")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, modified, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def captured(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """For each of ``wanted`` (run_id, artifact, since), the content it left and whether it is missing.

    A file at the very path, if it was modified from ``since`` on, else the newest of that name anywhere; none is the empty text.
    """
    name = F.regexp_extract("artifact", r"([^/]*)$", 1)
    met = wanted.withColumn("name", name).join(found, "name", "left")
    exact = F.col("path").endswith(F.concat(F.lit("/"), F.col("artifact"))) & (F.col("modified") >= F.col("since"))
    fresh = F.when(F.col("modified") >= F.col("since"), F.struct(F.coalesce(exact, F.lit(False)).alias("exact"), "modified", "path"))
    best = met.groupBy("run_id", "artifact").agg(F.max_by("content", fresh).alias("content"))
    return best.select("run_id", "artifact", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNull().alias("missing"))
