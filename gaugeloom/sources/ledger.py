"""Ledger files: newline-delimited JSON, read with a declared schema and written by append."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LEDGER

_CORRUPT = "_corrupt"
#: Columns that hold JSON text; old files have objects in their place.
JSON_COLUMNS = ("subscores", "details", "tool_calls")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = LEDGER) -> DataFrame:
    """All rows of a ledger; a missing path is an empty ledger, missing keys are null, unknown keys are dropped, blank lines are skipped, objects in JSON columns are read as their text."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def place(by_time: bool = False) -> Column:
    """Where a row stands among the files of a text or JSON scan: an order by file, block of the file, and row of the block.

    Spark packs blocks into tasks by size, so numbers of rows in a task tell only rows of one block apart; with the block's file and
    start before them the order is that of the lines, in any plan. Files are ordered by path, which is that of the parts of one write;
    ``by_time``: by when they were written, which is that of several appends.
    """
    meta = F.col("_metadata")
    first = [meta["file_modification_time"].alias("time")] if by_time else []
    return F.struct(*first, meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))


def read_sequenced(spark: SparkSession, path: str, schema: T.StructType = LEDGER, by_time: bool = False) -> DataFrame:
    """As ``read_ledger``, with ``seq``: the place of each row in the order of the files, for "the last one counts"."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields])).withColumn("seq", F.lit(None).cast("struct<file:string,block:bigint,row:bigint>"))
    return spark.read.schema(schema).json(path).withColumn("seq", place(by_time)).select(*schema.names, "seq")


def read_ledger_checked(spark: SparkSession, path: str, schema: T.StructType = LEDGER) -> DataFrame:
    """As ``read_ledger``, but a bad line raises with its file and line number, unless it is the last of its file: such a row was cut short and is skipped with a warning.

    Lines are told apart by their ``place``, so a sound ledger is parsed in one pass; only where there
    are bad lines are those before them counted.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    every = spark.read.text(path).withColumn("p", place()).select("value", F.col("p.file").alias("f"), F.struct("p.block", "p.row").alias("at"))
    lines = every.filter(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.select("f", "at", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    bad = parsed.filter(F.col(f"r.{_CORRUPT}").isNotNull()).select("f", "at")
    found = bad.join(lines.groupBy("f").agg(F.max("at").alias("last")), "f").orderBy(F.col("at") == F.col("last"), "f", "at").limit(20).collect()
    for row in found:
        if row["at"] < row["last"]:
            here = F.struct(F.lit(row["at"]["block"]).alias("block"), F.lit(row["at"]["row"]).alias("row"))
            number = every.filter((F.col("f") == row["f"]) & (F.col("at") <= here)).count()
            raise ValueError(f"line {number} of {row['f']} is no JSON object")
        warnings.warn(f"skipped the last line of {row['f']}, which was cut short", stacklevel=2)
    return parsed.filter(F.col(f"r.{_CORRUPT}").isNull()).select("r.*").drop(_CORRUPT)


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` with subscores as a map of numbers, tool_calls as a map of counts and details as a variant; null stays null (not measured), text that is no JSON becomes null."""
    return rows.withColumns({
        "subscores": F.from_json("subscores", "map<string,double>"), "tool_calls": F.from_json("tool_calls", "map<string,bigint>"), "details": F.try_parse_json("details"),
    })


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows; the commit protocol of the writer stands for flushing each line."""
    rows.write.mode("append").json(path)


#: What makes a row of a ledger the same when a sweep is done again.
GRADE_KEY = ("run_id", "grader_version", "ts")


def append_new(rows: DataFrame, path: str, key: tuple[str, ...] = GRADE_KEY) -> None:
    """Append the rows whose ``key`` the ledger lacks, one a key, so an append that is done again, whole or in part, leaves it as it is.

    Files are only added, so writers at the same time lose nothing; rows that both bring may then be there twice, and ``latest`` operators take one.
    The keys are read with a schema of the key alone and joined by a shuffle, null equal to null. Of several rows of a key in ``rows`` one is written.
    """
    spark = rows.sparkSession
    known = read_ledger(spark, path, T.StructType([LEDGER[c] for c in key])).distinct()
    fresh = rows.dropDuplicates(list(key))
    same = [fresh[c].eqNullSafe(known[c]) for c in key]
    fresh.join(known, same, "left_anti").write.mode("append").json(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeloom-")
    return f"{root.rstrip('/')}/gaugeloom/{name}-{uuid.uuid4().hex}"


def sorted_json(column: Column) -> Column:
    """A map as JSON with sorted keys; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def encoded(rows: DataFrame) -> DataFrame:
    """Maps in JSON columns as text with sorted keys; of other types the text stands for the value, and what has no JSON form is named in its place."""
    out = {}
    for name in JSON_COLUMNS:
        kind = rows.schema[name].dataType if name in rows.columns else None
        if isinstance(kind, T.MapType):
            text = sorted_json(F.col(name)) if isinstance(kind.keyType, T.StringType) else sorted_json(F.transform_keys(name, lambda k, _: k.cast("string")))
            out[name] = F.when(F.col(name).isNotNull(), F.coalesce(text, F.lit('{"_unserialisable":"no JSON form"}')))
        elif kind is not None and not isinstance(kind, T.StringType):
            out[name] = F.when(F.col(name).isNotNull(), F.coalesce(F.to_json(F.col(name)) if isinstance(kind, (T.StructType, T.ArrayType, T.VariantType)) else F.col(name).cast("string"), F.lit('{"_unserialisable":"no JSON form"}')))
    return rows.withColumns(out) if out else rows


def read_required(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A Parquet table that must have some columns."""
    df = spark.read.parquet(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def write_sanitized(rows: DataFrame, path: str, keep: tuple[str, ...], fragments: tuple[str, ...], longest: int = 200) -> None:
    """Write the allowed columns, sorted by name; rows that leak raise, and so does an empty ledger."""
    from ..operators.sanitize import violations

    kept = rows.select(*sorted(c for c in rows.columns if c in keep))
    if kept.isEmpty():
        raise ValueError("no rows to write")
    found = violations(kept, fragments, longest).limit(3).collect()
    if found:
        raise ValueError(f"rows leak: {found}")
    kept.write.mode("error").json(path)
