"""Specifications that people write: tasks, grids, rubrics and registries. Files are read by Spark, so they may lie in any store; each is small."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import exists, read_required

# What a task needs, the modes, and the name of the variable that tells where a holdout lies.
TASK_REQUIRED, MODES, HOLDOUT_VARIABLE = ("id", "domain", "grader", "mode"), ("single", "agent"), "GAUGELOOM_HOLDOUT"
TASK_SCHEMA = "task_id string, domain string, grader string, mode string, prompt string, infra_repo string, gold string, params string, timeout_s double, tags array<string>, tools array<string>"


def _texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".yaml", ".yml", ".json")) -> list[tuple[str, str]]:
    """(path, content) of the files at a path (one file, or those of a folder), sorted by path."""
    rows = spark.read.option("recursiveFileLookup", False).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "value")
    return sorted((r["f"], r["value"]) for r in rows.collect() if r["f"].endswith(suffixes))


def read_tasks(spark: SparkSession, path: str, known_tools: tuple[str, ...] | None = None) -> DataFrame:
    """Tasks of a YAML file or a folder of them; missing keys, unknown modes or tools, and ids that occur twice are errors. gold and params are JSON text."""
    rows, seen = [], set()
    for name, text in _texts(spark, path):
        task = yaml.safe_load(text)
        if not isinstance(task, Mapping):
            raise ValueError(f"{name}: a task is a mapping")
        missing = [k for k in TASK_REQUIRED if not task.get(k)]
        if missing:
            raise ValueError(f"{name}: lacks {missing}")
        if task["mode"] not in MODES:
            raise ValueError(f"{name}: the mode is one of {MODES}")
        tools = task.get("tools")
        if tools is not None and (not isinstance(tools, list) or not all(isinstance(x, str) for x in tools)):
            raise ValueError(f"{name}: tools is a list of names")
        unknown = sorted(set(tools or ()) - set(known_tools)) if known_tools is not None else []
        if unknown:
            raise ValueError(f"{name}: unknown tools {unknown}")
        if task["id"] in seen:
            raise ValueError(f"{name}: the id {task['id']} occurs twice")
        seen.add(task["id"])
        as_json = lambda x: None if x is None else json.dumps(x, sort_keys=True, default=str)
        rows.append((str(task["id"]), str(task["domain"]), str(task["grader"]), task["mode"], task.get("prompt"), task.get("infra_repo"), as_json(task.get("gold")), as_json(task.get("params")), float(task["timeout_s"]) if task.get("timeout_s") is not None else None, [str(x) for x in task.get("tags") or ()], tools))
    return spark.createDataFrame(rows, TASK_SCHEMA)


def read_grid(spark: SparkSession, path: str) -> dict[str, DataFrame | int]:
    """models, efforts, variants and support as DataFrames with positions, and epochs, of a grid's YAML file."""
    texts = _texts(spark, path)
    grid = yaml.safe_load(texts[0][1]) if len(texts) == 1 else None
    if not isinstance(grid, Mapping):
        raise ValueError(f"{path}: a grid is one file with a mapping")
    for axis in ("models", "efforts"):
        if not isinstance(grid.get(axis), list) or not grid[axis]:
            raise ValueError(f"{path}: {axis} is a list that isn't empty")
    epochs = grid.get("epochs", 1)
    if not isinstance(epochs, int) or isinstance(epochs, bool) or epochs < 1:
        raise ValueError(f"{path}: epochs is at least 1")
    listed = lambda values, name: spark.createDataFrame([(str(x), i) for i, x in enumerate(values)], f"{name} string, {name}_pos int")
    support = [(str(m), str(e)) for m, efforts in (grid.get("effort_support") or {}).items() for e in efforts]
    return {"models": listed(grid["models"], "model"), "efforts": listed(grid["efforts"], "effort"), "variants": listed(grid.get("variants") or ["none"], "variant"), "epochs": epochs, "support": spark.createDataFrame(support, "model string, effort string")}


def read_rubric(spark: SparkSession, path: str) -> dict:
    """A rubric (JSON): fence_anchor, window and items."""
    rubric = json.loads(_texts(spark, path)[0][1])
    if not isinstance(rubric.get("items"), list) or not rubric["items"]:
        raise ValueError(f"{path}: items is a list that isn't empty")
    return {"fence_anchor": rubric.get("fence_anchor"), "window": int(rubric.get("window", 200)), "items": rubric["items"]}


def read_registry(spark: SparkSession, path: str, name: str, value: str | None = None) -> DataFrame:
    """A JSON object as rows of (name) or (name, value long): known labels, references, or files with their number of lines."""
    entries = json.loads(_texts(spark, path)[0][1])
    return spark.createDataFrame([(str(k), int(v)) for k, v in entries.items()], f"{name} string, {value} long") if value else spark.createDataFrame([(str(k),) for k in entries], f"{name} string")


def holdout_path(params: Mapping | None, default: str) -> str:
    """Where a labelled holdout lies: the environment's word, else the task's, else the default."""
    return os.environ.get(HOLDOUT_VARIABLE) or (params or {}).get("holdout") or default


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a Parquet holdout; a missing column or file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_required(spark, path, ("text", "label")).select("text", F.col("label").cast("int").alias("label"))
