"""Files in and out: directory scans, JSON artifacts, audit logs, merges of stored tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "docx", "txt"), skip: tuple[str, ...] = (), include: tuple[str, ...] = (), max_bytes: int | None = None, max_depth: int | None = None, limit: int | None = None, content: bool = False) -> DataFrame:
    """(path, mtime, length[, content]) of files under root; skip and include are globs on the lower-cased path. limit: the first so many by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    low = F.lower("path")
    out = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([x.lower().lstrip(".") for x in extensions]))
    glob = lambda g: "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".^$+{}[]|()\\" else c) for c in g.lower()) + "$"
    for g in skip:
        out = out.where(~low.rlike(glob(g)))
    if include:
        out = out.where(low.rlike("|".join(f"({glob(g)})" for g in include)))
    if max_bytes is not None:
        out = out.where(F.col("length") <= max_bytes)
    if max_depth is not None:
        tail = F.regexp_replace("path", r"^.*?/" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
        out = out.where(F.size(F.split(tail, "/")) - 1 <= max_depth)
    out = out.select("path", F.col("modificationTime").alias("mtime"), "length", *["content"] * content)
    return out if limit is None else out.orderBy("path").limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def corpus_scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "docx", "txt")) -> DataFrame:
    """``scan`` of all files under root, sorted by path."""
    return scan(spark, root, extensions).orderBy("path")


def write_json(table: DataFrame, path: str) -> None:
    """An artifact as JSON lines; replaces what is there."""
    table.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_evaluation(per_query: DataFrame, total: DataFrame, path: str) -> None:
    """Per-query metrics as CSV with a header and the aggregate as JSON, under path."""
    per_query.write.mode("overwrite").option("header", True).csv(f"{path}/per_query")
    total.write.mode("overwrite").json(f"{path}/aggregate")


def append_audit(events: DataFrame, path: str, subject_col: str | None = None) -> None:
    """Appends events as JSON lines, subjects as SHA-1."""
    out = events if subject_col is None else events.withColumn(subject_col, F.sha1(F.col(subject_col).cast("string")))
    out.write.mode("append").json(path)


def translated_path(path, prefix: str, shown: str):
    """path with prefix replaced by shown and slashes turned, where it starts with prefix."""
    return F.when(path.startswith(prefix), F.translate(F.concat(F.lit(shown), F.substr(path, F.lit(len(prefix) + 1))), "/", "\\")).otherwise(path)
