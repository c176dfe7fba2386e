"""Readers and writers: text files, CSV tables, predictions, SQL workloads, manifests, results."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrel.functions.text import squeezed


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark can reach; parents are made, an old file is replaced."""
    p, fs = _hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any file system that Spark can reach."""
    p, fs = _hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.txt`` files below a folder: doc_id (path relative to the folder), table_name (first folder of it, null if none), text."""
    p, fs = _hadoop_path(spark, folder)
    root = fs.makeQualified(p).toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_path", r"\+", "%2B")), "^[a-zA-Z0-9+.-]+:(?://[^/]*)?/*", "/")
    docs = files.select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("text")).withColumn("doc_id", F.substr(path, F.lit(len(root) + 2)))
    return docs.select("doc_id", F.when(F.contains("doc_id", F.lit("/")), F.split_part("doc_id", F.lit("/"), F.lit(1))).alias("table_name"), "text")


def table_documents(spark: SparkSession, folder: str, table_name: str) -> DataFrame:
    """The non-blank documents of one table: doc_id ``doc::<table>::<stem>`` and text."""
    docs = text_documents(spark, folder).where((F.col("table_name") == table_name) & F.col("text").rlike(r"\S"))
    stem = F.regexp_extract("doc_id", r"([^/]+)\.txt$", 1)
    return docs.select(F.concat(F.lit(f"doc::{table_name}::"), stem).alias("doc_id"), "text")


def clean_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV table with a header: unnamed columns dropped, blanks trimmed and collapsed (``||`` with blanks around), empty cells null,
    columns cast to ``types`` where that is possible."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    out = []
    for c in raw.columns:
        if re.match(r"(?i)unnamed|_c\d+$", c) or not c.strip():
            continue
        v = F.nullif(F.regexp_replace(squeezed(F.col(f"`{c}`")), r" ?\|\| ?", " || "), F.lit(""))
        kind = (types or {}).get(c)
        out.append((F.regexp_replace(v, ",", "").try_cast("double").try_cast(kind) if kind in ("bigint", "int", "double") else v).alias(c.strip()))
    return raw.select(*out)


def predictions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A prediction CSV in the order of ``columns``: quotes around names dropped, file_name turned into id (its stem), missing columns null."""
    raw = clean_csv(spark, path)
    raw = raw.toDF(*[c.strip("\"'` ") for c in raw.columns])
    if "file_name" in raw.columns and "id" not in raw.columns:
        raw = raw.withColumn("id", F.regexp_replace(F.regexp_extract("file_name", r"([^/\\]+)$", 1), r"\.[^.]*$", "")).drop("file_name")
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_results(folder: str, gold: DataFrame, found: DataFrame, metrics: dict) -> None:
    """Gold and matched rows as CSV folders, metrics as ``acc.json``, on any file system."""
    gold.write.mode("overwrite").option("header", "true").csv(f"{folder}/gold")
    found.write.mode("overwrite").option("header", "true").csv(f"{folder}/matched")
    write_text(gold.sparkSession, f"{folder}/acc.json", json.dumps(metrics, indent=1))


@dataclass(frozen=True)
class Statement:
    """A statement of a workload file with the label of the comment before it ('' if none)."""

    label: str
    sql: str


def _comment_free(text: str) -> str:
    out, i, quote = [], 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            out.append(c)
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
            out.append(c)
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def workload(text: str) -> list[Statement]:
    """The statements of an SQL text, parted at semicolons outside quotes. A comment line such as ``-- Query 3: name`` or ``-- Q3:`` labels
    the next statement; other comments are dropped."""
    statements, label, start, quote, i = [], "", 0, "", 0
    pending = ""
    while i <= len(text):
        c = text[i] if i < len(text) else ";"
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and i < len(text):
            quote = c
        elif text.startswith("--", i):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            m = re.match(r"--\s*((?:Query\s*|Q)\d+.*)", text[i:end])
            if m:
                pending = m[1].strip().rstrip(":")
            i = end
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            continue
        elif c == ";":
            sql = _comment_free(text[start:i]).strip()
            if sql:
                statements.append(Statement(pending or label, sql))
            pending, start = "", i + 1
        i += 1
    return statements


def read_workload(spark: SparkSession, path: str) -> list[Statement]:
    """The statements of a file, or of all ``.sql`` files below a folder in order of their paths, from any file system."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), "value").collect()  # a workload is text written by people
    return [s for r in sorted(rows) for s in workload(r["value"])]


def write_manifests(spark: SparkSession, folder: str, statements: list[Statement], attributes: dict[str, dict], needed) -> list[str]:
    """A folder ``q<n>`` with ``sql.json`` per statement: the SQL and the metadata of the attributes that ``needed(sql)`` names by table."""
    written = []
    for n, s in enumerate(statements, 1):
        meta = {t: {c: attributes.get(t, {}).get(c, {}) for c in sorted(cs)} for t, cs in sorted(needed(s.sql).items())}
        written.append(f"{folder}/q{n}/sql.json")
        write_text(spark, written[-1], json.dumps({"sql": s.sql} | meta, indent=1))
    return written
