"""File sources and sinks."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reader by file suffix.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".txt": "text", ".arrow": "arrow", ".orc": "orc"}


def load_table(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Reads a file or folder by its suffix (also before ``.gz``); without a known suffix, a saved Parquet folder."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    kind = FORMATS.get(os.path.splitext(name)[1], "parquet")
    if kind == "arrow":
        return load_arrow(spark, [path])
    if kind == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"'} | options
    if kind == "json" and name.endswith(".json"):
        options = {"multiLine": "true"} | options
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    out = reader.load(path)
    return out.withColumnRenamed("value", "text") if kind == "text" else out


def load_arrow(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Arrow IPC files (stream or file format), each read by a task from bytes that Spark fetches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def table(body: bytes) -> pa.Table:
        opener = pa.ipc.open_file if body[:6] == b"ARROW1" else pa.ipc.open_stream
        return opener(pa.BufferReader(body)).read_all()

    files = spark.read.format("binaryFile").load(list(paths))
    schema = from_arrow_schema(table(bytes(files.select("content").first()[0])).schema)

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                yield from table(body.as_buffer().to_pybytes()).to_batches()

    return files.select("content").mapInArrow(run, schema)


def load_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines: ``file``, ``pos`` (order within the file, not dense) and ``line``; compressed files too."""
    out = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return out


def load_objects(spark: SparkSession, path: str) -> DataFrame:
    """Each line's JSON object as a VARIANT ``row`` without filling in missing keys."""
    return load_lines(spark, path).select("file", "pos", F.try_parse_json("line").alias("row")).filter(F.schema_of_variant("row").startswith("OBJECT"))


def task_name(path: str) -> str:
    """The last two parts of a path joined by "-", cut at the first ".", without a leading "-"."""
    return "-".join(path.split("/")[-2:]).split(".")[0].removeprefix("-")


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _full(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    return fs.makeQualified(p).toString()


def resolve(spark: SparkSession, patterns: list[str], unique: bool = True) -> list[str]:
    """Files that match, with their file system, sorted, each once (unless told otherwise); none is an error. ``**/`` is a folder at any depth."""
    found = []
    for pattern in patterns:
        head, deep, tail = pattern.partition("**/")
        p, fs = _at(spark, head or "." if deep else pattern)
        if deep:
            name = re.compile(fnmatch.translate(tail))
            files = fs.listFiles(p, True)
            while files.hasNext():
                at = files.next().getPath().toString()
                # What follows the deep part has as many folders as the pattern.
                if name.match("/".join(at.split("/")[-(tail.count("/") + 1) :])):
                    found.append(at)
        else:
            found += [x.getPath().toString() for x in fs.globStatus(p) or () if x.isFile()]
    found = sorted(set(found)) if unique else sorted(found)
    if not found:
        raise FileNotFoundError(f"no file matches {patterns}")
    return found


def overlap(spark: SparkSession, a: list[str], b: list[str]) -> list[str]:
    """Files in both lists."""
    return sorted({_full(spark, x) for x in a} & {_full(spark, x) for x in b})


def checked_output(spark: SparkSession, path: str, inputs: Iterable[str] = (), overwrite: bool = False) -> str:
    """A ``.jsonl`` path whose folder exists, that is no input, and that is free unless it may be overwritten."""
    if not path.lower().endswith(".jsonl"):
        raise ValueError(f"not a .jsonl path: {path}")
    if overlap(spark, [path], list(inputs)):
        raise ValueError("the output is one of the inputs")
    p, fs = _at(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    fs.mkdirs(p.getParent())
    return path


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Every row as a JSON object a line; null fields are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_lines(rows: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """A text column as it is, a line each."""
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)


def replace_folder(rows: DataFrame, path: str, write=write_json_lines) -> None:
    """Writes beside a folder, then takes its place; a failed write leaves the old one."""
    name = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    staging, fs = _at(rows.sparkSession, name)
    target, old = (_at(rows.sparkSession, x)[0] for x in (path.rstrip("/"), f"{name}.old"))
    try:
        write(rows, name)
    except Exception:
        fs.delete(staging, True)
        raise
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(staging, target):
        fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


def line_count(lines: DataFrame) -> int:
    return lines.count()


def mock_rows(spark: SparkSession, n: int, words: int, seed: int = 0, vocabulary: int = 1000) -> DataFrame:
    """n equal rows whose ``text`` has the wanted number of white-space tokens; drawn by hash, so the same everywhere."""
    row = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(1, words))), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), i), F.lit(vocabulary)).cast("string"))), " ")
    return spark.range(n).select("id", (row if words > 0 else F.lit("")).alias("text"))


def mock_candidate(counts: list[int], target: int) -> int:
    """Index of the count nearest to a target; a tie prefers one that doesn't exceed it, then the first."""
    return min(range(len(counts)), key=lambda i: (abs(counts[i] - target), counts[i] > target, i))


def metric_points(rows: DataFrame, metric: Column, step: Column, value: Column, source: Column) -> DataFrame:
    """A long table of metric points."""
    return rows.select(metric.cast("string").alias("metric"), step.cast("long").alias("step"), value.cast("double").alias("value"), source.cast("string").alias("source_file"))
