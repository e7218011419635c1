"""Storage that driver and executors share, for tables between steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def importable(spark: SparkSession) -> None:
    """Ships this package to executors unless their Python path has it."""
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in on_path and not getattr(sc, "_posttrain_shipped", False):
        at = os.path.join(tempfile.mkdtemp(), "posttrain_spark.zip")
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted((ROOT / "posttrain_spark").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(at)
        sc._posttrain_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder if driver and executors are one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="posttrain-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A name for a column beside those of ``df`` that none of them has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, options: dict | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors. ``options``: of the writer."""
    spark = df.sparkSession
    at = fresh_path(spark, tag)
    df.write.options(compression="zstd", **(options or {})).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._posttrain_path = at
    return out


def release(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._posttrain_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
