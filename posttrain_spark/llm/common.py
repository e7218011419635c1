"""What the operators of this subpackage share: shared storage, input columns, Arrow helpers.

Conventions that hold for every operator here

* An operator reads only the columns it names (``doc_id``, ``text``, ...); other columns of the
  input, whatever they are called, are neither read nor able to clash.
* A null ``text`` counts as the empty text unless the operator says otherwise.
* A null ``doc_id`` is an ordinary value: its row is processed and returned with a null id.
* Repeated rows are processed once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.storage import fresh_path, importable, materialize, release, shared_dir  # noqa: F401  (the operators take them from here)

#: Input batches handed to Python: rows and bytes, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

#: The ASCII white space that the contracts name: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def lower_az(s: str) -> str:
    """Lower-cases A-Z only; other letters stay."""
    return s.lower() if s.isascii() else s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes this package importable on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    importable(spark)


_WORK: dict = {"name": "", "held": {}}


def workspace(name: str) -> dict:
    """What an operator remembers in a Python worker; dropped when another operator's tasks come to that worker."""
    if _WORK["name"] != name:
        _WORK["held"].clear()
        _WORK["name"] = name
    return _WORK["held"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text``; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Applies ``fn`` (batch -> columns by name, or a batch) to every Arrow batch."""
    arrow = arrow_schema(schema) if isinstance(schema, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_pydict(out, schema=arrow) if arrow else out

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, whose text ``keep`` says yes to."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def flat_offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Start of each run in a concatenation of runs of the given lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
