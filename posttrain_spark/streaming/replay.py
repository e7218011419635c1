"""Replay buffer of trajectories over structured streaming: age expiry by weight version, bounded size, batches when full."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.storage import importable


def usable(trajectories: DataFrame, version: int, max_age: int) -> DataFrame:
    """Trajectories generated by a version of at most ``max_age`` before the current one; older are expired, later not yet due."""
    return trajectories.filter(F.col("weight_version").between(version - max_age, version))


def buffer_size(prompts: int, max_age: int) -> int:
    return prompts * max_age * 2


def replay(trajectories: DataFrame, current: int, max_age: int, prompts: int, key: str) -> DataFrame:
    """Batch form: the newest trajectories that are valid and fit the buffer (newer versions first, then key)."""
    return usable(trajectories, current, max_age).orderBy(F.desc("weight_version"), key).limit(buffer_size(prompts, max_age))


#: Ids that a task sorts at once; more of a version are sorted in runs of as many, which lie in a temporary folder.
SORTED = 1 << 21


class Ascending:
    """Ids in ascending order, as arrays; in memory are those of a run or two."""

    def __enter__(self) -> Ascending:
        self.folder, self.runs, self.parts, self.n = None, [], [], 0
        return self

    def __exit__(self, *_) -> None:
        self.runs = []
        if self.folder:
            self.folder.cleanup()

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.n += len(ids)
        if self.n >= SORTED:
            self.folder = self.folder or tempfile.TemporaryDirectory()
            at = os.path.join(self.folder.name, f"{len(self.runs)}.npy")
            np.save(at, self._sorted())
            self.runs.append(np.load(at, mmap_mode="r"))

    def _sorted(self) -> np.ndarray:
        ids = np.sort(np.concatenate([np.zeros(0, np.int64), *self.parts]))
        self.parts, self.n = [], 0
        return ids

    def __iter__(self) -> Iterator[np.ndarray]:
        left = [*self.runs, self._sorted()]
        size = max(1, SORTED // len(left))
        while left := [x for x in left if len(x)]:
            # No id beyond the blocks is smaller than the least of their ends.
            end = min(x[min(size, len(x)) - 1] for x in left)
            cuts = [int(np.searchsorted(x[:size], end, side="right")) for x in left]
            yield np.sort(np.concatenate([x[:n] for x, n in zip(left, cuts, strict=True)]))
            left = [x[n:] for x, n in zip(left, cuts, strict=True)]


def buffered(trajectories: DataFrame, batch_size: int, max_age: int) -> DataFrame:
    """Streaming form: trajectories of a target version wait in state until a batch is full.

    Input: ``target_version``, ``trajectory_id``, ``weight_version``. Output: ``target_version``, ``trajectory_id``,
    ``batch`` (from 1; -1 if expired) and ``expired``, true for a trajectory that is too old or too new for its target.
    Batches are filled by what waits, then by the ids of the trigger in ascending order, however many Arrow batches these
    come in. State holds fewer than ``batch_size`` ids a version.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (target,) = key
        held, batch = state.get if state.exists else ([], 0)
        with Ascending() as ids:
            for pdf in frames:
                good = pdf["weight_version"].between(target - max_age, target)
                ids.add(pdf["trajectory_id"][good].astype("int64").to_numpy())
                if not good.all():
                    yield pd.DataFrame({"target_version": target, "trajectory_id": pdf["trajectory_id"][~good], "batch": -1, "expired": True})
            waiting = np.array(held, np.int64)
            for block in ids:
                waiting = np.concatenate([waiting, block])
                full = len(waiting) // batch_size
                if full:
                    numbers = np.repeat(np.arange(batch + 1, batch + full + 1), batch_size)
                    yield pd.DataFrame({"target_version": target, "trajectory_id": waiting[: full * batch_size], "batch": numbers, "expired": False})
                    batch, waiting = batch + full, waiting[full * batch_size :]
        state.update((waiting.tolist(), batch))

    importable(trajectories.sparkSession)
    schema = "target_version long, trajectory_id long, batch long, expired boolean"
    return trajectories.groupBy("target_version").applyInPandasWithState(step, schema, "held array<long>, batch long", "append", GroupStateTimeout.NoTimeout)


def accumulate(groups: DataFrame, target: int, max_batches: int, at: str) -> DataStreamWriter:
    """Dynamic sampling: gathers groups of varied reward (``reward_std`` above 0) in the folder ``at`` until ``target`` are there; too many batches without enough is an error.

    Every batch writes what it adds to a folder of its own, replacing what an earlier attempt wrote, and counts what
    the batches before it have written. So nothing is kept on the driver, and a stream that is started again goes on
    where it was. Groups beyond the target are not needed and stay out.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        before = gathered(batch.sparkSession, at, batch.schema).filter(F.col("epoch") < epoch).count()
        if before >= target:
            return
        mine = f"{at}/epoch={epoch}"
        batch.filter(F.col("reward_std") > 0).limit(target - before).write.mode("overwrite").parquet(mine)
        have = before + batch.sparkSession.read.schema(batch.schema).parquet(mine).count()
        if have < target and epoch + 1 >= max_batches:
            raise RuntimeError(f"{have} of {target} groups after {epoch + 1} batches")

    return groups.writeStream.foreachBatch(take)


def gathered(spark: SparkSession, at: str, schema: StructType) -> DataFrame:
    """What ``accumulate`` has written so far, with the number of its batch as ``epoch``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("epoch", LongType())]))
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(at)
