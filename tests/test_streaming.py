import random

import numpy as np
import pytest
from posttrain_spark.streaming import replay


def test_buffer_emits_full_batches_and_expired_trajectories(spark, tmp_path):
    rows = [(5, i, 4 if i % 5 else 1) for i in range(12)] + [(6, 100 + i, 6) for i in range(5)]
    spark.createDataFrame(rows, "target_version long, trajectory_id long, weight_version long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("target_version long, trajectory_id long, weight_version long").parquet(str(tmp_path / "in"))
    q = (
        replay.buffered(stream, batch_size=4, max_age=2)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c"))
        .option("path", str(tmp_path / "out"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    expired = sorted(r.trajectory_id for r in got if r.expired)
    full = [r for r in got if not r.expired]
    assert expired == [0, 5, 10]
    assert sorted((r.target_version, r.batch) for r in full) == [(5, 1)] * 4 + [(5, 2)] * 4 + [(6, 1)] * 4


def test_batches_go_by_id_over_many_arrow_batches(spark, tmp_path):
    """A version of several Arrow batches, written out of order, in two triggers: the ids of a trigger fill batches in ascending order."""
    schema, at = "target_version long, trajectory_id long, weight_version long", str(tmp_path / "in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)

    def run():
        out = replay.buffered(spark.readStream.schema(schema).parquet(at), batch_size=16, max_age=2).writeStream.format("parquet")
        out.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    order = []
    for lo in (0, 5000):
        ids = list(range(lo, lo + 1009))
        random.Random(lo).shuffle(ids)
        spark.createDataFrame([(5, i, 5 if i % 7 else 9) for i in ids], schema).repartition(3).write.mode("append").parquet(at)
        run()
        order += [i for i in sorted(ids) if i % 7]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.trajectory_id: r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: b for i, b in got.items() if b > 0} == {x: k // 16 + 1 for k, x in enumerate(order[: len(order) // 16 * 16])}
    assert {i for i, b in got.items() if b < 0} == {i for lo in (0, 5000) for i in range(lo, lo + 1009) if i % 7 == 0}


def test_ids_sorted_in_runs(monkeypatch):
    monkeypatch.setattr(replay, "SORTED", 64)
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 1000):
        ids = rng.integers(0, 300, n)
        with replay.Ascending() as held:
            for part in np.array_split(ids, 9):
                held.add(part)
            blocks = list(held)
        assert np.concatenate([np.zeros(0, np.int64), *blocks]).tolist() == sorted(ids.tolist())
        assert all(len(b) <= 2 * 64 for b in blocks)


def test_groups_gather_over_restarts(spark, tmp_path):
    """Two runs of the stream, the second started anew, gather as many groups as one; a batch that runs again adds nothing."""
    schema = "prompt long, reward_std double"
    source, at = tmp_path / "in", str(tmp_path / "out")

    def run(target, max_batches=50):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        replay.accumulate(stream, target, max_batches, at).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.prompt for r in replay.gathered(spark, at, stream.schema).collect())

    for k in range(2):
        spark.createDataFrame([(10 * k + i, float(i % 2)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert run(12) == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    spark.createDataFrame([(100 + i, 1.0) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert len(run(12)) == 12
    assert len(run(12)) == 12


def test_too_many_batches_are_an_error(spark, tmp_path):
    schema = "prompt long, reward_std double"
    spark.createDataFrame([(1, 0.0)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="0 of 5 groups after 1 batches"):
        replay.accumulate(stream, 5, 1, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
