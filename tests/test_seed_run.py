"""A seed loop that stops and starts again ends with the files of one that never stopped."""

import threading

import pytest
from pyspark.sql import functions as F

from rankfold.session import scratch_dir
from rankfold.sources.seed_run import SeedRun


def _scores(spark, calls, stop_at=None, broken=None):
    def make(seed):
        calls.append(seed)
        if seed == stop_at:
            raise RuntimeError("driver lost")
        rows = spark.range(20).select("id", (F.col("id") * (seed + 1) + F.lit(0.25)).alias("score"))
        bad = rows.withColumn("score", F.raise_error(F.lit("executor lost")).cast("double")) if seed == broken else rows
        return {"test": rows.where("id % 2 = 0"), "train": bad.where("id % 2 = 1")}
    return make


def _mean(total, n):
    return total.select("id", (F.col("score") / F.lit(float(n))).alias("score"))


def _table(spark, paths):
    return {split: sorted(map(tuple, spark.read.parquet(p).select("seed", "id", "score").collect())) for split, p in paths.items()}


def test_restart_goes_on_after_the_last_complete_seed(spark):
    seeds = [5, 3, 9, 1, 7]
    whole = SeedRun(spark, scratch_dir(spark, "whole")).through(seeds, _scores(spark, []), _mean)
    folder, calls = scratch_dir(spark, "stopped"), []
    with pytest.raises(RuntimeError):
        SeedRun(spark, folder).through(seeds, _scores(spark, calls, stop_at=1), _mean)
    assert SeedRun(spark, folder).committed() == [5, 3, 9]
    again = SeedRun(spark, folder).through(seeds, _scores(spark, calls), _mean)
    assert calls == [5, 3, 9, 1, 1, 7]
    assert _table(spark, again) == _table(spark, whole)
    assert SeedRun(spark, folder).through(seeds, _scores(spark, calls), _mean) == again and len(calls) == 6


def test_a_seed_that_broke_off_between_splits_is_done_anew(spark):
    seeds = [0, 1, 2]
    whole = SeedRun(spark, scratch_dir(spark, "whole")).through(seeds, _scores(spark, []), _mean)
    folder = scratch_dir(spark, "broken")
    with pytest.raises(Exception):
        SeedRun(spark, folder).through(seeds, _scores(spark, [], broken=1), _mean)
    assert SeedRun(spark, folder).committed() == [0]
    assert _table(spark, SeedRun(spark, folder).through(seeds, _scores(spark, []), _mean)) == _table(spark, whole)


def test_more_seeds_go_on_and_another_run_is_refused(spark):
    folder = scratch_dir(spark, "more")
    SeedRun(spark, folder).through([0, 1], _scores(spark, []), _mean)
    calls = []
    SeedRun(spark, folder).through([0, 1, 2], _scores(spark, calls), _mean)
    assert calls == [2]
    with pytest.raises(ValueError):
        SeedRun(spark, folder).through([1, 0], _scores(spark, []), _mean)


def test_splits_of_a_seed_run_side_by_side(spark):
    met = threading.Barrier(2)

    def interim(total, n):
        met.wait(timeout=60)  # broken where one split's step ends before the other's begins
        return _mean(total, n)

    paths = SeedRun(spark, scratch_dir(spark, "side")).through([0, 1], _scores(spark, []), interim)
    whole = SeedRun(spark, scratch_dir(spark, "plain")).through([0, 1], _scores(spark, []), _mean)
    assert _table(spark, paths) == _table(spark, whole)
