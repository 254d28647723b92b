"""A seed loop that goes on where it was stopped.

Every finished seed leaves its partition of the interim prediction tables, the running sum of scores, and
last of all a commit marker, an empty file made through Hadoop's file system, so the folder may lie on any
shared storage. A run that starts again reads the markers, takes the running sum of the last complete seed and
goes on with the next; a seed that broke off in the middle left no marker and is done anew, over its own partition.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.sources.files import write_checkpoint_scores


class SeedRun:
    """The state of one seed loop in ``folder``: scores/<split>/seed=s, running/<split>/seed=s, commits/<place>-<seed>."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names) -> str:
        return os.path.join(self.folder, *map(str, names))

    def committed(self) -> list[int]:
        """Seeds that are complete, in the order in which they were run."""
        folder = self._path(self._at("commits"))
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [seed for _, seed in sorted((int(place), int(seed)) for place, seed in (n.split("-", 1) for n in names))]

    def through(self, seeds: Sequence[int], scores: Callable[[int], dict[str, DataFrame]], interim: Callable[[DataFrame, int], DataFrame],
                key: str = "id") -> dict[str, str]:
        """Run the seeds that are not complete: ``scores(seed)`` gives (key, score) for every split, ``interim(total, n)`` turns the
        sum of the first n seeds' scores into the rows to be written as partition ``seed``. Returns the table path of every split.

        A folder whose complete seeds are not the first of ``seeds`` belongs to another run and is refused.
        """
        seeds, done = list(seeds), self.committed()
        if done != seeds[:len(done)]:
            raise ValueError(f"{self.folder} holds seeds {done}, which do not start {seeds}")
        for place in range(len(done), len(seeds)):
            seed = seeds[place]

            def step(split: str, part: DataFrame) -> None:
                if place:
                    before = self.spark.read.parquet(self._at("running", split, f"seed={seeds[place - 1]}"))
                    part = before.unionByName(part.select(*before.columns)).groupBy(key).agg(F.sum("score").alias("score"))
                running = self._at("running", split, f"seed={seed}")
                part.write.mode("overwrite").parquet(running)
                write_checkpoint_scores(interim(self.spark.read.parquet(running), place + 1), self._at("scores", split), seed)

            # The splits' jobs do not depend on each other; the pool only submits them. All are done before the marker.
            parts = scores(seed)
            with ThreadPoolExecutor(max_workers=len(parts) or 1) as pool:
                list(pool.map(step, parts.keys(), parts.values()))
            self._fs.create(self._path(self._at("commits", f"{place}-{seed}")), True).close()
            if place:  # the sum of the seed before is not needed any more
                for split in self.splits():
                    self._fs.delete(self._path(self._at("running", split, f"seed={seeds[place - 1]}")), True)
        return {split: self._at("scores", split) for split in self.splits()}

    def splits(self) -> list[str]:
        folder = self._path(self._at("scores"))
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
