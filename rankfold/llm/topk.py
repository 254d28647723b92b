"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt to a grid of blocks; each cell scores its queries against its
candidates with one matrix product. A pass sends per query a histogram of the cell's scores:
only the bins down to the cell's own k-th score, since no lower bin can hold the global k-th.
The global histograms give the bin of each query's k-th score; the next pass splits that bin,
until bins are one score wide. A last pass keeps scores above the k-th value, and of those
equal to it the smallest ids, as many as are missing. What leaves a cell is at most k rows per query.

Vectors are scaled to whole numbers ``floor(scale * x)``; products are exact in double precision while
they stay below 2**53, beyond that whole-number arithmetic is used and scores are clipped to 64 bits.

Defined cases: rows with a null id, a null vector, or null or non-finite components take no
part; empty vectors only meet empty vectors and score 0, as vectors of different lengths never
meet; repeated query rows count once, repeated candidate rows each; every row with the
query's id is its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm.common import stage

BINS = 4096
EXACT = 1 << 53


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec) of the usable rows; vec holds whole numbers as doubles."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(vec_col, lambda x: F.rint(F.floor(x.cast("double") * scale).cast("double")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), whole.alias("vec"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, as int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if top < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) \
        else np.empty((0, 0))


def cell_scores(queries: pa.Table, candidates: pa.Table, step: int = 128):
    """Slices of queries with their scores against the cell's candidates and a mask of what takes part."""
    q, c = matrix(queries), matrix(candidates)
    own, ids = queries.column("id").to_numpy(), candidates.column("id").to_numpy()
    for a in range(0, len(own), step):
        scores = products(q[a: a + step].reshape(min(step, len(own) - a), -1), c.reshape(len(ids), -1))
        yield slice(a, a + len(scores)), scores, ids[None, :] != own[a: a + len(scores), None], ids


def counter(k: int, width: int, reach: int):
    """Cell function: per query the counts of the cell's k best scores, in bins of ``width`` over ``[low, low + reach)``."""
    def count(asked: pa.Table, cands: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and cands.num_rows:
            lows = asked.column("low").to_numpy()
            for part, scores, usable, _ in cell_scores(asked, cands):
                for i, (s, use) in enumerate(zip(scores, usable), part.start):
                    s = s[use]
                    if len(s) > k:
                        s = np.partition(s, len(s) - k)[len(s) - k:]
                    inside = s[(s >= lows[i]) & (s - lows[i] < reach)] - lows[i]
                    bins, n = np.unique(inside // width, return_counts=True)
                    rows.append((np.full(len(bins), i), bins, n))
        at, bins, n = (np.concatenate(x) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        at = pa.array(at, pa.int64())
        return pa.table({"id": asked.column("id").take(at), "spot": asked.column("spot").take(at),
                         "bin": pa.array(bins.astype(np.int64)), "n": pa.array(n.astype(np.int64))})
    return count


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, ties to the smaller id.

    Both tables have columns id and vec, as made by ``scaled``.
    """
    spark = candidates.sparkSession
    dim = F.size("vec").alias("dim")
    c = stage(candidates.select("id", "vec", dim, F.xxhash64("id", F.monotonically_increasing_id()).alias("spot")), "candidates")
    q = stage(queries.dropDuplicates(["id", "vec"]).select("id", "vec", dim, F.xxhash64("id", "vec").alias("spot")), "queries")
    peak = F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    n_c, most_c, dims = c.agg(F.count("*"), peak, F.max("dim")).first()
    n_q, most_q = q.agg(F.count("*"), peak).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n_c or not n_q:
        return spark.createDataFrame([], empty)
    wide = max(-(-n_c // candidate_block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    high = -(-n_q // query_block)
    left = c.withColumn("col", F.pmod("spot", F.lit(wide)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    right = q.withColumn("row", F.pmod("spot", F.lit(high)).cast("int"))

    def cells(state: DataFrame, fn, ddl: str) -> DataFrame:
        """Run ``fn`` on every cell; ``state`` has the queries' bounds."""
        asked = right.join(state, ["id", "spot"]).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
        grid = ["dim", "row", "col"]
        return asked.groupBy(*grid).cogroup(left.groupBy(*grid)).applyInArrow(fn, ddl)

    bound = min(int(most_c) * int(most_q) * max(int(dims), 1) + 1, (1 << 62) - 1)
    reach = 2 * bound + 1
    width = max(1, -(-reach // BINS))
    state = q.select("id", "spot", F.lit(-bound).cast("long").alias("low"), F.lit(k).alias("missing"))
    while True:
        histogram = cells(state, counter(k, width, reach), "id long, spot long, bin long, n long").groupBy("id", "spot", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id", "spot").orderBy(F.col("bin").desc())
        reached = histogram.withColumn("total", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # The bin where the missing count is reached; with fewer candidates than k, the lowest bin there is.
        found = (reached.join(state, ["id", "spot"]).withColumn("enough", F.col("total") >= F.col("missing"))
                 .groupBy("id", "spot", "low", "missing").agg(
                     F.coalesce(F.min(F.when(F.col("enough"), F.struct(F.col("total"), F.col("bin"), F.col("n")))),
                                F.max(F.struct(F.col("total"), F.col("bin"), F.col("n")))).alias("at")))
        state = stage(found.select("id", "spot", (F.col("low") + F.col("at.bin") * width).alias("low"),
                                   (F.col("missing") - (F.col("at.total") - F.col("at.n"))).cast("int").alias("missing")), "bounds")
        if width == 1:
            break
        reach, width = width, max(1, -(-width // BINS))

    def select(asked: pa.Table, cands: pa.Table) -> pa.Table:
        at, ids, kept = [], [], []
        if asked.num_rows and cands.num_rows:
            lows, missing = asked.column("low").to_numpy(), asked.column("missing").to_numpy()
            for part, scores, usable, names in cell_scores(asked, cands):
                for i, (s, use) in enumerate(zip(scores, usable), part.start):
                    above = np.flatnonzero(use & (s > lows[i]))
                    equal = np.flatnonzero(use & (s == lows[i]))
                    equal = equal[np.argsort(names[equal], kind="stable")[: missing[i]]]
                    took = np.concatenate([above, equal])
                    at.append(np.full(len(took), i))
                    ids.append(names[took])
                    kept.append(s[took])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        at = pa.array(cat(at), pa.int64())
        return pa.table({"query_id": asked.column("id").take(at), "spot": asked.column("spot").take(at), "vec_id": pa.array(cat(ids)),
                         "score": pa.array(cat(kept))})

    best = cells(state, select, "query_id long, spot long, vec_id long, score long")
    order = Window.partitionBy("query_id", "spot").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
