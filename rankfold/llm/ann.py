"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Inner-product search is turned into search by angle: every vector gets one more component that
brings all to the largest norm. Trees are fitted on a bounded sample (``sample_rows`` distinct vectors with the
smallest content hashes): each node splits at the sample's median along a random direction, the widest
spread of a few. All vectors are indexed. A query walks all trees at once through one priority queue, keyed by
the smallest margin on the way, and collects leaves until they hold ``search_k`` vectors; each leaf's
candidates are scored exactly, and the best of all leaves are kept. The leaves are asked in two
rounds: after the first ones a query has a k-th best score, and later leaves only answer with
candidates that reach it.

``search_k`` is measured, not guessed: a bounded number of queries is answered by brute force over all
vectors, and the smallest ``search_k`` with which the forest finds ``target_recall`` of their neighbours is taken.

Equal vectors are one index entry with the ``k + 1`` smallest of their ids (more can never be in
a result), so a vector that a third of all rows share neither fills a leaf nor is searched more than once.

Defined cases: rows with a null id, a null vector, an empty or zero vector, or null or
non-finite components take no part; vectors must share one length, others than the commonest are left out;
repeated ids count as one candidate per distinct vector; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm.common import stage

LEAST_SAMPLE = 8  # sample rows in a leaf
DIRECTIONS = 8  # random directions tried per node
QUERY_BLOCK = 20_000  # queries that meet a leaf's slice in one task
LEAF_SLICE = 20_000  # rows of a leaf that one task scores
FIRST_SHARE = 8  # the first round asks the leaves that hold this part of search_k
ENTRY = "h binary, vec binary, ids array<long>, asks boolean"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles) of the rows that take part."""
    finite = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & F.exists(vec_col, lambda x: x != 0)
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    return rows.where(F.size("vec") == (sizes["dim"] if sizes else 0))


def vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def hashed(rows: DataFrame) -> DataFrame:
    """(id, h, vec): a 128-bit content hash and the vector's bytes."""
    def name(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0
            raw = [v.tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                                              pa.array(raw, pa.binary())], names=["id", "h", "vec"])
    return rows.mapInArrow(name, "id long, h binary, vec binary")


def entries(rows: DataFrame, query_modulus: int, keep: int) -> DataFrame:
    """One entry per distinct vector: its smallest ids, and whether any of its rows is a query."""
    def local(batches):
        for batch in batches:
            held: dict[bytes, list] = {}
            for i, h, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                slot = held.setdefault(h, [vec, [], False])
                slot[1].append(i)
                slot[2] |= i % query_modulus == 0
            cols = [list(held), [s[0] for s in held.values()], [sorted(set(s[1]))[:keep] for s in held.values()], [s[2] for s in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.bool_())],
                                             names=["h", "vec", "ids", "asks"])

    # Batches hand on few ids per vector, so a shared vector's group is as small as the number of batches.
    merged = rows.mapInArrow(local, ENTRY).groupBy("h").agg(
        F.first("vec").alias("vec"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.bool_or("asks").alias("asks"))
    return merged.withColumn("ids", F.slice("ids", 1, keep))


class Forest:
    """Complete binary trees of one depth: directions and thresholds in level order."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.trees, self.depth = norm, trees, depth
        points = self.lifted(sample)
        inner = (1 << depth) - 1
        self.directions = np.zeros((trees, inner, points.shape[1]), np.float32)
        self.thresholds = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = [np.arange(len(points))]
            for node in range(inner):
                own = points[members[node]]
                tried = rng.standard_normal((DIRECTIONS, points.shape[1])).astype(np.float32)
                tried /= np.linalg.norm(tried, axis=1, keepdims=True)
                sides = own @ tried.T
                best = int(sides.var(0).argmax()) if len(own) else 0
                d, side = tried[best], sides[:, best]
                cut = np.float32(np.median(side)) if len(side) else np.float32(0)
                self.directions[t, node], self.thresholds[t, node] = d, cut
                members += [members[node][side < cut], members[node][side >= cut]]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to the largest norm, scaled to length 1."""
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(1), 0))
        return (np.concatenate([x, rest[:, None]], 1) / self.norm).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every vector in every tree."""
        points, out = self.lifted(x), np.empty((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", points, self.directions[t, node]) >= self.thresholds[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def walk(self, x: np.ndarray, sizes: np.ndarray):
        """Per query an iterator over (tree, leaf, vectors held so far) in the order of one shared priority queue."""
        norms = np.sqrt((x ** 2).sum(1, keepdims=True))
        q = np.concatenate([x / norms, np.zeros((len(x), 1))], 1).astype(np.float32)
        for row in q:
            yield self.leaves_of(row, sizes)

    def leaves_of(self, row: np.ndarray, sizes: np.ndarray):
        inner = (1 << self.depth) - 1
        margins = (self.directions @ row - self.thresholds).tolist() if inner else [[]] * self.trees
        queue, held = [(float("-inf"), t, 0) for t in range(self.trees)], 0
        heapq.heapify(queue)
        while queue:
            key, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t][node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(key, abs(m)), t, far))
                node = near
            size = int(sizes[t, node - inner])
            if size:
                held += size
                yield t, node - inner, held


def top_rows(scores: np.ndarray, least: np.ndarray, keep: int) -> np.ndarray:
    """Rows of the ``keep`` best scores, ties to the smaller id."""
    near = np.arange(len(scores))
    if len(scores) > keep:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep])
    return near[np.lexsort((least[near], -scores[near]))][:keep]


def calibrated(index: DataFrame, forest: Forest, sizes: np.ndarray, k: int, target: float, queries: int) -> int:
    """The smallest search_k that finds ``target`` of the brute-force neighbours of a few queries."""
    spark = index.sparkSession
    asked = index.where("asks").orderBy("h").limit(queries).select("h", "vec").collect()
    if not asked:
        return 1
    names, shared = {bytes(r[0]): i for i, r in enumerate(asked)}, spark.sparkContext.broadcast(vectors(pa.array([bytes(r[1]) for r in asked], pa.binary())))

    def brute(batches):
        for batch in batches:
            c, hs = vectors(batch.column("vec")), batch.column("h").to_pylist()
            at, out_h, out_s = [], [], []
            products = shared.value @ c.T
            for j, h in enumerate(hs):
                if h in names:
                    products[names[h], j] = -np.inf
            for i, scores in enumerate(products):
                for j in top_rows(scores, np.arange(len(scores)), k):
                    at.append(i)
                    out_h.append(j)
                    out_s.append(scores[j])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("vec").take(pa.array(out_h, pa.int64())),
                                              pa.array(out_s, pa.float64())], names=["q", "vec", "score"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec")
    true = (index.select("h", "vec").mapInArrow(brute, "q int, vec binary, score double").where("score > double('-Infinity')")
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "vec").collect())
    needed = []
    walks = list(forest.walk(shared.value, sizes))
    wanted: dict[int, list] = {}
    for r in true:
        wanted.setdefault(r[0], []).append(bytes(r[1]))
    for i, vecs in wanted.items():
        reached = {(t, leaf): held for t, leaf, held in walks[i]}
        for leaves in forest.leaves(vectors(pa.array(vecs, pa.binary()))):
            needed.append(min(reached[t, int(leaf)] for t, leaf in enumerate(leaves)))
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if needed else 1


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_modulus: int = 20, k: int = 20, trees: int = 12,
           leaf_rows: int = 256, target_recall: float = 0.95, calibration_queries: int = 200, sample_rows: int = 16384,
           seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id ``query_modulus`` divides."""
    spark = df.sparkSession
    rows = stage(hashed(usable(df, id_col, vec_col)), "vectors")
    index = stage(entries(rows, query_modulus, k + 1), "entries")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def norms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.sqrt((vectors(batch.column(0)) ** 2).sum(1)))], names=["norm"])

    norm = index.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    # A bounded sample: sample_rows distinct vectors, whatever the size of the table.
    sample = vectors(pa.array([bytes(r[0]) for r in index.orderBy("h").limit(sample_rows).select("vec").collect()], pa.binary()))
    depth = max(0, min(int(np.ceil(np.log2(max(n / leaf_rows, 1)))), int(np.log2(max(len(sample) / LEAST_SAMPLE, 1)))))
    forest = spark.sparkContext.broadcast(Forest(sample, norm, trees, depth, seed))

    def rows_in(batch, at, tree, leaf, kept):
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()),
                                           *[batch.column(c).take(at) for c in kept]], names=["tree", "leaf", *kept])

    def index_rows(batches):
        for batch in batches:
            leaves = forest.value.leaves(vectors(batch.column("vec")))
            for t in range(leaves.shape[1]):
                yield rows_in(batch, np.arange(batch.num_rows), np.full(batch.num_rows, t), leaves[:, t], ("h", "vec", "ids"))

    placed = stage(index.mapInArrow(index_rows, "tree int, leaf int, h binary, vec binary, ids array<long>"), "leaves")
    # At most trees * 2**depth leaf sizes, bounded by the sample.
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in placed.groupBy("tree", "leaf").count().collect():
        sizes[r[0], r[1]] = r[2]

    search_k = calibrated(index, forest.value, sizes, k, target_recall, calibration_queries)

    def asker(first: bool):
        """The leaves that every query asks in its first round, or in all after it; a leaf's number counts over all trees."""
        def ask(batches):
            for batch in batches:
                lists = []
                for found in forest.value.walk(vectors(batch.column("vec")), sizes):
                    before, own = 0, []
                    for t, x, held in found:
                        if before >= (search_k / FIRST_SHARE if first else search_k):
                            break
                        if first or before >= search_k / FIRST_SHARE:
                            own.append((t << depth) + x)
                        before = held
                    lists.append(own)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h", "vec", "floor")], pa.array(lists, pa.list_(pa.int32()))],
                                                 names=["h", "vec", "floor", "leaves"])
        return ask

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"qh": [], "ch": [], "ids": [], "score": []}
        if asked.num_rows and held.num_rows:
            q, c, floors = vectors(asked.column("vec")), vectors(held.column("vec")), asked.column("floor").to_numpy()
            names, ids, qh = held.column("h").to_pylist(), held.column("ids").to_pylist(), asked.column("h").to_pylist()
            least = np.array([x[0] for x in ids])
            for i in range(len(q)):
                scores = (c * q[i]).sum(1)
                reach = np.flatnonzero(scores >= floors[i])
                near = reach[top_rows(scores[reach], least[reach], k + 1)]
                out["qh"] += [qh[i]] * len(near)
                out["ch"] += [names[j] for j in near]
                out["ids"] += [ids[j] for j in near]
                out["score"] += scores[near].tolist()
        return pa.table({"qh": pa.array(out["qh"], pa.binary()), "ch": pa.array(out["ch"], pa.binary()),
                         "ids": pa.array(out["ids"], pa.list_(pa.int64())), "score": pa.array(out["score"], pa.float64())})

    asking = index.where("asks").select("h", "vec")
    cell = ["leaf", "slice", "block"]

    def dealt(rows: DataFrame, own: str, parts: str, other: str, copies: str) -> DataFrame:
        """Every row in its own part of its leaf, once for each part of the other side."""
        return (rows.withColumn(own, F.pmod(F.xxhash64("h"), F.col(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(parts, copies))

    def answers(queries: DataFrame, first: bool) -> DataFrame:
        # One row per query is written; its leaves are listed apart only on their way to the tasks.
        asked = stage(queries.mapInArrow(asker(first), "h binary, vec binary, floor double, leaves array<int>"), "asked")
        # At most trees * 2**depth leaves, bounded by the sample.
        counts = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
        plan = [(r[0], -(-int(sizes[r[0] >> depth, r[0] & ((1 << depth) - 1)]) // LEAF_SLICE), -(-r[1] // QUERY_BLOCK)) for r in counts]
        plan = F.broadcast(spark.createDataFrame(plan, "leaf int, slices int, blocks int"))
        want = dealt(asked.select("h", "vec", "floor", F.explode("leaves").alias("leaf")).join(plan, "leaf"), "block", "blocks", "slice", "slices")
        held = placed.withColumn("leaf", F.shiftleft("tree", depth) + F.col("leaf")).drop("tree").join(plan, "leaf")
        held = dealt(held, "slice", "slices", "block", "blocks")
        return want.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(rerank, "qh binary, ch binary, ids array<long>, score double")

    early = stage(answers(asking.withColumn("floor", F.lit(float("-inf"))), True), "early")
    kth = Window.partitionBy("qh").orderBy(F.col("score").desc(), "ch")
    floors = (early.dropDuplicates(["qh", "ch"]).withColumn("n", F.row_number().over(kth)).where(F.col("n") == k + 1)
              .select(F.col("qh").alias("h"), F.col("score").alias("floor")))
    late = answers(asking.join(floors, "h", "left").select("h", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), False)
    near = early.unionByName(late)
    # A vector comes from several trees; its first listed id and score are the same in all.
    near = near.dropDuplicates(["qh", "ch"])
    first = Window.partitionBy("qh").orderBy(F.col("score").desc(), F.col("ids")[0])
    best = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("qh", "score", F.explode("ids").alias("vec_id"))
    # Of equal vectors k + 1 ids are listed, one of which may be the query's own.
    order = Window.partitionBy("qh").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    queries = rows.where(F.col("id") % query_modulus == 0).select(F.col("id").alias("query_id"), F.col("h").alias("qh")).distinct()
    out = queries.join(best, "qh").where("query_id <> vec_id")
    last = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
