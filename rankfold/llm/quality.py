"""Quality classifier: logistic regression over hashed word n-grams, FTRL updates, sparse scores.

Features of a text: its distinct words and word pairs (and word triples on request), hashed
into ``2**bits`` slots. Each text's vector is scaled to length 1, so long and short texts weigh alike. A share
of slots near the top holds the text's shape: bins of its word count, its distinct-word share and
its shares of letters, capitals, digits and marks, and each of these as an n-gram feature like the words.

Training: follow-the-regularised-leader (proximal) over a bounded sample of labelled texts,
``train_rows`` per label, taken by the smallest hashes of the ids; one task gets their hashed
features, never the texts. Scoring is a map over all whole texts: gather the weights of a
text's slots, add, squash. The model is ``2**bits`` numbers whatever the input.

Defined cases: null and empty texts score the model's bias; rows with a null id are scored
but never learnt from; labels other than 0 and 1 are ignored; several labels of one id are
all used; with labels of one kind only, scores lean to it; without labels every score is 0.5; repeated
rows give a row each; other columns never reach the features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankfold.llm.common import GOLDEN, U64, extended, give_back, mixed, prefix_hash, span_hash, utf8, words

SHAPE_BINS = 24
BLOCK_BYTES = 1 << 19


def held_out(doc_id: str) -> Column:
    """True for the third of the ids that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Runs of consecutive texts of at most ``limit`` bytes, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def shape(data: np.ndarray, offsets: np.ndarray, n_words: np.ndarray, n_distinct: np.ndarray) -> np.ndarray:
    """Bins of the shape measures, one column each."""
    size = np.maximum(np.diff(offsets), 1)
    sums = []
    for kind in ((data >= 65) & (data <= 90), (data >= 48) & (data <= 57), ((data > 32) & (data < 48)) | ((data >= 58) & (data < 65)),
                 (data == 124), (data == 10), (data >= 128), (data == 32)):
        total = np.concatenate([[0], np.cumsum(kind)])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    bins = [np.minimum(np.log2(1 + n_words), SHAPE_BINS - 1).astype(np.int64)]
    bins += [np.minimum((np.sqrt(s) * SHAPE_BINS).astype(np.int64), SHAPE_BINS - 1) for s in sums]
    bins.append((n_distinct / np.maximum(n_words, 1) * (SHAPE_BINS - 1)).astype(np.int64))
    bins.append(np.minimum(size / np.maximum(n_words, 1), SHAPE_BINS - 1).astype(np.int64))
    return np.stack(bins, 1)


def features(data: np.ndarray, offsets: np.ndarray, bits: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text (all texts' slots, ascending by text) and their ends."""
    n = len(offsets) - 1
    starts, ends, before = words(data, offsets)
    first = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.empty(0, np.uint64)
    text = np.repeat(np.arange(n), np.diff(before))
    n_words = np.diff(before)
    grams, owners, gram = [first], [text], first
    for size in range(2, order + 1):
        gram = mixed(gram[:-1] * U64(GOLDEN) + first[size - 1:]) if len(gram) else gram
        inside = text[: len(gram)] == text[size - 1:] if len(gram) else np.empty(0, bool)
        grams.append(gram[inside])
        owners.append(text[: len(gram)][inside])
    slot = (np.concatenate(grams) >> U64(64 - bits)).astype(np.int64)
    both = np.unique(np.concatenate(owners) << bits | slot)
    owner = both >> bits
    distinct = np.bincount(np.unique((text << 40) | (first >> U64(24)).astype(np.int64)) >> 40, minlength=n) if len(first) else np.zeros(n)
    shapes = shape(data, offsets, n_words, distinct)
    fixed = mixed((shapes + SHAPE_BINS * np.arange(shapes.shape[1])).astype(np.uint64) + U64(1)) >> U64(64 - bits)
    slots = np.concatenate([both & ((1 << bits) - 1), fixed.astype(np.int64).ravel()])
    owner = np.concatenate([owner, np.repeat(np.arange(n), shapes.shape[1])])
    turn = np.argsort(owner, kind="stable")
    return slots[turn].astype(np.int32), np.cumsum(np.bincount(owner, minlength=n))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int, seed: int, alpha: float = 2.0, beta: float = 1.0,
         l1: float = 0.001, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL-proximal updates over the rows."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias = 1 << bits
    for epoch in range(epochs):
        for i in np.random.default_rng([seed, epoch]).permutation(len(rows)):
            at = rows[i]
            value = np.full(len(at) + 1, 1 / np.sqrt(len(at) or 1))
            value[-1] = 1.0
            at = np.append(at, bias)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - labels[i]) * value
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            np.add.at(z, at, g - s * w)
            np.add.at(n, at, g * g)
    w = weight(np.arange(bias + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 20, order: int = 2, train_rows: int = 6000,
        epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on at most ``train_rows`` texts per label, none of them held out. Returns weights and bias."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")) \
                   .select("doc_id", F.col(label).cast("int").alias("__label")).distinct()
    key = F.xxhash64(F.lit(seed), "doc_id")
    sample = None
    for value in (0, 1):
        part = usable.where(F.col("__label") == value).orderBy(key, "doc_id").limit(train_rows)
        sample = part if sample is None else sample.unionByName(part)
    # At most 2 * train_rows (id, label) pairs: the broadcast side is bounded by that parameter.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(offsets):
                slots, ends = features(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], bits, order)
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("__label").slice(a, b - a),
                     pa.array([slots[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary())], names=["doc_id", "__label", "slots"])

    hashed_rows = chosen.mapInArrow(hashed, extended(chosen.select("doc_id", "__label").schema, "slots binary"))
    # Copies of an id in ``docs`` could exceed the sample's bound: one row per (id, label).
    hashed_rows = hashed_rows.groupBy("doc_id", "__label").agg(F.min("slots").alias("slots"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "__label"])
        w, bias = ftrl([np.frombuffer(x, np.int32) for x in frame["slots"]], frame["__label"].to_numpy(float), bits, epochs, seed)
        used = np.flatnonzero(w)
        del frame
        give_back()
        return pd.DataFrame({"slots": [used.astype(np.int32).tobytes()], "weights": [w[used].tobytes()], "bias": [bias]})

    found = hashed_rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "slots binary, weights binary, bias double").collect()
    weights = np.zeros(1 << bits, np.float32)
    if not found:
        return weights, 0.0
    weights[np.frombuffer(found[0]["slots"], np.int32)] = np.frombuffer(found[0]["weights"], np.float32)
    return weights, found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = 20, order: int = 2, only_good: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5) for every whole text.

    ``only_good`` returns the rows predicted to be of quality, with the columns of ``docs`` alone.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.schema if only_good else extended(docs.schema, "score double, predicted int")

    def dot(batches):
        weights, bias = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(names.index("text")))
            scores = np.full(batch.num_rows, 0.5)
            for a, b in blocks(offsets):
                slots, ends = features(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], bits, order)
                total = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
                begins = np.concatenate([[0], ends[:-1]])
                z = bias + (total[ends] - total[begins]) / np.sqrt(np.maximum(ends - begins, 1))
                scores[a:b] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            if only_good:
                yield batch.filter(pa.array(scores >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                                 names=out.names)

    return docs.mapInArrow(dot, out)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled sample, then score all documents."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
