"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the plan is
made from the global histogram of lengths (at most ``capacity`` rows, whatever the input):
``plan_bins`` fills one bin greedily, largest piece first, then replaces its smallest piece by
two unpacked pieces that fit the expanded gap more tightly, and repeats that bin as often as
the counts allow. The piece that limits a pattern at least halves its count each time it does so, which
bounds the plan by about ``capacity * (2 + log2(capacity / length))`` patterns, some
thousands. Every piece then finds its sequence from its rank among the pieces of its length: a
rank inside its partition plus a prefix sum over the partitions, so that a length that a
third of all rows share is still numbered by many tasks.

Defined cases: null text counts as empty and gives one piece (the closing id 0); repeated
rows and null ids are packed as rows of their own; an empty table gives an empty result; all
other columns are ignored by ``token_pieces`` and kept by ``pack``. Only pieces longer than
the capacity or shorter than 1 get no sequence (null), never those of ``token_pieces``.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm import bpe
from rankfold.llm.common import extended, stage

PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, keep_ids: bool = False,
                 end_id: int = 0) -> DataFrame:
    """One row per piece of every whole text: its ids, closed by ``end_id``.

    Longer documents are cut into pieces of ``capacity`` ids, of which the first is the
    shorter one. ``keep_ids`` adds the piece's ids as ``array<int>``.
    """
    path = vocabulary or bpe.default_vocabulary()
    schema = extended(docs.select("doc_id").schema, PIECE_FIELDS + (", ids array<int>" if keep_ids else ""))

    def cut(batches):
        encode = bpe.whole_text_encoder(path)
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], np.uint32)
                at, size = 0, len(ids) % capacity or min(capacity, len(ids))
                number = 0
                while at < len(ids):
                    part = ids[at: at + size]
                    doc.append(i)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at, size, number = at + size, capacity, number + 1
            cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths of one bin, largest first; how many such bins) that use up the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    while counts.any():
        left, lengths, gap = counts.copy(), [], capacity
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            lengths.append(int(fitting[-1]))
            left[lengths[-1]] -= 1
            gap -= lengths[-1]
        while gap:
            pair = tighter_pair(left, lengths[-1], lengths[-1] + gap)
            if pair is None:
                break
            left[lengths.pop()] += 1
            gap = capacity - sum(lengths) - sum(pair)
            for length in pair:
                left[length] -= 1
            lengths = sorted([*lengths, *pair], reverse=True)
        times = min(int(counts[length]) // uses for length, uses in Counter(lengths).items())
        for length in lengths:
            counts[length] -= times
        patterns.append((lengths, times))
    return patterns


def tighter_pair(left: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum up to ``room`` that exceeds ``smallest``; None if there are none."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return None
    other = np.searchsorted(lengths, room - lengths, "right") - 1
    twice = (other >= 0) & (lengths[other] == lengths) & (left[lengths] < 2)
    other = other - twice
    total = np.where(other >= 0, lengths + lengths[other], 0)
    best = int(total.argmax())
    if total[best] <= smallest:
        return None
    return int(lengths[best]), int(lengths[other[best]])


def slots_of(patterns: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For every place of every pattern: its length, the first rank it takes, its first sequence, its offset."""
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add (or replace) ``sequence_id`` and ``offset`` in a table of pieces with a column ``length``."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    numbered = extended(pieces.schema, "__part int, __rank long")

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 2, np.int64)
        for batch in batches:
            length = batch.column(names.index("length")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            length = np.where((length >= 1) & (length <= capacity), length, capacity + 1)
            order = np.argsort(length, kind="stable")
            values, first, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(seen[values], count)
            seen[values] += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)],
                                             names=numbered.names)

    written = stage(pieces.mapInArrow(number, numbered), "pieces")
    fits = written.where(F.col("length").between(1, capacity))
    parts = fits.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("__n")).collect()}
    slots = slots_of(plan_bins(histogram, capacity), capacity)

    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = written.join(bases, ["__part", "length"], "left").select(*names, (F.col("__rank") + F.col("__base")).alias("__rank"))
    out = extended(pieces.schema, "sequence_id long, offset long")

    def place(batches):
        for batch in batches:
            rank = batch.column(len(names))
            length = batch.column(names.index("length")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            placed, rank = rank.is_valid(), rank.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.zeros(len(rank), np.int64)
            for value in np.unique(length[placed.to_numpy(zero_copy_only=False)]):
                mine = np.flatnonzero(length == value)
                lo, hi = np.searchsorted(slots["length"], [value, value + 1])
                at[mine] = lo + np.searchsorted(slots["first"][lo:hi], rank[mine], "right") - 1
            if len(slots["length"]):
                sequence, offset = slots["sequence"][at] + rank - slots["first"][at], slots["offset"][at]
            else:
                sequence = offset = at
            mask = ~placed.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence, mask=mask), pa.array(offset, mask=mask)],
                                             names=out.names)

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole documents and pack them: one row per piece with its sequence and place."""
    return pack(token_pieces(docs, capacity, vocabulary, keep_ids), capacity)
