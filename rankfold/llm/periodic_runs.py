"""Runs of periodically repeated words, found through suffix trees of a text and of its reversal.

A run is a stretch of consecutive words with a smallest period ``q`` that no neighbouring word
extends. By the runs theorem every run has, for the order of letters or for its inverse, a Lyndon
word of length ``q`` as root, and at all but its first position that word is the longest Lyndon
word that starts there. So each position has two candidates:

1. Ukkonen's algorithm builds the suffix trees of the words and of their reversal.
2. An Euler tour visits the leaves in lexicographic order. The lowest node between two leaves is
   their common ancestor; a sparse table over the tour's branching depths gives the longest common
   extension of any two positions in constant time.
3. The longest Lyndon word at a position ends where the next smaller (or, for the inverse order, the
   next greater) suffix starts. That candidate root is extended to the right in the one tree and to
   the left in the other; long enough stretches are runs.

Each document is work of its own, so nothing is shuffled. A run of exponent ``e`` or more holds each of its
words ``floor(e)`` times, so words that are rarer in their stretch of text can lie in no run: they cut the
text, and the cut is repeated on what remains. The remaining stretches of many documents, kept apart by
letters that occur once, make up the text of one pair of trees, which the method sees as a whole. This
bounds the trees of ordinary prose without touching any run; a text that repeats throughout goes in whole.

Defined cases: null and empty texts have no words and no runs; null ids and repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankfold.llm.common import extended

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
TREE_WORDS = 1 << 15  # words of one pair of trees, or one longer stretch
ROUNDS = 8  # times that rare words cut a text; only the size of the trees depends on it
RUNS = "runs array<struct<start:long,length:long,period:long>>"


def suffix_tree(letters: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's suffix tree of ``letters`` (below ``width``, the last one unique).

    Returns each node's edge as ``start`` and ``end`` in the text, and the children as a map from
    ``node * width + letter`` to the child. Node 0 is the root.
    """
    n = len(letters)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, letter in enumerate(letters):
        waiting += 1
        fresh = 0  # the inner node that waits for its suffix link
        while waiting:
            if not length:
                edge = i
            key = node * width + letters[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                span = end[below] - start[below]
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                at = start[below] + length
                if letters[at] == letter:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                child[key] = inner
                child[inner * width + letters[at]] = below
                child[inner * width + letter] = inner + 1
                start += (start[below], i)
                end += (at, n)
                link += (0, 0)
                start[below] = at
                if fresh:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return start, end, child


class CommonExtensions:
    """Longest common extensions of the suffixes of ``letters`` in constant time each."""

    def __init__(self, letters: list[int], width: int):
        n = len(letters)
        start, end, child = suffix_tree(letters, width)
        keys = np.fromiter(child, np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        del child
        turn = np.argsort(keys)
        parents, nodes = keys[turn] // width, nodes[turn]
        first = np.searchsorted(parents, np.arange(len(start) + 1))
        up = np.zeros(len(start), np.int64)
        up[nodes] = parents
        eldest = np.zeros(len(start), bool)
        eldest[nodes[first[:-1][np.diff(first) > 0]]] = True
        # The tour: a leaf's branching depth is that of the node that parts it from the leaf before.
        order, low, depth, below = [], [], [0] * len(start), 0
        nodes, first, up, eldest = nodes.tolist(), first.tolist(), up.tolist(), eldest.tolist()
        stack = [0]
        while stack:
            node = stack.pop()
            above = depth[up[node]]
            if node:
                depth[node] = above + end[node] - start[node]
                if not eldest[node]:
                    below = above
            a, b = first[node], first[node + 1]
            if a == b:
                order.append(n - depth[node])
                low.append(below)
            else:
                stack += nodes[a:b][::-1]
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        level = np.array(low, np.int32)
        self.levels, step = [level], 1
        while 2 * step <= n:
            level = np.minimum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j`` (elementwise, i != j)."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        which = np.frexp((b - a).astype(np.float64))[1] - 1  # the largest power of two within the range
        out = np.empty(len(a), np.int64)
        for k in np.unique(which).tolist():
            mine = which == k
            out[mine] = np.minimum(self.levels[k][a[mine]], self.levels[k][b[mine] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word of every position ends, for the order of letters and for its inverse."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    down, rise = [], []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            smaller[down.pop()] = i
        down.append(i)
        while rise and rank[rise[-1]] < r:
            greater[rise.pop()] = i
        rise.append(i)
    return np.array(smaller), np.array(greater)


def runs_of(letters: list[int], width: int, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least both bounds, by start and period; letters lie below ``width``."""
    n = len(letters)
    if not n:
        return np.empty((0, 3), np.int64)
    ahead = CommonExtensions([*letters, width], width + 1)
    back = CommonExtensions([*letters[::-1], width], width + 1)
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([e[:n] for e in lyndon_ends(ahead.rank.tolist())])
    inside = j < n
    i, j = i[inside], j[inside]
    right = ahead.of(i, j)
    # Position k of the text is position n - 1 - k of the reversal; its closing letter stands for the place before the first.
    left = back.of(n - i, n - j)
    period, length = j - i, j - i + left + right
    found = length >= np.maximum(min_length, min_exponent * period)
    rows = np.stack([(i - left)[found], length[found], period[found]], 1)
    if not len(rows):
        return rows
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(words: list, times: int, min_length: int) -> list[tuple[int, int]]:
    """The stretches [a, b) of ``words`` that can hold runs: none has a word fewer than ``times`` times."""
    live, out = [(0, len(words), 0)], []
    while live:
        a, b, turn = live.pop()
        if b - a < min_length:
            continue
        part = words[a:b]
        count = Counter(part)
        rare = [k for k, w in enumerate(part, a) if count[w] < times] if turn < ROUNDS else []
        if not rare:
            out.append((a, b))
            continue
        at = a
        for k in [*rare, b]:
            if k - at >= min_length:
                live.append((at, k, turn + 1))
            at = k + 1
    return sorted(out)


def runs_of_texts(texts: list[list], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every text (a list of words), several texts per pair of trees."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places, letters, known, marks = [], [], {}, 0

    def solve():
        nonlocal places, letters, known, marks
        # Unique letters between the stretches: negative until the words are counted.
        width = len(known) + marks
        flat = [x if x >= 0 else len(known) - x - 1 for x in letters]
        begins = np.array([p[2] for p in places])
        for start, length, period in runs_of(flat, width, min_length, min_exponent).tolist():
            text, a, at = places[int(np.searchsorted(begins, start, "right")) - 1]
            out[text].append((start - at + a, length, period))
        places, letters, known, marks = [], [], {}, 0

    for t, words in enumerate(texts):
        for a, b in stretches(words, min_exponent, min_length):
            if letters and len(letters) + b - a > TREE_WORDS:
                solve()
            if letters:
                marks += 1
                letters.append(-marks)
            places.append((t, a, len(letters)))
            letters += [known.setdefault(w, len(known)) for w in words[a:b]]
    if letters:
        solve()
    return out


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: all runs by start and period, in words from 0, and the text's words without
    the repetitions (those a run holds behind its first period), joined by one space. ``min_exponent`` is 2 or more."""
    if min_exponent < 2:
        raise ValueError("a run holds its period at least twice")
    out = extended(docs.select("doc_id").schema, f"{RUNS}, collapsed string")
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def detect(batches):
        for batch in batches:
            size, held = 0, []
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode().translate(BLANKS)
                held.append([w for w in raw.split(b" ") if w])
                size += len(raw)
                if size >= 1 << 20 or i == len(batch) - 1:
                    found, kept = runs_of_texts(held, min_length, min_exponent), []
                    for words, runs in zip(held, found):
                        if runs:
                            stays = np.ones(len(words), bool)
                            for start, length, period in runs:
                                stays[start + period: start + length] = False
                            words = [words[k] for k in np.flatnonzero(stays).tolist()]
                        kept.append(b" ".join(words).decode())
                    ids = batch.column(0).slice(i + 1 - len(held), len(held))
                    rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(rows, shape), pa.array(kept, pa.string())], names=out.names)
                    size, held = 0, []

    return docs.select("doc_id", "text").mapInArrow(detect, out)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period, ties by start and period; null where there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def summary(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_runs``."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest().alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the texts, by the checksum of their id, repeat some words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    cut = docs.select("doc_id", "text", h.alias("h")).withColumn("w", words).withColumn("n", F.size("w"))
    cut = cut.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("case when n > 0 then cast(g % n as int) end"))
    cut = cut.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
