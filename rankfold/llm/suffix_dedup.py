"""Removal of repeated passages: byte strings of ``length`` bytes that also start earlier.

A suffix array of a whole corpus would sort every byte's suffix. Here only those suffixes are
sorted that can have an equal prefix at all:

1. Every window of ``length`` bytes is filed under its anchor, the smallest hash of its byte
   k-grams (leftmost on ties). Equal windows have equal anchors. Consecutive windows with the
   same anchor position form a run of at most ``length - GRAM + 1`` windows.
2. Each chunk of texts sends its runs to buckets by anchor hash. A run whose bytes equal an
   earlier run's is covered as a whole. Anchors that occur once are done. Of anchors with
   several distinct runs the earliest of each are kept for sorting; all others are settled.
3. The kept runs' bytes are cut out of the texts and sent to buckets by anchor. Each bucket
   builds the suffix array of its bytes by a difference cover modulo 3: sample positions
   (1 and 2 modulo 3) are sorted by triples of letters, named, and the names sorted by triples again until
   they name ``length`` bytes; the remaining suffixes are ordered by their first
   letter and the rank behind it, and merged. Adjacent suffixes are then compared
   byte by byte over ``length`` bytes: of a group of equal windows, all but the earliest are covered.

An anchor with many distinct runs in one chunk or in all (the edge of a passage that many texts share)
is split: its runs are compared by bucket of their content. A window of such a run is as long as the sort would compare,
so it goes by its whole content instead (``earlier_windows``): a chunk sends each distinct content once, with its smallest id, and
gets one bit back for it. So copies of a window meet only once per chunk, and no window is a row of its own.

Earlier means a smaller doc_id, or the same row and a smaller start. Defined cases: null and
short texts keep all bytes; rows with a null id are left as they are and remove nothing
elsewhere; rows that repeat an id do not remove each other's bytes; an empty table gives an empty
result; other columns are carried by ``deduplicate`` and ignored by ``removals``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import CHUNK_ROWS, GOLDEN, MASK, U64, buckets_for, chunk_name, give_back, mixed, prefix_hash, span_hash, stage, total_bytes, utf8
from rankfold.llm.quality import blocks

LENGTH = 100
GRAM = 32
BLOCK = 1 << 19  # bytes of text hashed at once
HOT = 64  # runs of one anchor in a chunk, above which they are split
SPLIT = 512  # runs of one anchor in all chunks, above which they are split
DOC, RUNS, LISTED, COVERED, ASKED = 0, 1, 2, 3, 4
PLAIN, WAIT, CONTENT, SPAN = 0, 1, 2, 3  # bytes to sort; of split anchors: windows, their contents, windows covered in the chunk itself
CHUNK_WINDOWS = 1 << 18  # windows of split anchors in one chunk
FIELDS = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.string(), "at": pa.int32(), "doc_id": pa.int64(), "tag": pa.int64(),
          "s": pa.int32(), "e": pa.int32(), "h": pa.int64(), "hot": pa.int32(), "body": pa.binary()}
DDL = "bucket int, kind int, chunk string, at int, doc_id long, tag long, s int, e int, h long, hot int, body binary"
RUN = (("h", "<u8"), ("name", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("s", "<u4"), ("n", "<u4"))


def rows_of(**columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in FIELDS.items()})


def squeeze(runs: dict[str, np.ndarray]) -> bytes:
    """Runs as compressed byte planes; anchor hashes, ascending, as differences."""
    parts = [np.uint64(len(runs["h"])).tobytes()]
    for name, kind in RUN:
        values = np.diff(runs["h"], prepend=U64(0)) if name == "h" else runs[name]
        raw = np.ascontiguousarray(values.astype(kind))
        parts.append(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if len(raw) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.uint64, 1)[0]), 8, {}
    for name, kind in RUN:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out[name], at = np.ascontiguousarray(planes.T).view(kind).ravel(), at + width * n
    out["h"] = np.cumsum(out["h"], dtype=np.uint64)
    return out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor position: anchor hash, content name, text, start, number of windows."""
    windows = len(data) - length + 1
    if windows <= 0:
        return {name: np.empty(0, kind) for name, kind in RUN if name != "doc"}
    h, m = data.astype(np.uint64) + U64(1), 1
    while m < GRAM:
        h, m = h[:-m] * U64(pow(GOLDEN, m, 1 << 64)) + h[m:], 2 * m
    h = mixed(h)
    low, where, m, width = h, np.arange(len(h), dtype=np.int32), 1, length - GRAM + 1
    while m < width:
        step = min(m, width - m)
        left = low[:-step] <= low[step:]
        low, where, m = np.where(left, low[:-step], low[step:]), np.where(left, where[:-step], where[step:]), m + step
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = text[:windows] == text[length - 1:]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (where[1:] != where[:-1])
    s = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (where[1:] != where[:-1])
    n = np.flatnonzero(last) - s + 1
    name = span_hash(prefix_hash(data), s, s + n + length - 1)
    return {"h": low[s], "name": name, "at": text[s].astype(np.int64), "s": s - offsets[text[s]], "n": n}


def settle(runs: dict[str, np.ndarray], row: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Sort runs by anchor, name, doc and place; flags of those that an equal earlier run covers. ``row`` tells rows apart."""
    turn = np.lexsort((runs["s"], row, runs["doc"], runs["name"], runs["h"]))
    runs, row = {k: v[turn] for k, v in runs.items()}, row[turn]
    if not len(row):
        return runs, row, np.empty(0, bool)
    new = np.ones(len(row), bool)
    new[1:] = (runs["h"][1:] != runs["h"][:-1]) | (runs["name"][1:] != runs["name"][:-1])
    begins = np.flatnonzero(new)
    earliest = np.repeat(runs["doc"][begins], np.diff(np.append(begins, len(row))))
    again = ~new
    again[1:] &= row[1:] == row[:-1]
    return runs, row, (runs["doc"] > earliest) | again


def per_anchor(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the rows of the same anchor; ``h`` is sorted."""
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return np.repeat(np.add.reduceat(values, begins), np.diff(np.append(begins, len(h))))


def chunk_runs(docs: DataFrame, buckets: int, chunk_bytes: int, length: int) -> DataFrame:
    """Per chunk of texts: a row per document, its covered runs, and its other runs by bucket."""
    def close(number, ids, tags, parts):
        chunk, n = chunk_name(number), len(ids)
        aside = buckets + zlib.crc32(chunk.encode()) % buckets  # rows that no bucket needs, spread over tasks
        yield rows_of(bucket=[aside] * n, kind=[DOC] * n, chunk=[chunk] * n, at=list(range(n)), doc_id=ids, tag=tags)
        runs = {k: np.concatenate([p[k] for p in parts]) for k in ("h", "name", "at", "s", "n")}
        known = np.array([i is not None for i in ids])[runs["at"].astype(np.int64)]
        runs = {k: v[known] for k, v in runs.items()}
        if not len(runs["h"]):
            return
        runs["doc"] = np.array([0 if i is None else i for i in ids], np.int64)[runs["at"].astype(np.int64)]
        runs, _, covered = settle(runs, runs["at"].astype(np.int64))
        yield from covered_rows(aside, [chunk], np.zeros(len(covered), np.int64), runs, covered, length)
        runs = {k: v[~covered] for k, v in runs.items()}
        many = per_anchor(runs["h"], np.ones(len(runs["h"]), np.int64)) > HOT
        if many.any():
            yield rows_of(bucket=[aside], kind=[LISTED], chunk=[chunk], body=[squeeze({k: v[many] for k, v in runs.items()})])
            hs = np.unique(runs["h"][many])
            # A split anchor is announced to its bucket by a run without windows.
            marks = {k: hs if k == "h" else np.zeros(len(hs), np.int64) for k in runs}
            runs = {k: np.concatenate([v[~many].astype(marks[k].dtype), marks[k]]) for k, v in runs.items()}
            turn = np.argsort(runs["h"], kind="stable")
            runs = {k: v[turn] for k, v in runs.items()}
        # Anchors are minima, so small hashes abound: buckets go by the hash of the hash.
        place = ((mixed(runs["h"]) >> U64(32)).astype(np.int64) * buckets) >> 32
        turn = np.argsort(place, kind="stable")
        runs, place = {k: v[turn] for k, v in runs.items()}, place[turn]
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        yield rows_of(bucket=used.tolist(), kind=[RUNS] * len(used), chunk=[chunk] * len(used),
                      body=[squeeze({k: v[a:b] for k, v in runs.items()}) for a, b in zip(cuts[used], cuts[used + 1])])

    def cut(batches):
        ids, tags, parts, held, number = [], [], [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets, BLOCK):
                runs = anchored_runs(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], length)
                runs["at"] = runs["at"] + len(ids)
                parts.append(runs)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                tags += batch.column(2).slice(a, b - a).to_pylist()
                held += int(offsets[b] - offsets[a])
                if held >= chunk_bytes or len(ids) >= CHUNK_ROWS:
                    for t in close(number, ids, tags, parts):
                        yield from t.to_batches()
                    give_back()
                    ids, tags, parts, held, number = [], [], [], 0, number + 1
        if ids:
            for t in close(number, ids, tags, parts):
                yield from t.to_batches()

    return docs.select("doc_id", "text", "tag").mapInArrow(cut, DDL)


def covered_rows(bucket, chunks, source, runs, covered, length):
    """The covered runs as spans [s, e) of their rows, overlapping ones merged."""
    if not covered.any():
        return
    at, s, e = (runs[k][covered].astype(np.int64) for k in ("at", "s", "n"))
    e, source = s + e + length - 1, source[covered]
    at, s, e = merged(source << 32 | at, s, e)
    yield rows_of(bucket=[bucket] * len(at), kind=[COVERED] * len(at), chunk=[chunks[i] for i in (at >> 32).tolist()],
                  at=at & 0xFFFFFFFF, s=s, e=e)


def merged(owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each owner."""
    if not len(owner):
        return owner, s, e
    turn = np.lexsort((s, owner))
    owner, s, e = owner[turn], s[turn], e[turn]
    begins = np.ones(len(owner), bool)
    begins[1:] = owner[1:] != owner[:-1]
    # Running end within an owner: owners are lifted apart, so one running maximum does.
    base = np.cumsum(begins) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + base)
    opens = begins.copy()
    opens[1:] |= s[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    return owner[at], s[at], (reach - base)[np.append(at[1:], len(s)) - 1]


def asked_rows(chunks, source, runs, hot):
    """Requests for the bytes of runs."""
    n = len(source)
    return rows_of(kind=[ASKED] * n, chunk=[chunks[i] for i in source.tolist()], at=runs["at"].astype(np.int64), s=runs["s"].astype(np.int64),
                   e=runs["n"].astype(np.int64), h=runs["h"].view(np.int64), hot=[hot] * n)


def settle_bucket(table: pa.Table, length: int) -> pa.Table:
    """Of a bucket's anchors: covered runs, and requests where several distinct runs remain."""
    if table.column("kind")[0].as_py() != RUNS:
        return table
    chunks = table.column("chunk").to_pylist()
    parts = [unsqueeze(b.as_py()) for b in table.column("body")]
    source = np.repeat(np.arange(len(parts)), [len(p["h"]) for p in parts])
    runs = {k: np.concatenate([p[k] for p in parts]) for k, _ in RUN}
    runs, row, covered = settle(runs, source << 32 | runs["at"].astype(np.int64))
    source, mark = row >> 32, runs["n"] == 0
    split = (per_anchor(runs["h"], mark.astype(np.int64)) > 0) | (per_anchor(runs["h"], (~covered & ~mark).astype(np.int64)) > SPLIT)
    out = list(covered_rows(None, chunks, source, runs, covered & ~mark, length))
    left = ~covered & ~mark
    several = per_anchor(runs["h"], left.astype(np.int64)) > 1
    ask = left & several & ~split
    if ask.any():
        out.append(asked_rows(chunks, source[ask], {k: v[ask] for k, v in runs.items()}, 0))
    for i in np.unique(source[left & split]).tolist():
        mine = left & split & (source == i)
        out.append(rows_of(kind=[LISTED], chunk=[chunks[i]], body=[squeeze({k: v[mine] for k, v in runs.items()})]))
    del parts, runs
    give_back()
    return pa.concat_tables(out) if out else rows_of(kind=[]).slice(0, 0)


def settle_listed(listed: DataFrame, buckets: int, length: int) -> DataFrame:
    """Runs of split anchors, compared by bucket of anchor and name."""
    def spread(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = unsqueeze(body.as_py())
                place = ((mixed(runs["h"] ^ runs["name"]) >> U64(32)).astype(np.int64) * buckets) >> 32
                for b in np.unique(place).tolist():
                    mine = place == b
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk]),
                                                      pa.array([squeeze({k: v[mine] for k, v in runs.items()})], pa.binary())],
                                                     names=["bucket", "chunk", "body"])

    def compare(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = [unsqueeze(b.as_py()) for b in table.column("body")]
        source = np.repeat(np.arange(len(parts)), [len(p["h"]) for p in parts])
        runs = {k: np.concatenate([p[k] for p in parts]) for k, _ in RUN}
        runs, row, covered = settle(runs, source << 32 | runs["at"].astype(np.int64))
        out = list(covered_rows(None, chunks, row >> 32, runs, covered, length))
        out.append(asked_rows(chunks, (row >> 32)[~covered], {k: v[~covered] for k, v in runs.items()}, 1))
        return pa.concat_tables(out)

    return listed.select("chunk", "body").mapInArrow(spread, "bucket int, chunk string, body binary").groupBy("bucket").applyInArrow(compare, DDL)


def names_of(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of whole numbers below 2**32, in lexicographic order."""
    name = columns[0]
    for i, column in enumerate(columns):
        key = column.astype(np.uint64) if i == 0 else name.astype(np.uint64) << U64(32) | column.astype(np.uint64)
        name = np.unique(key, return_inverse=True)[1].astype(np.uint32)
    return name


def words_at(data: np.ndarray, extra: int) -> np.ndarray:
    """Big-endian words of 8 bytes at every place of the data and of ``extra`` zero bytes behind it."""
    padded = np.concatenate([data, np.zeros(extra + 8, np.uint8)])
    word = np.zeros(len(data) + extra, np.uint64)
    for i in range(8):
        word <<= U64(8)
        word |= padded[i: i + len(word)]
    return word


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """``starts`` in the lexicographic order of the ``length`` bytes behind them.

    Difference cover modulo 3. Letters are words of 8 bytes; a triple of letters names 24 bytes,
    a triple of names 72, and so on by whole triples until ``length`` bytes are named.
    """
    if not len(starts):
        return starts
    size = len(data)
    padded = np.concatenate([data, np.zeros(4 * length, np.uint8)])
    word = words_at(data, 3 * length)
    letter = np.unique(word, return_inverse=True)[1].astype(np.uint32)
    del word
    # Names are kept for sample positions; others stay 0 and are never looked at.
    sample = np.arange(size, dtype=np.int32)
    sample = sample[sample % 3 != 0]
    name, depth = np.zeros(len(letter), np.uint32), 24
    name[sample] = names_of(letter[sample], letter[sample + 8], letter[sample + 16])
    while 3 * depth <= length - 2:
        further = np.zeros_like(name)
        further[sample] = names_of(name[sample], name[sample + depth], name[sample + 2 * depth])
        name, depth = further, 3 * depth

    def ranks(at: np.ndarray, upto: int) -> list[np.ndarray]:
        """Columns that order sample positions by exactly ``upto`` bytes; steps of 3 stay in the sample."""
        columns, done = [], 0
        while upto - done >= depth:
            columns.append(name[at + done])
            done += depth
        rest = upto - done
        if rest >= 3:
            step = done - (depth - rest // 3 * 3) if done else 0
            columns.append(name[at + step])
            done = step + depth
        return columns + [padded[at + i] for i in range(done, upto)]

    where = starts % 3
    inner, outer = starts[where != 0], starts[where == 0]
    inner = inner[np.argsort(names_of(*ranks(inner, length)), kind="stable")] if len(inner) else inner
    if not len(outer):
        return inner
    # The remaining suffixes: first letter, then the rank of the sample suffix behind it.
    one, two = inner[inner % 3 == 1], inner[inner % 3 == 2]
    behind = names_of(*ranks(np.concatenate([outer, one]) + 1, length - 1)).astype(np.uint64)
    key = padded[np.concatenate([outer, one])].astype(np.uint64) << U64(40) | behind
    key_outer, key_one = key[: len(outer)], key[len(outer):]
    turn = np.argsort(key_outer, kind="stable")
    outer, key_outer = outer[turn], key_outer[turn]
    both = np.concatenate([outer, two])
    behind = names_of(*ranks(both + 2, length - 2)).astype(np.uint64)
    key = (padded[both].astype(np.uint64) << U64(8) | padded[both + 1].astype(np.uint64)) << U64(40) | behind
    key_outer_2, key_two = key[: len(outer)], key[len(outer):]
    # Merge: a remaining suffix stands behind all smaller ones of either sample class.
    place = np.searchsorted(key_one, key_outer) + np.searchsorted(key_two, key_outer_2)
    return np.insert(inner, place, outer)


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix of the order begins with the same ``length`` bytes as the one before it."""
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    word, short = words_at(data, 8), length % 8
    for i in range(0, length - short, 8):
        live = live[word[order[live] + i] == word[order[live - 1] + i]]
    if short:
        at = length - short
        live = live[word[order[live] + at] >> U64(64 - 8 * short) == word[order[live - 1] + at] >> U64(64 - 8 * short)]
    same[live] = True
    return same


def repeated_windows(table: pa.Table, length: int) -> pa.Table:
    """Covered spans of a bucket's byte strings: windows that equal an earlier window."""
    bodies = table.column("body").to_pylist()
    doc, tag, at = (table.column(c).to_numpy() for c in ("doc_id", "tag", "s"))
    # Rows of the strings, numbered in (doc, tag) order; ``docs`` numbers their documents.
    turn = np.lexsort((tag, doc))
    new_doc = np.concatenate([[True], doc[turn][1:] != doc[turn][:-1]])
    new_row = new_doc | np.concatenate([[True], tag[turn][1:] != tag[turn][:-1]])
    row = np.empty(len(doc), np.int64)
    row[turn] = np.cumsum(new_row) - 1
    docs = (np.cumsum(new_doc) - 1)[new_row]
    first = turn[new_row]

    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    del bodies
    begin = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    starts = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)
    order = suffix_order(data, starts, length)
    same = equal_neighbours(data, order, length)
    # Only windows that equal another one go on.
    several = same.copy()
    several[:-1] |= same[1:]
    group, order = np.cumsum(~same)[several], order[several]
    owner = np.searchsorted(begin, order, "right") - 1
    place = at[owner] + order - begin[owner]
    key = group << 32 | row[owner]
    turn = np.lexsort((place, key))
    key, place = key[turn], place[turn].astype(np.int64)
    group, owner = key >> 32, key & 0xFFFFFFFF
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    earliest = np.repeat(docs[owner[begins]], np.diff(np.append(begins, len(group))))
    again = np.zeros(len(group), bool)
    same_row = key[1:] == key[:-1]
    again[1:] = same_row & (place[1:] > place[:-1])
    # Copies of a row repeat its places; each copy of a covered place is covered.
    for i in np.flatnonzero(same_row & (place[1:] == place[:-1])).tolist():
        again[i + 1] |= again[i]
    hit = (docs[owner] > earliest) | again
    which, s, e = merged(owner[hit], place[hit], place[hit] + length)
    del data, starts, order, key, turn
    give_back()
    return pa.table({"doc_id": pa.array(doc[first[which]]), "tag": pa.array(tag[first[which]]), "s": pa.array(s, pa.int32()), "e": pa.array(e, pa.int32())})


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes; whole numbers that rise slowly are best sent as differences."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(
        np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T).tobytes() for v in arrays.values()))


def unpack_arrays(blob: bytes, **kinds: str) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds.values()), 0, {}
    for name, kind in kinds.items():
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()
        at += width * n
    return out


PENDING = {"doc": "<i8", "tag": "<i8", "s": "<i4", "group": "<u4"}  # windows of a chunk that wait for an answer, by row and place
ASKING = {"first": "<u8", "second": "<u8", "doc": "<i8"}  # distinct contents of a chunk and the smallest id of each


def spans_of_windows(doc: np.ndarray, tag: np.ndarray, s: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The union of the windows of each row as spans."""
    turn = np.lexsort((tag, doc))
    doc, tag, s = doc[turn], tag[turn], s[turn].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    owner, a, e = merged(np.cumsum(new) - 1, s, s + length)
    return {"doc_id": doc[new][owner], "tag": tag[new][owner], "s": a, "e": e}


def asked_windows(chunk: str, rows: list[tuple[int, int, int, bytes]], buckets: int, length: int):
    """What a chunk of windows (doc_id, tag, s, digest of the content) sends: spans that an earlier window of the same chunk
    covers, the windows that wait, and by bucket the distinct contents with their smallest id."""
    doc, tag, s = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    digest = np.frombuffer(b"".join(r[3] for r in rows), "<u8").reshape(-1, 2)
    turn = np.lexsort((s, tag, doc, digest[:, 1], digest[:, 0]))
    doc, tag, s, digest = doc[turn], tag[turn], s[turn], digest[turn]
    new = np.ones(len(doc), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
    group, least = np.cumsum(new) - 1, doc[new]
    opens = new.copy()
    opens[1:] |= (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    covered = (doc > least[group]) | (s > s[opens][np.cumsum(opens) - 1])
    if covered.any():
        found = spans_of_windows(doc[covered], tag[covered], s[covered], length)
        yield {"what": [SPAN] * len(found["s"]), **found}
    wait = np.flatnonzero(~covered)
    wait = wait[np.lexsort((s[wait], tag[wait], doc[wait]))]
    pending = {"doc": doc[wait], "tag": tag[wait], "s": np.diff(s[wait], prepend=0), "group": group[wait]}
    yield {"what": [WAIT], "chunk": [chunk], "body": [pack_arrays(**{k: v.astype(PENDING[k]) for k, v in pending.items()})]}
    first, second = digest[new].T
    place = ((first >> U64(32)).astype(np.int64) * buckets) >> 32  # rises with the digests' order
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    body = [pack_arrays(first=first[a:b], second=second[a:b], doc=least[a:b]) for a, b in zip(cuts[used], cuts[used + 1])]
    yield {"what": [CONTENT] * len(used), "chunk": [chunk] * len(used), "bucket": used.tolist(), "body": body}


def contexts(asked: DataFrame, buckets: int, window_buckets: int, length: int) -> DataFrame:
    """The requested byte strings, by bucket of their anchor; of split anchors the contents of all windows, by chunk."""
    def cut(batches):
        out, windows, number = {c: [] for c in KINDS}, [], 0
        for batch in batches:
            for doc, text, tag, asks in zip(*batch.columns):
                if not asks.is_valid or asks.as_py() is None:
                    continue
                raw, doc, tag = text.as_py().encode(), doc.as_py(), tag.as_py()
                for r in asks.as_py():
                    if r["hot"]:
                        windows += [(doc, tag, s, hashlib.blake2b(raw[s: s + length], digest_size=16).digest()) for s in range(r["s"], r["s"] + r["e"])]
                    else:
                        place = ((r["h"] * GOLDEN & MASK) >> 32) * buckets >> 32
                        body = raw[r["s"]: r["s"] + r["e"] + length - 1]
                        for c, value in (("what", PLAIN), ("bucket", place), ("doc_id", doc), ("tag", tag), ("s", r["s"]), ("body", body)):
                            out[c].append(value)
                if len(out["s"]) >= 20000:
                    yield made(out)
                    out = {c: [] for c in KINDS}
                if len(windows) >= CHUNK_WINDOWS:
                    yield from map(made, asked_windows(chunk_name(number), windows, window_buckets, length))
                    windows, number = [], number + 1
        if out["s"]:
            yield made(out)
        if windows:
            yield from map(made, asked_windows(chunk_name(number), windows, window_buckets, length))
        give_back()

    def made(out):
        n = len(out["what"])
        return pa.RecordBatch.from_arrays([pa.array(out[c], t) if len(out.get(c, ())) else pa.nulls(n, t) for c, t in KINDS.items()], names=list(KINDS))

    KINDS = {"what": pa.int32(), "bucket": pa.int32(), "chunk": pa.string(), "doc_id": pa.int64(), "tag": pa.int64(), "s": pa.int32(),
             "e": pa.int32(), "body": pa.binary()}
    return asked.mapInArrow(cut, "what int, bucket int, chunk string, doc_id long, tag long, s int, e int, body binary")


def earlier_windows(cut: DataFrame, length: int) -> DataFrame:
    """Spans of the waiting windows whose content a smaller id of another chunk also holds.

    A bucket sees each content once per chunk and answers every chunk with one bit per content it sent.
    """
    schema = "chunk string, bucket int, body binary"

    def answer(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b.as_py(), **ASKING) for b in table.column("body")]
        sizes = np.cumsum([len(p["doc"]) for p in parts])
        first, second, doc = (np.concatenate([p[k] for p in parts]) for k in ASKING)
        turn = np.lexsort((doc, second, first))
        new = np.ones(len(turn), bool)
        new[1:] = (first[turn][1:] != first[turn][:-1]) | (second[turn][1:] != second[turn][:-1])
        earlier = np.empty(len(turn), bool)
        earlier[turn] = doc[turn] > doc[turn][new][np.cumsum(new) - 1]
        body = [np.uint32(len(x)).tobytes() + np.packbits(x).tobytes() for x in np.split(earlier, sizes[:-1])]
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(body, pa.binary())], names=["chunk", "bucket", "body"])

    def settle_chunk(table: pa.Table) -> pa.Table:
        turn = np.argsort(np.array([-1 if b is None else b for b in table.column("bucket").to_pylist()]))
        bodies = table.column("body").take(pa.array(turn)).to_pylist()  # the waiting windows, then the answers by bucket
        pending = unpack_arrays(bodies[0], **PENDING)
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 4), count=int(np.frombuffer(b, np.uint32, 1)[0])) for b in bodies[1:]])
        covered = bits[pending["group"]].astype(bool)
        s = np.cumsum(pending["s"], dtype=np.int64)
        found = spans_of_windows(pending["doc"][covered], pending["tag"][covered], s[covered], length) if covered.any() else \
            {k: np.empty(0, np.int64) for k in ("doc_id", "tag", "s", "e")}
        return pa.table({"doc_id": found["doc_id"], "tag": found["tag"], "s": pa.array(found["s"], pa.int32()), "e": pa.array(found["e"], pa.int32())})

    answers = cut.where(F.col("what") == CONTENT).select("chunk", "bucket", "body").groupBy("bucket").applyInArrow(answer, schema)
    waiting = cut.where(F.col("what") == WAIT).select("chunk", "bucket", "body")
    return waiting.unionByName(answers).groupBy("chunk").applyInArrow(settle_chunk, "doc_id long, tag long, s int, e int")


def covered_spans(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20,
                  sort_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` (doc_id, text, tag) with the array ``spans`` of the byte spans to remove (null: none)."""
    total = total_bytes(docs, "text")
    buckets = buckets_for(total, bucket_bytes, docs.sparkSession)
    sent = chunk_runs(docs, buckets, chunk_bytes, length)
    held = stage(sent.groupBy("bucket").applyInArrow(lambda t: settle_bucket(t, length), DDL), "runs", "kind")
    listed = stage(settle_listed(held.where(F.col("kind") == LISTED), buckets, length), "listed", "kind")
    rows = held.where(F.col("kind") == DOC).select("chunk", "at", "doc_id", "tag")
    settled = held.unionByName(listed)
    asked = (settled.where(F.col("kind") == ASKED).select("chunk", "at", "s", "e", "h", "hot").join(rows, ["chunk", "at"])
             .groupBy("doc_id", "tag").agg(F.collect_set(F.struct("s", "e", "h", "hot")).alias("asks")))
    # A left join here and below, so that both use the same shuffled texts.
    cut = stage(contexts(docs.join(asked, ["doc_id", "tag"], "left").select("doc_id", "text", "tag", "asks"),
                         buckets_for(total, sort_bytes, docs.sparkSession), buckets, length), "windows", "what")
    plain = cut.where(F.col("what") == PLAIN).select("bucket", "doc_id", "tag", "s", "body")
    found = plain.groupBy("bucket").applyInArrow(lambda t: repeated_windows(t, length), "doc_id long, tag long, s int, e int")
    found = found.unionByName(earlier_windows(cut, length)).unionByName(cut.where(F.col("what") == SPAN).select("doc_id", "tag", "s", "e"))
    known = settled.where(F.col("kind") == COVERED).select("chunk", "at", "s", "e").join(rows, ["chunk", "at"]).select("doc_id", "tag", "s", "e")
    spans = known.unionByName(found).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return docs.join(spans, ["doc_id", "tag"], "left")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tag", F.xxhash64("text"))


def kept_parts(raw: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal spans."""
    if not spans:
        return raw, 0
    s, e = np.array([(x["s"], x["e"]) for x in spans], np.int64).T
    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), len(s)


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans = covered_spans(keyed(docs.select("doc_id", "text")), length).select("doc_id", "text", "spans")

    def digest(batches):
        for batch in batches:
            n, removed, count, sha = [], [], [], []
            for text, cover in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                kept, spans_ = kept_parts(raw, cover.as_py())
                n.append(len(raw))
                removed.append(len(raw) - len(kept))
                count.append(spans_)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                                              pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the covered bytes cut out of their texts; split characters at the edges of a cut go with it."""
    names, fields = docs.columns, docs.schema
    work = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tag", F.xxhash64("text"))
    spans = covered_spans(work.select("doc_id", "text", "tag", "__row"), length).select("__row", "text", "spans")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, cover in zip(batch.column(1), batch.column(2)):
                if cover.as_py():
                    text = kept_parts(text.as_py().encode(), cover.as_py())[0].decode("utf-8", "ignore")
                    texts.append(text)
                else:
                    texts.append(text.as_py())
            rows = batch.column(0)
            columns = [pa.array(texts, pa.string()) if f == "text" else rows.field(i) for i, f in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spans.mapInArrow(cut, fields)
