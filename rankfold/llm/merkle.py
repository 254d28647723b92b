"""Document fingerprints: Merkle trees over the pieces, paragraphs and sections of whole texts.

A line is a paragraph. Paragraphs are cut into pieces of some words, and gathered into sections, at places that
depend only on the bytes nearby, so that an edit changes the nodes around it and no others. A piece's digest is that of
its bytes, a node's digest that of its children's digests, and the root is the text's fingerprint:

* equal roots mean equal texts;
* where roots differ, only differing branches are followed, which leads to the edited pieces (``locate_edits``);
* the likeness of two texts is the share of bytes in pieces that both trees hold, ``2 * common / (a + b)``.

``compare_with_next`` deals the texts by ranges of their ids, sorts within the ranges and streams
through neighbours; only the first and last text of each range meet in a second, small join. Rows that repeat an id
are spread over ranges by text and place, so no range outgrows its share.

Defined cases: null texts count as empty; an empty text has a root of its own and is like another empty text (1)
and unlike any other (0); null ids come last; rows that repeat an id follow each other by the hash of
their texts; the only row of a table is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm.common import buckets_for, extended, give_back, stage, total_bytes

LONGEST = 256  # bytes of a piece
BLOCK = 1 << 20  # bytes of text cut at once
COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NODES = "level string, number int, start long, length long, digest string"
INSIDE, HEAD, TAIL = 0, 1, 2


def digest(data: bytes, level: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


@dataclass
class Tree:
    """Nodes of one text from left to right: digests, ends in bytes, and for the upper levels how many children they have."""

    root: str
    pieces: list[bytes]
    ends: list[int]
    paragraphs: list[bytes]
    paragraph_sizes: list[int]
    sections: list[bytes]
    section_sizes: list[int]

    @property
    def size(self) -> int:
        return self.ends[-1] if self.ends else 0

    def lengths(self) -> dict[bytes, int]:
        """Piece digest -> bytes of that piece."""
        return {d: e - s for d, s, e in zip(self.pieces, [0, *self.ends], self.ends)}


def piece_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the pieces of all texts that ``data`` holds one after another."""
    if not len(data):
        return np.empty(0, np.int64)
    word = np.zeros(len(data), np.uint32)
    for back in range(4):
        word[back:] |= data[: len(data) - back].astype(np.uint32) << np.uint32(8 * back)
    mix = (word ^ word >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    mix = (mix ^ mix >> np.uint32(12)) >> np.uint32(16)
    # After every third space, or after every 64th other byte, by the four bytes up to there.
    cut = mix < np.where(data == 32, 65536 // 3, 65536 // 64).astype(np.uint32)
    for near in range(3):
        at = offsets[:-1] + near
        cut[at[at < len(data)]] = False
    cut |= data == 10
    cut[offsets[1:][np.diff(offsets) > 0] - 1] = True
    # A cut never parts the bytes of one character.
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        more = (sizes - 1) // LONGEST
        long = np.flatnonzero(more)
        first = np.repeat(ends[long] - sizes[long], more[long])
        step = np.arange(int(more[long].sum())) - np.repeat(np.cumsum(more[long]) - more[long], more[long]) + 1
        extra = first + LONGEST * step
        for _ in range(3):
            extra = extra - ((data[extra] & 0xC0) == 0x80)
        ends = np.union1d(ends, extra)
    return ends


def trees(texts: list[bytes]) -> list[Tree]:
    """The trees of several texts."""
    out, at = [], 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= BLOCK:
            size += len(texts[upto])
            upto += 1
        raw = b"".join(texts[at:upto])
        data = np.frombuffer(raw, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:upto]])]).astype(np.int64)
        ends = piece_ends(data, offsets)
        closes = (data[ends - 1] == 10).tolist() if len(ends) else []
        cuts = np.searchsorted(ends, offsets, "right").tolist()
        ends, begins = ends.tolist(), offsets.tolist()
        for t in range(upto - at):
            a, b = cuts[t], cuts[t + 1]
            out.append(tree(raw, begins[t], ends[a:b], closes[a:b]))
        at = upto
    return out


def tree(raw: bytes, begin: int, ends: list[int], closes: list[bool]) -> Tree:
    blake = hashlib.blake2b
    pieces = [blake(raw[s:e], digest_size=16).digest() for s, e in zip([begin, *ends], ends)]
    paragraphs, paragraph_sizes, first = [], [], 0
    for i, close in enumerate(closes, 1):
        if close or i == len(closes):
            paragraphs.append(digest(b"".join(pieces[first:i]), b"paragraph"))
            paragraph_sizes.append(i - first)
            first = i
    sections, section_sizes, first = [], [], 0
    blank = digest(blake(b"\n", digest_size=16).digest(), b"paragraph")
    for i, name in enumerate(paragraphs, 1):
        # A blank line closes a section, and so does an eighth of all paragraphs, by their digests.
        if name == blank or not name[0] & 7 or i == len(paragraphs):
            sections.append(digest(b"".join(paragraphs[first:i]), b"section"))
            section_sizes.append(i - first)
            first = i
    root = blake(b"".join(sections), digest_size=32, person=b"root").hexdigest()
    return Tree(root, pieces, [e - begin for e in ends], paragraphs, paragraph_sizes, sections, section_sizes)


def likeness(a: Tree, b: Tree) -> float:
    """Share of bytes in pieces that both trees hold: 1 for equal texts, 0 for texts without a common piece."""
    if a.root == b.root:
        return 1.0
    common = set(a.pieces).intersection(b.pieces)
    if not common:
        return 0.0
    lengths = a.lengths()
    in_a, in_b = Counter(a.pieces), Counter(b.pieces)
    return 2.0 * sum(lengths[d] * min(in_a[d], in_b[d]) for d in common) / (a.size + b.size)


def edits(a: Tree, b: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans of either text that lie in no branch of the other: equal sections are skipped whole, then equal
    paragraphs of the rest, then equal pieces; neighbouring spans are joined. A branch that only moved is in neither."""
    if a.root == b.root:
        return [], []
    level = [list(enumerate(t.sections)) for t in (a, b)]
    for sizes, names in (("section_sizes", "paragraphs"), ("paragraph_sizes", "pieces"), (None, None)):
        differing = [unmatched(level[k], [d for _, d in level[1 - k]]) for k in (0, 1)]
        if sizes is None:
            return tuple(joined([(t.ends[i - 1] if i else 0, t.ends[i]) for i in numbers]) for numbers, t in zip(differing, (a, b)))
        level = [children(t, numbers, sizes, names) for numbers, t in zip(differing, (a, b))]


def children(t: Tree, numbers: list[int], sizes: str, names: str) -> list[tuple[int, bytes]]:
    """(number, digest) of the children of the given nodes."""
    size, below = getattr(t, sizes), getattr(t, names)
    ends = np.cumsum(size).tolist()
    return [(c, below[c]) for i in numbers for c in range(ends[i] - size[i], ends[i])]


def unmatched(mine: list[tuple[int, bytes]], other: list[bytes]) -> list[int]:
    """Numbers of the nodes that find no partner of the same digest, each partner used once."""
    free, out = Counter(other), []
    for i, d in mine:
        if free[d] > 0:
            free[d] -= 1
        else:
            out.append(i)
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def nodes(docs: DataFrame) -> DataFrame:
    """The trees as a table: (doc_id, level, number, start, length, digest), starts and lengths in UTF-8 bytes."""
    out = extended(docs.select("doc_id").schema, NODES)

    def rows(batches):
        for batch in batches:
            made = trees([(t.as_py() or "").encode() for t in batch.column(1)])
            for i, t in enumerate(made):
                ends = {"piece": t.ends}
                ends["paragraph"] = [t.ends[i - 1] for i in np.cumsum(t.paragraph_sizes).tolist()]
                ends["section"] = [ends["paragraph"][i - 1] for i in np.cumsum(t.section_sizes).tolist()]
                cols = [[], [], [], [], []]
                for level, names in (("root", [t.root]), ("section", t.sections), ("paragraph", t.paragraphs), ("piece", t.pieces)):
                    upto = ends.get(level, [t.size])
                    starts = [0, *upto[:-1]]
                    cols[0] += [level] * len(names)
                    cols[1] += range(len(names))
                    cols[2] += starts[: len(names)]
                    cols[3] += [e - s for s, e in zip(starts, upto)]
                    cols[4] += [d if isinstance(d, str) else d.hex() for d in names]
                ids = batch.column(0).take(pa.array([i] * len(cols[0])))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(rows, out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, text) of every row."""
    out = extended(docs.select("doc_id").schema, "fingerprint string, text string")

    def rows(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.root for t in trees([x.encode() for x in texts])], pa.string()),
                                              pa.array(texts, pa.string())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(rows, out)


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, removed, added) of the ids that both tables hold with different fingerprints: byte spans of the text
    before and of the text after. Of rows that repeat an id the one with the smallest fingerprint counts."""
    one = lambda d, name: fingerprints(d.where(F.col("doc_id").isNotNull())).groupBy("doc_id").agg(
        F.min(F.struct("fingerprint", "text")).alias(name))
    pairs = one(before, "x").join(one(after, "y"), "doc_id").where("x.fingerprint <> y.fingerprint")
    spans = "array<struct<start:long,end:long>>"
    out = extended(before.select("doc_id").schema, f"removed {spans}, added {spans}")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches):
        for batch in batches:
            a, b = (trees([t.as_py().encode() for t in batch.column(c)]) for c in (1, 2))
            both = [edits(x, y) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([[{"start": s, "end": e} for s, e in pair[k]] for pair in both], kind) for k in (0, 1)]],
                names=out.names)

    return pairs.select("doc_id", "x.text", F.col("y.text").alias("text_after")).mapInArrow(rows, out)


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: pa.Array, texts: list[str], mine: list[Tree], following: list[str], others: list[Tree], names: list[str]) -> pa.RecordBatch:
    """Result rows of texts whose next texts are ``following``."""
    changed = [half_replaced(a, b).encode() for a, b in zip(texts, following)]
    edited = trees(changed)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
         pa.array([t.root for t in mine], pa.string()), pa.array([t.root for t in edited], pa.string()),
         pa.array([likeness(a, b) for a, b in zip(mine, edited)], pa.float64()),
         pa.array([likeness(a, b) for a, b in zip(mine, others)], pa.float64())], names=names)


def compare_with_next(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited form (its last half replaced by the next text's begin), and the likeness of
    its tree to that form's and to the next text's."""
    spark = docs.sparkSession
    keys = [F.col("doc_id").asc_nulls_last(), F.col("__text"), F.col("__place")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("__place"))
    ranges = buckets_for(total_bytes(docs, "text"), range_bytes, spark)
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    result = extended(docs.select("doc_id").schema, COLUMNS)
    both = extended(result, "edge int, part int, text string")

    def edge(kind, part, doc_id, text):
        blank = [pa.nulls(1, f) for f in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([doc_id, *blank, pa.array([kind], pa.int32()), pa.array([part], pa.int32()),
                                           pa.array([text], pa.string())], names=both.names)

    def stream(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            texts = [t.as_py() or "" for t in batch.column(1)]
            made = trees([t.encode() for t in texts])
            ids = batch.column(0)
            if held is None:
                yield edge(HEAD, part, ids.slice(0, 1), texts[0])
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, made = [held[1], *texts], [held[2], *made]
            n = len(texts) - 1
            if n:
                done = compared(ids.slice(0, n), texts[:n], made[:n], texts[1:], made[1:], result.names)
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array([INSIDE] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
                                                 names=both.names)
            held = (ids.slice(n, 1), texts[n], made[n])
            del texts, made, batch
            give_back()
        if held is not None:
            yield edge(TAIL, part, held[0], held[1])

    done = stage(ordered.mapInArrow(stream, both), "neighbours", "edge")
    heads = done.where(F.col("edge") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    # One number per range; the last range is followed by the first.
    order = Window.orderBy("next")
    parts = heads.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(order), F.first("next").over(order)).alias("next"))
    tails = done.where(F.col("edge") == TAIL).select("doc_id", "part", "text").join(parts, "part").join(heads, "next")

    def close(batches):
        for batch in batches:
            texts, following = ([t.as_py() for t in batch.column(c)] for c in (1, 2))
            yield compared(batch.column(0), texts, trees([t.encode() for t in texts]), following,
                           trees([t.encode() for t in following]), result.names)

    rest = tails.select("doc_id", "text", "following").mapInArrow(close, result)
    return done.where(F.col("edge") == INSIDE).select(*result.names).unionByName(rest)
