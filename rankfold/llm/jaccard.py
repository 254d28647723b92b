"""N-gram Jaccard join: all links between texts whose shingle sets are similar enough, exactly.

A document's set holds its distinct shingles of five words; texts with equal sets are one
class, named by the digest of the set; standing for them is the smallest id, which may stand for several classes. Between classes the join is a rare-first prefix filter:

* Tokens are shingle hashes whose width follows the number of words (``TOKEN_SPARE`` bits more than needed to count
  them), ordered by document frequency, rarest first. Each task sorts the tokens of a chunk of texts and
  sends every bucket (a hash range) its part once, compressed. A bucket counts the frequencies
  and keeps only tokens of two or more classes: no other can be in an intersection. A token
  that many texts of one chunk share goes to the bucket as one count; its texts are listed apart, by chunk.
* Back at the chunk, a class with ``shared`` tokens out of ``n`` keeps its
  ``shared - ceil(t n) + 1`` rarest ones: a partner must hold one of them, and most classes keep none.
* Classes that share a prefix token are candidates after the length filter, the positional
  filter (tokens left behind the first shared one) and the suffix filter (a bound on the
  symmetric difference from parity bitmaps of the sets). Each pair is verified once, on the
  shared tokens of both classes.

What is asked for are components, so not every pair of a large group has to be looked at:
first each class is compared with the smallest class of each of its prefix tokens. Only tokens whose classes are
not all in one component after that give all their remaining candidates, without which links could be missed.

Defined cases: null and empty texts and texts without words have no shingles and are linked
with nothing; fewer than five words are one shingle, the whole sequence; rows without an id get
a null component and link nothing; rows that repeat an id are all of that document; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import CHUNK_ROWS, GOLDEN, U64, buckets_for, chunk_name, give_back, mixed, stage, total_bytes, utf8, words
from rankfold.llm.components import connected_components
from rankfold.llm.quality import blocks

SHINGLE = 5
PERCENT = 75
TOKEN_SPARE = 20
HOT = 64  # texts of a chunk that share a token, above which they are listed apart
BITMAP_LONGS = 8
SALTS = 16
DOC, SHARED, LISTED, COUNT = 0, 1, 2, 3
CHUNK_FIELDS = "bucket int, kind int, chunk string, at int, doc_id long, n int, digest binary, body binary"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: of up to seven bytes the bytes and their number, reversibly mixed; of longer words a cryptographic digest,
    so that no two words of a text are made to meet."""
    n = ends - starts
    value = np.minimum(n, 8).astype(np.uint64) << U64(56)
    for i in range(7):
        has = n > i
        value[has] |= data[starts[has] + i].astype(np.uint64) << U64(8 * i)
    value = mixed(value)
    long = np.flatnonzero(n > 7)
    raw, known, digests = data.tobytes(), {}, []
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        w = raw[s:e]
        d = known.get(w)
        if d is None:
            d = known[w] = hashlib.blake2b(w, digest_size=8).digest()
        digests.append(d)
    value[long] = np.frombuffer(b"".join(digests), "<u8")
    return value


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text (one after the other) and their counts."""
    n = len(offsets) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, before = words(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    word = word_hashes(data, starts, ends)
    per_text = np.diff(before)
    text = np.repeat(np.arange(n), per_text)
    full = len(word) - size + 1
    owner, value = [], []
    if full > 0:
        inside = text[:full] == text[size - 1:]
        total = np.zeros(full, np.uint64)
        for j in range(size):
            total = mixed(total * U64(GOLDEN) + word[j: j + full])
        owner.append(text[:full][inside])
        value.append(total[inside])
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = per_text[short] > j
            total[has] = mixed(total[has] * U64(GOLDEN) + word[before[short[has]] + j])
        owner.append(short)
        value.append(mixed(total + per_text[short].astype(np.uint64)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    turn = np.lexsort((value, owner))
    owner, value = owner[turn], value[turn]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=n)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as compressed byte planes; the first one, ascending, as differences."""
    first = np.diff(columns[0].astype(np.uint64), prepend=U64(0))
    parts = [np.uint64(len(first)).tobytes(), np.ascontiguousarray(first.view(np.uint8).reshape(-1, 8).T).tobytes()]
    for c in columns[1:]:
        parts.append(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    first = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
    out = [np.cumsum(np.ascontiguousarray(first.T).view(np.uint64).ravel(), dtype=np.uint64)]
    for at in range(8 + 8 * n, len(raw), 4 * n or 1):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel())
    return out


def table_of(**columns) -> pa.Table:
    """Rows in the layout of CHUNK_FIELDS; columns not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.string(), "at": pa.int32(), "doc_id": pa.int64(), "n": pa.int32(),
             "digest": pa.binary(), "body": pa.binary()}
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()})


def chunk_tokens(docs: DataFrame, bits: int, buckets: int, chunk_bytes: int, size: int) -> DataFrame:
    """Per chunk of texts: a row per document, its tokens by bucket, and the texts of its frequent tokens."""
    def close(number, ids, sets):
        chunk, digests = chunk_name(number), [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        aside = buckets + zlib.crc32(chunk.encode()) % buckets  # rows that no bucket needs, spread over tasks
        n = len(ids)
        yield table_of(bucket=[aside] * n, kind=[DOC] * n, chunk=[chunk] * n, at=list(range(n)), doc_id=ids,
                       n=[len(s) for s in sets], digest=digests)
        first: dict[bytes, int] = {}
        for i in np.argsort([x if x is not None else 0 for x in ids], kind="stable").tolist():
            if digests[i] is not None and ids[i] is not None:
                first.setdefault(digests[i], i)
        stand = sorted(first.values())
        if not stand:
            return
        owner = np.repeat(np.array(stand), [len(sets[i]) for i in stand])
        value = np.concatenate([sets[i] for i in stand]) >> U64(64 - bits)
        turn = np.argsort(value, kind="stable")
        value, owner = value[turn], owner[turn]
        begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        count = np.diff(np.append(begins, len(value)))
        hot = np.repeat(count > HOT, count)
        if hot.any():
            yield table_of(bucket=[aside], kind=[LISTED], chunk=[chunk], body=[squeeze(value[hot], owner[hot])])
        # A frequent token is one entry with its count and no text.
        keep = ~hot
        keep[begins] = True
        weight = np.ones(len(value), np.int64)
        weight[begins] = np.where(count > HOT, count, 1)
        owner = np.where(hot, 0, owner + 1)[keep]
        value, weight = value[keep], weight[keep]
        place = (value >> U64(max(bits - 32, 0))).astype(np.int64) * buckets >> min(bits, 32)
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        yield table_of(bucket=used.tolist(), kind=[SHARED] * len(used), chunk=[chunk] * len(used),
                       body=[squeeze(value[a:b], owner[a:b], weight[a:b]) for a, b in zip(cuts[used], cuts[used + 1])])

    def cut(batches):
        ids, sets, held, number = [], [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                values, counts = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], size)
                sets += np.split(values, np.cumsum(counts)[:-1])
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += int(offsets[b] - offsets[a])
                if held >= chunk_bytes or len(ids) >= CHUNK_ROWS:
                    for t in close(number, ids, sets):
                        yield from t.to_batches()
                    give_back()
                    ids, sets, held, number = [], [], 0, number + 1
        if ids:
            for t in close(number, ids, sets):
                yield from t.to_batches()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, CHUNK_FIELDS)


def shared_tokens(table: pa.Table) -> pa.Table:
    """A bucket's tokens of two or more classes, by chunk with their frequencies; frequent tokens' counts apart."""
    kinds = table.column("kind").to_numpy()
    if kinds[0] != SHARED:
        return table  # rows set aside pass through
    chunks = table.column("chunk").to_pylist()
    parts = [unsqueeze(b.as_py()) for b in table.column("body")]
    value = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] for p in parts])
    weight = np.concatenate([p[2] for p in parts]).astype(np.int64)
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    turn = np.argsort(value, kind="stable")
    value, owner, weight, source = value[turn], owner[turn], weight[turn], source[turn]
    begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    total = np.add.reduceat(weight, begins)
    df = np.repeat(total, np.diff(np.append(begins, len(value))))
    out = []
    frequent = np.flatnonzero(owner == 0)
    if len(frequent):
        which = frequent[np.unique(value[frequent], return_index=True)[1]]
        out.append(table_of(kind=[COUNT], body=[squeeze(value[which], np.minimum(df[which], 0xFFFFFFFF))]))
    keep = np.flatnonzero((df > 1) & (owner > 0))
    keep = keep[np.argsort(source[keep], kind="stable")]
    ends = np.searchsorted(source[keep], np.arange(len(parts) + 1))
    for i in range(len(parts)):
        mine = keep[ends[i]: ends[i + 1]]
        if len(mine):
            out.append(table_of(kind=[SHARED], chunk=[chunks[i]],
                                body=[squeeze(value[mine], owner[mine] - 1, np.minimum(df[mine], 0xFFFFFFFF))]))
    del parts, value, owner, weight, source, df
    give_back()
    return pa.concat_tables(out) if out else table_of(kind=[]).slice(0, 0)


def bitmap(tokens: np.ndarray) -> list[int]:
    """Parity bits of the tokens: each flips one of ``64 * BITMAP_LONGS`` bits."""
    bits = np.bincount((mixed(tokens) % U64(64 * BITMAP_LONGS)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def prefixes(table: pa.Table, percent: int) -> pa.Table:
    """Of a chunk's classes: the rare-first prefix tokens, and the shared tokens for verification."""
    kinds = table.column("kind").to_numpy()
    docs = table.filter(pa.array(kinds == DOC))
    at, ids, n = (docs.column(c).to_numpy(zero_copy_only=False) for c in ("at", "doc_id", "n"))
    keys = docs.column("digest").combine_chunks()
    of = lambda kind: [unsqueeze(b.as_py()) for b in table.filter(pa.array(kinds == kind)).column("body")]
    parts, told = of(SHARED), of(COUNT)
    for token, owner in of(LISTED):
        parts.append([token, owner, told[0][1][np.searchsorted(told[0][0], token)]])
    if not len(at) or not parts:
        return prefix_rows(keys[:0], ids[:0], n[:0], np.empty(0, np.uint64), n[:0])
    value, owner, df = (np.concatenate([p[i] for p in parts]).astype(t) for i, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
    del parts
    where = np.full(int(max(at.max(), owner.max())) + 1, -1)
    where[at] = np.arange(len(at))
    owner = where[owner]
    shared = np.bincount(owner[owner >= 0], minlength=len(at))
    keeps = np.maximum(shared - (percent * n + 99) // 100 + 1, 0)
    # Only classes that can have a partner are sorted.
    live = owner >= 0
    live[live] = keeps[owner[live]] > 0
    value, owner, df = value[live], owner[live], df[live]
    turn = np.lexsort((value, df, owner))
    value, owner = value[turn], owner[turn]
    shared = np.where(keeps > 0, shared, 0)
    begin = np.cumsum(shared) - shared
    order = np.arange(len(value)) - begin[owner]
    first = order < keeps[owner]
    mine = np.flatnonzero(keeps > 0)
    # Tokens of no other class come first in the order.
    alone = n[owner[first]] - shared[owner[first]]
    sets = [value[begin[i]: begin[i] + shared[i]] for i in mine.tolist()]
    return pa.concat_tables([
        prefix_rows(keys.take(pa.array(owner[first])), ids[owner[first]], n[owner[first]], value[first], alone + order[first] + 1),
        pa.table({"kind": pa.array(np.ones(len(mine), np.int32)), "key": keys.take(pa.array(mine)), "doc_id": pa.array(ids[mine], pa.int64()), "n": pa.array(n[mine], pa.int32()),
                  "token": pa.nulls(len(mine), pa.int64()), "place": pa.nulls(len(mine), pa.int32()),
                  "tokens": pa.array([np.sort(t).tobytes() for t in sets], pa.binary()),
                  "bits": pa.array([bitmap(t) for t in sets], pa.list_(pa.int64()))})])


def prefix_rows(keys: pa.Array, ids: np.ndarray, n: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> pa.Table:
    size = len(ids)
    return pa.table({"kind": pa.array(np.zeros(size, np.int32)), "key": keys, "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int32()),
                     "token": pa.array(tokens.view(np.int64)), "place": pa.array(places, pa.int32()),
                     "tokens": pa.nulls(size, pa.binary()), "bits": pa.nulls(size, pa.list_(pa.int64()))})


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids (a, b) of those of distinct candidate pairs of classes (a, b) that link: suffix filter, then one exact comparison."""
    def side(name, *columns):
        return sets.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    narrow = pairs.join(side("a", "doc_id", "n", "bits"), "a").join(side("b", "doc_id", "n", "bits"), "b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    # |A ^ B| is at least the bitmaps' distance and, for a link, at most n_a + n_b - 2 * overlap.
    room = narrow.where((F.col("n_a") + F.col("n_b")) * (100 - percent) >= apart * (100 + percent)).select("a", "b", "doc_id_a", "doc_id_b", "n_a", "n_b")
    both = room.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b") \
               .select("doc_id_a", "doc_id_b", "n_a", "n_b", "tokens_a", "tokens_b")

    def compare(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok[i] = 100 * common >= percent * (int(n_a[i]) + int(n_b[i]) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def can_link(percent: int):
    """Length and positional filter of the classes x and y at their places of a shared token."""
    n_a, n_b = F.col("x.n"), F.col("y.n")
    length = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    left = F.least(n_a - F.col("x.place"), n_b - F.col("y.place")) + 1
    return length & (left * (100 + percent) >= (n_a + n_b) * percent)


def across(rest: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of classes of different components; ``a`` has the smaller id.

    Classes of a token that agree in all that the filters look at are one group; only groups that fit are spelled out.
    """
    alike = ["token", "component", "n", "place"]
    groups = rest.select(*alike).distinct()
    fit = groups.alias("x").join(groups.alias("y"), "token").where((F.col("x.component") < F.col("y.component")) & can_link(percent))
    fit = fit.select("token", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in alike[1:]])
    for s in "xy":
        members = rest.select("token", *[F.col(c).alias(f"{c}_{s}") for c in (*alike[1:], "doc_id", "key")])
        fit = fit.join(members, ["token", *[f"{c}_{s}" for c in alike[1:]]])
    first = F.col("doc_id_x") < F.col("doc_id_y")
    return fit.select(F.when(first, F.col("key_x")).otherwise(F.col("key_y")).alias("a"),
                      F.when(first, F.col("key_y")).otherwise(F.col("key_x")).alias("b")).distinct()


def class_links(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges between ids whose components, joined over the texts of an id, are those of all links between classes."""
    columns = ["doc_id", "key", "n", "place"]
    centre = prefix.groupBy("token").agg(F.min(F.struct(*columns)).alias("y"), F.count("*").alias("c")).where("c > 1").select("token", "y.*")
    star = prefix.alias("x").join(centre.alias("y"), "token").where((F.col("x.doc_id") > F.col("y.doc_id")) & can_link(percent))
    tried = stage(star.select(F.col("y.key").alias("a"), F.col("x.key").alias("b")).distinct(), "tried")
    found = stage(verified(tried, sets, percent), "links")
    label = connected_components(found)
    named = prefix.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left") \
                  .withColumn("component", F.coalesce("component", "doc_id"))
    named = stage(named, "named")
    mixed_tokens = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rest = stage(named.join(mixed_tokens, "token", "left_semi"), "rest")
    again = across(rest, percent).join(tried, ["a", "b"], "left_anti")
    return stage(found.unionByName(verified(again, sets, percent)), "links")


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = 8 << 20,
                      bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    total = total_bytes(docs, "text")
    bits = min(64, TOKEN_SPARE + max(1, math.ceil(math.log2(total / 4 + 2))))
    buckets = buckets_for(total, bucket_bytes, spark)
    sent = chunk_tokens(docs, bits, buckets, chunk_bytes, size)
    held = stage(sent.groupBy("bucket").applyInArrow(shared_tokens, CHUNK_FIELDS), "tokens", "kind")

    rows = held.where(F.col("kind") == DOC).select("chunk", "at", "doc_id", "n", "digest")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = stage(classes, "classes")
    stands = rows.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).select("chunk", "at", "doc_id", "n", "digest")
    # A chunk that lists texts for frequent tokens gets those tokens' global counts, once each.
    counts = _counts(held.where(F.col("kind") == COUNT).select("body"))
    listing = _counts(held.where(F.col("kind") == LISTED).select("body", "chunk"))
    told = listing.select("chunk", "token").join(counts, "token").groupBy("chunk").applyInArrow(_told, CHUNK_FIELDS)
    shared = held.where(F.col("kind").isin(SHARED, LISTED)).select("kind", "chunk", "at", "doc_id", "n", "digest", "body")
    parts = shared.unionByName(told.select(shared.columns)).unionByName(
        stands.select(F.lit(DOC).alias("kind"), "chunk", "at", "doc_id", "n", "digest", F.lit(None).cast("binary").alias("body")))
    kept = stage(parts.groupBy("chunk").applyInArrow(
        lambda t: prefixes(t, percent), "kind int, key binary, doc_id long, n int, token long, place int, tokens binary, bits array<long>"),
        "prefixes", "kind")
    prefix = kept.where("kind = 0").select("key", "doc_id", "n", "token", "place").distinct()
    sets = kept.where("kind = 1").select("key", "doc_id", "n", "tokens", "bits").dropDuplicates(["key"])
    links = class_links(prefix, sets, percent)
    # An id with several texts joins their classes.
    named = rows.where("n > 0 and doc_id is not null").join(classes.where("rows > 1").select("digest", "rep"), "digest", "left")
    named = named.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    joined = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    own = named.join(joined.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = stage(connected_components(links.unionByName(own)), "components")
    whole = classes.where("rows > 1").join(label.withColumnRenamed("node", "rep"), "rep", "left") \
                   .select("digest", F.coalesce("component", "rep").alias("of_class"))
    salted = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk", "at"), F.lit(SALTS)).cast("int"))
    out = out.join(salted, ["digest", "salt"], "left").join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.least(F.coalesce("component", "of_class", "doc_id"), F.coalesce("of_class", "component", "doc_id")).alias("component_id"))


def _counts(blobs: DataFrame) -> DataFrame:
    """The distinct tokens of squeezed columns with their first number; a column chunk is kept."""
    named = "chunk" in blobs.columns

    def rows(batches):
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                token, df = unsqueeze(body.as_py())[:2]
                token, first = np.unique(token, return_index=True)
                arrays = [pa.array(token.view(np.int64)), pa.array(df[first].astype(np.int64))]
                if named:
                    arrays.append(pa.array([batch.column("chunk")[i].as_py()] * len(token), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "df", "chunk"][: 2 + named])

    return blobs.mapInArrow(rows, "token long, df long" + ", chunk string" * named)


def _told(table: pa.Table) -> pa.Table:
    """A chunk's frequent tokens and their counts as one row."""
    token, df = table.column("token").to_numpy().view(np.uint64), table.column("df").to_numpy()
    turn = np.argsort(token, kind="stable")
    return table_of(kind=[COUNT], chunk=[table.column("chunk")[0].as_py()], body=[squeeze(token[turn], np.minimum(df[turn], 0xFFFFFFFF))])
