"""BPE encoding and decoding of whole texts through a distinct-word table.

Merges never cross the words that the tokenizer's own pattern cuts, so each distinct word is
encoded once and its ids are joined back by position:

1. Every task cuts its texts into words, numbers the distinct words of each chunk of texts and
   sends, per chunk, the word numbers of every text by position, and per chunk and word
   bucket the chunk's distinct words. Both are compressed; a word that every text holds is
   one entry of the chunk. These rows are shuffled by chunk once, and both passes below read that shuffle.
2. Per word bucket (a hash of the word) the distinct words of all chunks are encoded once by
   the tokenizers library; each chunk gets the ids of its words in the order it sent them.
3. Per chunk the ids are joined to the word numbers by position, which gives the ids of every
   text. Decoding joins every id to its piece (a table of vocabulary size) and puts the bytes
   together.

A chunk holds at most ``chunk_bytes`` of text and ``CHUNK_ROWS`` texts, or one longer text; a word bucket follows the
number of distinct words, so memory is bounded for either. A chunk's name holds a digest of its words, so rows
of a table that come in another order when a lost task runs again are refused; tables read from files keep theirs.

Defined cases: null and empty texts have no ids; null ids and repeated rows give a row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from rankfold.llm import bpe
from rankfold.llm.common import CHUNK_ROWS, buckets_for, chunk_name, extended, total_bytes


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes (low bytes first)."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def word_chunks(docs: DataFrame, path: str, word_buckets: int, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: a chunk's texts as word numbers (bucket null), and its words by bucket."""
    ids = docs.select("doc_id").schema
    out = extended(ids, "chunk string, bucket int, counts binary, body binary")
    kind = to_arrow_type(ids[0].dataType)

    def emit(number, doc_ids, texts):
        numbers, rows = {}, []
        for text in texts:
            rows.append(np.array([numbers.setdefault(w, len(numbers)) for w in bpe.split_words(text, path)], np.uint32))
        counts = np.array([len(r) for r in rows], np.uint32)
        flat = np.concatenate(rows)
        # Renumber by frequency: most numbers are small and compress well.
        by_use = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(numbers), np.uint32)
        rank[by_use] = np.arange(len(numbers))
        named = [w.encode() for w in numbers]
        chunk = f"{chunk_name(number)}-{hashlib.blake2b(b' '.join(named), digest_size=8).hexdigest()}"
        yield text_rows(chunk, doc_ids, counts, rank[flat])
        by_bucket: dict[int, list[tuple[bytes, int]]] = {}
        for n, at in enumerate(by_use.tolist()):
            by_bucket.setdefault(zlib.crc32(named[at]) % word_buckets, []).append((named[at], n))
        yield word_rows(chunk, by_bucket)

    def cut(batches):
        held_ids, held, size, number = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if held and (size + len(text) > chunk_bytes or len(held) >= CHUNK_ROWS):
                    yield from emit(number, held_ids, held)
                    held_ids, held, size, number = [], [], 0, number + 1
                held_ids.append(doc_id.as_py())
                held.append(text)
                size += len(text)
        if held:
            yield from emit(number, held_ids, held)

    def text_rows(chunk, doc_ids, counts, flat):
        n = len(doc_ids)
        ends = np.cumsum(counts, dtype=np.int64)
        # The first text's row carries the chunk's body, every row its place and where its words end.
        body = [pack_numbers(flat), *[None] * (n - 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, kind), pa.array([chunk] * n), pa.array([None] * n, pa.int32()),
             pa.array([np.array([i, e], "<i8").tobytes() for i, e in enumerate(ends)], pa.binary()),
             pa.array(body, pa.binary())], names=out.names)

    def word_rows(chunk, by_bucket):
        buckets = sorted(by_bucket)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(buckets), kind), pa.array([chunk] * len(buckets)), pa.array(buckets, pa.int32()),
             pa.array([pack_numbers(np.diff([i for _, i in by_bucket[b]], prepend=0)) for b in buckets], pa.binary()),
             pa.array([pack_words([w for w, _ in by_bucket[b]]) for b in buckets], pa.binary())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(cut, out)


def encode_words(sent: DataFrame, path: str) -> DataFrame:
    """Encode each distinct word of a bucket once; answer every chunk in the order it asked."""
    out = sent.schema

    def words_only(batches):  # a filter of Spark's own would move below the shuffle, which then would be made twice
        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column("bucket")))

    def encode(table: pa.Table) -> pa.Table:
        encoder, known, bodies = bpe.library_encoder(path), {}, []
        asked = [unpack_words(b.as_py()) for b in table.column("body")]
        fresh = list({w for words in asked for w in words})
        for at in range(0, len(fresh), 4096):
            part = fresh[at: at + 4096]
            for word, enc in zip(part, encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                known[word] = np.array(enc.ids, "<u4").tobytes()
        for words in asked:
            ids = [known[w] for w in words]
            sizes = np.array([len(i) // 4 for i in ids], np.uint32)
            bodies.append(np.uint32(len(ids)).tobytes() + pack_numbers(np.concatenate([sizes, np.frombuffer(b"".join(ids), "<u4")])))
        return table.set_column(out.names.index("body"), "body", pa.array(bodies, pa.binary()))

    return sent.mapInArrow(words_only, out).groupBy("bucket").applyInArrow(encode, out)


def assemble(sent: DataFrame, answers: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    """Join the words' ids to the texts by position, and the ids to their pieces."""
    out = extended(sent.select("doc_id").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string"
                   + (", ids array<int>, decoded string" if keep_ids else ""))

    def join(rows: pa.Table, answers: pa.Table) -> pa.Table:
        piece = bpe.piece_list(path)
        texts = rows.filter(pc.is_null(rows.column("bucket")))
        if not len(texts):
            raise ValueError("the documents came in another order when read again")
        places = np.frombuffer(b"".join(b.as_py() for b in texts.column("counts")), "<i8").reshape(-1, 2)
        order = np.argsort(places[:, 0])
        body = next(b.as_py() for b in texts.column("body") if b.is_valid)
        numbers = unpack_numbers(body)
        total = 0
        parts = []
        for counts, blob in zip(answers.column("counts"), answers.column("body")):
            which, blob = np.cumsum(unpack_numbers(counts.as_py()), dtype=np.int64), blob.as_py()
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            flat = unpack_numbers(blob[4:])
            parts.append((which, flat[:n].astype(np.int64), flat[n:]))
            total = max(total, int(which.max()) + 1) if n else total
        if int(numbers.max(initial=0)) >= max(total, 1):
            raise ValueError("the documents came in another order when read again")
        starts, sizes, at, pool = np.zeros(total, np.int64), np.zeros(total, np.int64), 0, []
        for which, size, flat in parts:
            sizes[which] = size
            starts[which] = at + np.cumsum(size) - size
            at += len(flat)
            pool.append(flat)
        pool = np.concatenate(pool) if pool else np.empty(0, np.uint32)
        n_tokens, shas, decoded, kept, told = [], [], [], [], []
        before = 0
        for end in places[order, 1].tolist():
            words, before = numbers[before:end], end
            size = sizes[words]
            stop = np.cumsum(size)
            ids = pool[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts[words] - stop + size, size)]
            n_tokens.append(len(ids))
            shas.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text = b"".join([piece[i] for i in ids.tolist()]).decode("utf-8", "replace")
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
            if keep_ids:
                kept.append(ids.astype(np.int32))
                told.append(text)
        cols = [texts.column("doc_id").take(pa.array(order)), pa.array(n_tokens, pa.int64()), pa.array(shas, pa.string()),
                pa.array(decoded, pa.string())]
        if keep_ids:
            cols += [pa.array(kept, pa.list_(pa.int32())), pa.array(told, pa.string())]
        return pa.table(cols, names=out.names)

    return sent.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, out)


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False, chunk_bytes: int = 48 << 20,
                      bucket_bytes: int = 32 << 20) -> DataFrame:
    """Every text's token count and the digests of its ids and of its decoded text (with ``keep_ids`` both themselves)."""
    path = vocabulary or bpe.default_vocabulary()
    word_buckets = buckets_for(total_bytes(docs, "text"), bucket_bytes, docs.sparkSession)
    sent = word_chunks(docs, path, word_buckets, chunk_bytes).repartition("chunk")
    return assemble(sent, encode_words(sent, path), path, keep_ids)
