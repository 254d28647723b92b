"""Packing, sharding, BPE codec and quality classifier against direct computations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rankfold.llm import bpe, bpe_codec, packing, quality, sharding

PATH = bpe.default_vocabulary()


def library_ids(text):
    return bpe.library_encoder(PATH).encode(text or "", add_special_tokens=False).ids


def test_fast_encoder_gives_the_library_ids():
    rng = random.Random(1)
    alphabet = [chr(c) for c in (*range(1, 0x250), *range(0x3B1, 0x3C9), *range(0x4E00, 0x4E40), 0x1F600, 0x200B, 0x85, 0xA0, 0x2028, 0x3000,
                                 0x661, 0x2160, 0x301, 0xE000)] + [" "] * 200 + ["'s", "'LL", "<|endoftext|>", "  ", "\n\n", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = library_ids(text)
        assert bpe.fast_encoder(PATH).encode(text, allowed_special="all") == ids, repr(text)
        encoder = bpe.library_encoder(PATH)
        parts = [i for w in bpe.split_words(text, PATH) for i in encoder.encode(w, add_special_tokens=False).ids]
        assert parts == ids, repr(text)
        assert b"".join(bpe.piece_list(PATH)[i] for i in ids).decode("utf-8", "replace") == encoder.decode(ids, skip_special_tokens=False)


def check_sequences(got, capacity):
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, rows, capacity):
    got = packing.pack_documents(docs, capacity, keep_ids=True).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = [*library_ids(text), 0]
        first = len(ids) % capacity or min(capacity, len(ids))
        at, piece = 0, 0
        while at < len(ids):
            size = first if piece == 0 else capacity
            part = ids[at: at + size]
            want[doc_id, piece, at, size, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
            at, piece = at + size, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    n = check_sequences(got, capacity)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // capacity) + 1


def test_plan_is_valid_small_and_replaces_the_smallest():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 20, 100])
        hist = {rng.randint(1, capacity): rng.choice([1, 2, 5, 1000, 10 ** 7]) for _ in range(rng.randint(1, 25))}
        plan = packing.plan_bins(hist, capacity)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= capacity and times >= 1
            for length in lengths:
                used[length] += times
        assert used == Counter(hist) and len(plan) <= 20 * capacity
    # Greedily 6 + 3 leaves a gap of 1; two pieces of 2 replace the 3.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    assert packing.tighter_pair(np.array([0, 0, 1, 0]), 2, 4) is None


def test_packing_empty_and_odd_lengths(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    odd = spark.createDataFrame([(1, 5, 9), (2, None, 9), (3, 0, 9), (4, 11, 9), (5, 5, 9)], "id int, length long, offset int")
    got = {r["id"]: (r["sequence_id"], r["offset"]) for r in packing.pack(odd, 10).collect()}
    assert got[2] == got[3] == got[4] == (None, None) and {got[1][1], got[5][1]} == {0, 5}


def test_sharding(docs, rows, no_docs):
    got = sharding.shard_documents(docs, 5, bucket_bytes=4000).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["size_in"] for r in got} == {3}
    assert sharding.shard_documents(no_docs).count() == 0


def test_sharding_order_is_shuffled_and_seeded(spark):
    flat = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text")
    first, again, other = ([(r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_documents(flat, 3, seed).sort("doc_id").collect()]
                           for seed in (1, 1, 2))
    assert first == again != other
    order = [d for _, _, d in sorted(first, key=lambda x: (x[1], x[0]))]
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) / 400 > 80


def test_bpe_round_trip(docs, rows, no_docs):
    got = bpe_codec.encode_and_decode(docs, keep_ids=True, chunk_bytes=5000, bucket_bytes=2000).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = library_ids(text)
        back = bpe.library_encoder(PATH).decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
             tuple(ids), text or ""] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe_codec.encode_and_decode(no_docs).count() == 0


def test_quality_learns_and_keeps_out_the_held_out(spark):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(200)], [f"junk{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice((bad, good)[i % 2]) for _ in range(30))) for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, "good1 good2"), (2000, ""), (2001, None), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(900)] + [(None, 1, 0), (5000, 1, 1), (1, 7, 0), (2, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in held if r["doc_id"] < 900]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    again = quality.score_quality(docs, flipped).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_quality_edges(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(no_docs, none).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(100, 140)], "doc_id long, quality int")
    assert quality.score_quality(docs, one).count() == len(rows)


def test_sparse_dot_product_equals_features(docs):
    data = "a b a\tb c".encode()
    slots, ends = quality.features(np.frombuffer(data + b"zz", np.uint8), np.array([0, len(data), len(data) + 2]), 20, 2)
    n_shape = ends[1] - ends[0] - 1
    assert ends[0] - n_shape == 3 + 3  # a b c; a b, b a, b c


BLANKS = [" ", "\t", "\n", "\u00a0"]


def test_long_runs_of_blanks(spark):
    """A million blanks at the front, in the middle and at the end get the library's ids."""
    n, ends = 1_200_000, bpe.library_encoder(PATH)
    texts = [" " * n + "front word", "some words" + "\n" * n + "middle", "end" + "\t " * (n // 2), "\u00a0" * n, "short  text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {}
    for r in packing.token_pieces(df, keep_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, text in enumerate(texts):
        ids = [x for _, part in sorted(got[i]) for x in part]
        assert ids == [*ends.encode(text, add_special_tokens=False).ids, 0]


def test_words_come_back_in_another_order(spark, docs):
    """Words and texts must be of the same chunks; others are refused."""
    sent = bpe_codec.word_chunks(docs, PATH, 4, 1 << 20)
    other = bpe_codec.word_chunks(docs.where("doc_id > 300").repartition(1), PATH, 4, 1 << 20)
    with pytest.raises(Exception, match="another order"):
        bpe_codec.assemble(other, bpe_codec.encode_words(sent, PATH), PATH, False).collect()
