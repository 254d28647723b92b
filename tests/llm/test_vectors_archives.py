"""Exact top-k, nearest neighbours and WARC transactions."""

import gzip
import hashlib

import numpy as np
import pytest

from rankfold.llm import ann, topk, warc
from rankfold.session import scratch_dir


def vector_rows(n, dim, seed=0, unit=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x).astype(np.float32).astype(float)
    x[n // 2: n // 2 + n // 3] = x[0]  # a third of all rows share one vector
    return [(i, x[i].tolist()) for i in range(n)]


ODD = [(None, [1.0] * 8), (90000, None), (90020, [float("nan")] * 8), (90040, [float("inf")] + [0.0] * 7), (90060, [1.0, None] + [0.0] * 6)]


def test_top_k(spark):
    rows = vector_rows(300, 8)
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>").repartition(3)
    v = topk.scaled(df, "vec_id", "embedding", 1024)
    got = topk.top_k(v.where("id % 30 = 0"), v, 7, query_block=4, candidate_block=50).collect()
    w = np.floor(1024 * np.array([r[1] for r in rows]))
    want = set()
    for q in range(0, 300, 30):
        s = [(-int(w[q] @ w[c]), c) for c in range(300) if c != q]
        want |= {(q, i + 1, c, -x) for i, (x, c) in enumerate(sorted(s)[:7])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_few_candidates_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (10, [0.0, -1e9])]
    v = topk.scaled(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 1024)
    got = sorted(tuple(r) for r in topk.top_k(v.where("id in (0, 10)"), v, 5).collect())
    one = 1024 * 2048
    assert got[:4] == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 2, one), (0, 4, 10, 0)]
    assert [r[:3] for r in got[4:]] == [(10, 1, 0), (10, 2, 0), (10, 3, 1), (10, 4, 2), (10, 5, 2)]
    empty = v.limit(0)
    assert topk.top_k(empty, v, 3).count() == 0 == topk.top_k(v, empty, 3).count()


def test_products_beyond_double_precision():
    q, c = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 1.0], [2.0 ** 40, 1.0]])
    assert topk.products(q, c).tolist() == [[2 ** 60 + 1, (1 << 63) - 1]]


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rows = vector_rows(3000, 8, 4, unit=True)
    df = spark.createDataFrame(rows + ODD + [(70000, [0.0] * 8), (70020, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(df, k=10, leaf_rows=64, sample_rows=1000).collect()
    x = np.array([r[1] for r in rows])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    hit = 0
    for q, top in found.items():
        top.sort()
        assert [t[0] for t in top] == list(range(1, 11)) and q not in [t[1] for t in top]
        assert all(abs(x[q] @ x[v] - s) < 1e-9 for _, v, s in top)
        assert [(-s, v) for _, v, s in top] == sorted((-s, v) for _, v, s in top)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(3000), -s))[:10].tolist()) & {t[1] for t in top})
    assert hit / (10 * len(found)) >= 0.9
    # All members of the shared vector find its smallest ids.
    assert [t[1] for t in found[1520]] == [0, *range(1500, 1509)]


def test_leaf_slices_and_query_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 8)))], "vec_id long, embedding array<double>")
    want = {tuple(r) for r in ann.search(df, k=5, trees=4, leaf_rows=300).collect()}
    monkeypatch.setattr(ann, "LEAF_SLICE", 37)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 11)
    assert {tuple(r) for r in ann.search(df, k=5, trees=4, leaf_rows=300).collect()} == want and len(want) == 75 * 5


def test_nearest_neighbours_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in ann.search(few).collect()} == {(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 0.0)}


PAGES = [(i, f"https://example.net/p/{i}", h) for i, h in enumerate(
    ["<p>one</p>", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "z" * 200])]
PAGES += [(3, "u", "y" * 100), (None, None, "y" * 100), (None, "ftp://n", "q" * 300), (None, "ftp://n", "q" * 300), (50, "bad\r\nurl", "t" * 120)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_round_trip(df, archive_bytes=700, compression=compression).collect()), key=str)
    want, first = [], {}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = raw in first and first[raw] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    assert got == sorted(want, key=str)


def test_read_back_payloads_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_dir(spark, "warc-test")
    warc.write_archives(df, path, 500, "gzip")
    records = warc.read_archives(spark, path, with_payload=True)
    bodies = [bytes(r["payload"]) for r in records.where("warc_type = 'response'").collect()]
    assert sorted(bodies) == sorted((h or "").encode() for i, _, h in PAGES if (i, h) not in ((4, "y" * 100), (6, "é" * 50), (None, "y" * 100)))
    rows = warc.assemble(records.drop("payload"))
    assert rows.count() == len(PAGES) and rows.where("n_requests <> 1 or n_metadata <> 1").count() == 0
    assert warc.unassembled(records.drop("payload")).count() == 0
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_assembly_follows_identifiers_both_ways(spark):
    schema = "warc_type string, record_id string, concurrent_to string"
    records = spark.createDataFrame([
        ("response", "r1", None), ("request", "q1", "r1"), ("metadata", "m1", "q1"), ("metadata", "m0", "r1"),
        ("revisit", "r2", "q2"), ("request", "q2", None), ("response", "r3", None), ("request", "q9", "gone"), ("request", "q8", None)], schema)
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"]["request"]["record_id"] == "q1" and got["r1"]["metadata"]["record_id"] == "m0" and got["r1"]["n_metadata"] == 2
    assert got["r2"]["request"]["record_id"] == "q2" and got["r3"]["request"] is None and got["r3"]["n_requests"] == 0
    assert sorted(r["record_id"] for r in warc.unassembled(records).collect()) == ["m1", "q8", "q9"]


def test_split_records_reads_gzip_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\na\r\n\r\nb\r\n\r" + b"\r\n\r\n"
    plain = [(f["WARC-Type"], bytes(b)) for f, b in warc.split_records(record * 3)]
    assert plain == [("response", b"a\r\n\r\nb\r\n\r")] * 3
    assert [(f["WARC-Type"], bytes(b)) for f, b in warc.split_records(gzip.compress(record) * 3)] == plain


def test_chains_repeated_headers_and_rings(spark):
    schema = "warc_type string, record_id string, concurrent_to array<string>"
    chain = [("metadata", f"c{i}", [f"c{i - 1}"] if i else ["r1"]) for i in range(6)]
    records = spark.createDataFrame([
        ("response", "r1", None), ("response", "r2", ["q3"]), *chain, ("request", "q1", ["gone", "r1"]), ("request", "q2", ["q1", "q2", None]),
        ("request", "q3", []), ("request", "q4", ["q5"]), ("request", "q5", ["q4"]), ("metadata", "both", ["r1", "r2"])], schema)
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"]["n_requests"], got["r1"]["n_metadata"], got["r1"]["request"]["record_id"]) == (2, 7, "q1")
    assert (got["r2"]["n_requests"], got["r2"]["n_metadata"], got["r2"]["metadata"]["record_id"]) == (1, 1, "both")
    left = {r["record_id"] for r in warc.unassembled(records).collect()}
    assert {"q4", "q5"} <= left and not {"r1", "r2", "q1", "q3", "both"} & left


def test_headers_in_any_case_and_without_length(spark):
    def record(kind, i, more, body, length=True):
        size = f"content-LENGTH: {len(body)}\r\n" if length else ""
        return f"WARC/1.1\r\nwarc-type: {kind}\r\nWarc-Record-Id: {i}\r\n{more}{size}\r\n{body}\r\n\r\n".encode()

    content = (record("response", "r1", "", "first") + record("response", "r2", "", "a\r\n\r\nb", length=False)
               + record("request", "q1", "warc-concurrent-to: x\r\nWARC-CONCURRENT-TO: r2\r\n", "", length=False) + record("metadata", "m1", "", "end", length=False))
    found = [(f["WARC-Record-ID"], f.every("WARC-Concurrent-To"), bytes(b)) for f, b in warc.split_records(content)]
    assert [(i, b) for i, _, b in found] == [("r1", b"first"), ("r2", b"a\r\n\r\nb"), ("q1", b""), ("m1", b"end")]
    assert found[2][1] == ["x", "r2"]
    path = scratch_dir(spark, "warc-headers")
    spark.createDataFrame([(content.decode(),)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    rows = {r["capture_id"]: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
    assert rows["r2"]["request"]["record_id"] == "q1" and rows["r1"]["request"] is None
