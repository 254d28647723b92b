"""Periodic runs, whitening and Merkle fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import merkle, periodic_runs, whitening
from rankfold.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, min_length=6, min_exponent=4):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            length = e - i + q
            smallest = not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if smallest and length >= max(min_length, min_exponent * q):
                found.add((i, length, q))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters,n", [(1, 30), (2, 60), (2, 17), (3, 80), (4, 200)])
def test_runs_of_letters(letters, n):
    rng = random.Random(letters * n)
    for _ in range(30):
        w = []
        while len(w) < n:
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 5))]
            w += part * rng.choice([1, 1, 2, 5])
        for length, exponent in ((6, 4), (2, 2), (4, 3)):
            got = [tuple(r) for r in periodic_runs.runs_of(w, letters, length, exponent).tolist()]
            assert got == slow_runs(w, length, exponent)
    assert periodic_runs.runs_of([], 1, 6, 4).tolist() == []


def test_texts_share_trees():
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        w = [rng.choice(["alpha", "be", "c", "d" + str(rng.randrange(50))]) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(w))
        texts.append(w[:at] + [rng.choice("xyz") for _ in range(rng.randint(1, 4))] * rng.randint(1, 7) + w[at:])
    assert periodic_runs.runs_of_texts(texts, 6, 4) == [slow_runs(w) for w in texts]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op11(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(Q, "table", lambda *a: docs)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and (t or "").strip() for i, t in rows)
    want = []
    for doc_id, text in rows:
        w = planted(doc_id, WORD.findall(text or ""))
        runs = slow_runs(w) if len(w) < 400 else None
        if runs is None:  # long texts: only those periods that their words allow
            runs = [r for r in slow_runs(w[:400]) if r[0] + r[1] < 400] if w == WORD.findall(text or "") and len(set(w)) > 9 else slow_runs(w)
        keep = [True] * len(w)
        for s, n, q in runs:
            keep[s + q: s + n] = [False] * (n - q)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()))
    got = Q.op11_suffix_tree_runs(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes[1:6]] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 2


def test_runs_of_no_documents(spark, no_docs):
    assert periodic_runs.summary(periodic_runs.find_runs(periodic_runs.with_planted_tails(no_docs))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, min_exponent=1)


def vectors(n=300, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32).astype(float)
    x[n // 2: n // 2 + n // 3] = x[0]
    return x


def test_op12(spark, monkeypatch):
    x = vectors()
    odd = [(900, None), (901, [float("nan")] * 5), (902, [None] + [1.0] * 4), (903, [1.0]), (904, []), (905, [float("inf")] * 5)]
    more = [(None, x[3].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame([(i, v.tolist(), 1, "n") for i, v in enumerate(x)] + [(*r, 2, "n") for r in odd + more],
                               "vec_id long, embedding array<float>, n int, component string").repartition(4)
    monkeypatch.setattr(Q, "table", lambda *a: df)
    got = Q.op12_polarised_whitening(spark, "")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    got = got.collect()
    whole = np.floor(64 * x).astype(int) + 1000000
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    values, e = np.linalg.eigh(y.T @ y / n)
    values, e = values[::-1], e[:, ::-1]
    assert len(got) == 302 * 5 and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    sign = {}
    for r in got:
        i = 3 if r["vec_id"] is None else r["vec_id"]
        c = r["component"] - 1
        want = (whole[i] - s / n) @ e[:, c] / np.sqrt(values[c])
        assert r["deviation"] == int(((n * whole[i] - s).astype(object) ** 2).sum())
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-9
        if abs(want) > 1e-6:
            assert sign.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-7


@pytest.mark.parametrize("scale", [1, 10 ** 6, 10 ** 12, 10 ** 17])
def test_exact_sums(spark, scale):
    rng = random.Random(scale)
    fit = [[rng.randrange(-scale, scale) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in fit], "x array<long>").repartition(3)
    n, sums = whitening.dimension_sums(df)
    assert (n, sums) == (40, [sum(v[i] for v in fit) for i in range(3)])
    got = whitening.polarised_sums(df, n, sums)
    y = [[n * v[i] - sums[i] for i in range(3)] for v in fit]
    assert got == {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y) for i in range(3) for j in range(i, 3)}
    v = whitening.covariance(got, n, 3)
    assert v[0, 1] == float(sum(Fraction(r[0] * r[1], n ** 3) for r in y))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0  # no variance, no component
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(6)] + [(9, [1e300, 0.0, 0.0])], schema)
    got = whitening.whiten(flat).collect()
    assert {r["component"] for r in got} <= {1, 2} and all(r["deviation"] is None for r in got if r["vec_id"] == 9)


def test_pieces_are_local():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".\n"]) for _ in range(3000))
    a, b, alone = merkle.trees([text.encode(), (text[:9000] + "changed " + text[9000:]).encode(), b""])
    assert a == merkle.trees([text.encode()])[0] and a.size == len(text.encode())
    assert merkle.likeness(a, b) > 0.98 and merkle.likeness(a, alone) == 0 and merkle.likeness(alone, alone) == 1
    removed, added = merkle.edits(a, b)
    at = len(text[:9000].encode())
    assert len(added) == 1 and added[0][0] - 300 < at < added[0][1] + 300 and len(removed) <= 1 and merkle.edits(a, a) == ([], [])
    other = bytearray(text.encode())
    for s, e in reversed(removed):
        del other[s:e]
    rest = bytearray((text[:9000] + "changed " + text[9000:]).encode())
    for s, e in reversed(added):
        del rest[s:e]
    assert other == rest
    for odd in ("x" * 5000, "日本語" * 900, "\n" * 40, " " * 700):
        t = merkle.trees([odd.encode()])[0]
        assert t.size == len(odd.encode()) and all(odd.encode()[s:e].decode() for s, e in zip([0, *t.ends], t.ends))


def test_op13(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(Q, "table", lambda *a: docs)
    got = Q.op13_merkle_fingerprints(spark, "")
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    by_hash = spark.createDataFrame([(i, t or "", t) for i, t in rows], "doc_id long, t string, raw string").withColumn("h", F.xxhash64("raw"))
    order = by_hash.orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()
    want = []
    for r, following in zip(order, [*order[1:], order[0]]):
        t, u = r["t"], following["t"]
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        x, y, z = merkle.trees([t.encode(), changed.encode(), u.encode()])
        want.append((r["doc_id"], len(t), hashlib.sha256(changed.encode()).hexdigest(), x.root, y.root, merkle.likeness(x, y), merkle.likeness(x, z)))
    assert got == sorted(want, key=str)
    long = [r for r in want if r[1] > 400 and r[6] < 1]
    assert all(r[5] > 0.25 for r in long) and sum(r[5] > r[6] for r in long) > 0.8 * len(long)
    assert len({r[3] for r in want}) == len({t or "" for _, t in rows})


def test_op13_small_tables(spark, no_docs):
    assert merkle.compare_with_next(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcdef", 1)], "doc_id long, text string, part int")
    r = merkle.compare_with_next(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1
    many = spark.createDataFrame([(5, "same text " * 9)] * 50 + [(6, None)], "doc_id long, text string")
    got = merkle.compare_with_next(many).collect()
    assert len(got) == 51 and sum(r["near_next"] == 1 for r in got if r["doc_id"] == 5) == 49


def test_locate_edits_and_nodes(spark):
    lines = [f"line {i} holds some words of its own {i * i}." for i in range(200)]
    before = spark.createDataFrame([(1, "\n".join(lines)), (2, "same"), (3, None), (None, "x")], "doc_id long, text string")
    lines[77] = "another line altogether"
    after = spark.createDataFrame([(1, "\n".join(lines)), (2, "same"), (3, ""), (4, "new")], "doc_id long, text string")
    got = merkle.locate_edits(before, after).collect()
    assert [r["doc_id"] for r in got] == [1]
    text = "\n".join(lines).encode()
    spans = b"".join(text[s["start"]: s["end"]] for s in got[0]["added"])
    assert spans.strip() == b"another line altogether"
    table = merkle.nodes(before)
    assert table.where("doc_id = 1 and level = 'paragraph'").count() == 200
    assert table.where("level = 'piece'").groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 1").first()["n"] == len(
        before.first()["text"].encode())
    assert table.where("level = 'root'").count() == 4
