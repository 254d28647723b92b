"""The pipeline against brute force, and the registration of its queries."""

import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from rankfold.llm import bpe, packing, quality
from tests.llm.test_pairs import base_spans, brute_components
from tests.llm.test_texts import check_sequences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def cut_repeats(rows, length=100):
    """Texts without the bytes of strings that also start earlier (ids ascending and unique)."""
    seen, out = set(), []
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p: p + length]
            if w in seen:
                gone[p: p + length] = True
            seen.add(w)
        out.append((d, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else t))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).where("predicted = 1").collect()]
    label = brute_components(rows)
    rows = [(d, t) for d, t in rows if label[d] == d]
    rows = [(d, t) for d, t in cut_repeats(rows) if not base_spans(t)]
    tokens = bpe.library_encoder(bpe.default_vocabulary())
    want = Counter()
    for d, t in rows:
        n, piece, at = len(tokens.encode(t or "", add_special_tokens=False).ids) + 1, 0, 0
        size = n % 2048 or min(n, 2048)
        while at < n:
            want[d, piece, at, size] += 1
            at, size, piece = at + size, 2048, piece + 1
    got = E.queries()["pipeline"](spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    check_sequences(got, 2048)


def test_stages_keep_the_columns_and_take_odd_rows(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int") \
         .write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, no_docs):
        at = given
        for i, (name, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, at, str(tmp_path))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.dtypes == given.dtypes, name
            path = f"{tmp_path}/{given.isEmpty()}-{i}"
            out.write.parquet(path)
            at = spark.read.schema(out.schema).parquet(path)
    assert at.count() == 0


def test_every_operator_is_registered():
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_packing_reaches_the_bound_on_real_lengths(spark):
    got = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert check_sequences(got, 2048) <= -(-sum(r["length"] for r in got) // 2048) + 1
