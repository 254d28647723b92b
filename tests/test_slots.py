"""Dense columns and one-hot slots as one block, against numpy on the dense matrix."""

import numpy as np
import pandas as pd
import pytest

from rankfold.operators import slots as SL


def _frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n) + y, "k": 1.0, "s": np.where(rng.random(n) < 0.5, "hot", "v" + pd.Series(rng.integers(0, 40, n)).astype(str)),
                        "t": np.where(y == 2, "two", "rest"), "one": "same"})
    label = pd.Series(y, dtype="Int64")
    label[rng.random(n) < 0.3] = pd.NA
    rows = [(int(r.id), None if pd.isna(v) else int(v), r.a, r.k, None if r.id % 17 == 0 else r.s, r.t, r.one) for r, v in zip(pdf.itertuples(), label)]
    return spark.createDataFrame(rows, "id long, target int, a double, k double, s string, t string, one string")


def _dense(pdf, dense, cats):
    names, cols = list(dense), [pdf[c].to_numpy(float) for c in dense]
    for c in cats:
        for v in sorted(pdf[c].dropna().unique()):
            names.append(f"{c}={v}")
            cols.append((pdf[c] == v).to_numpy(float))
    return names, np.array(cols).T


def _anova(x, y):
    groups = [x[y == v] for v in np.unique(y)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(groups))
    return None if x.min() == x.max() else float("inf") if within < 1e-12 else between / within


DENSE, CATS = ["a", "k"], ["s", "t", "one"]


def test_slots_match_the_dense_matrix(spark):
    df = _frame(spark)
    pdf = df.toPandas()
    names, x = _dense(pdf, DENSE, CATS)
    seen = pdf.target.notna().to_numpy()
    block = SL.fit_slots(df, DENSE, CATS, "target", percentile=75.0)
    got = block.table.orderBy("slot").collect()
    assert [r["feature"] for r in got] == names and [r["slot"] for r in got] == list(range(len(names)))
    want = [_anova(x[seen, j], pdf.target[seen].to_numpy()) for j in range(len(names))]
    for r, w in zip(got, want):
        assert (r["f_value"] is None) == (w is None), r
        assert w is None or r["f_value"] == pytest.approx(w, rel=1e-9)
    order = sorted(range(len(names)), key=lambda j: (want[j] is None, -(want[j] or 0.0) if want[j] is not None else 0.0, j))
    kept = set(order[:int(len(names) * 0.75)])
    # Values that only rounding sets apart may swap at the cut; elsewhere the choice is the same.
    level = sorted((w for w in want if w is not None), reverse=True)[len(kept) - 1]
    assert all(r["keep"] == (r["slot"] in kept) for r, w in zip(got, want) if w is None or abs(w - level) > 1e-9)
    assert sum(r["keep"] for r in got) == len(kept)

    std = np.where(x.std(0) > 0, x.std(0), 1.0)
    scaled = (x - x.mean(0)) / std
    back = np.tile([r["shift"] for r in got], (len(pdf), 1))
    for e in block.entries(df, selected=False).collect():
        back[e["id"], e["slot"]] += e["value"]
    assert np.allclose(back, scaled)
    assert {e["slot"] for e in block.entries(df).collect()} <= {r["slot"] for r in got if r["keep"]}

    made, shifts = block.vector(df)
    cols = [r["slot"] for r in got if r["keep"]]
    dense = np.array([r["features"].toArray() for r in made.orderBy("id").collect()])
    assert np.allclose(dense + np.array(shifts), scaled[:, cols])
    assert made.columns == [*df.columns, "features"]


def test_unseen_and_null_rows_have_no_entries(spark):
    df = _frame(spark)
    block = SL.fit_slots(df, DENSE, CATS, "target")
    other = spark.createDataFrame([(1, None, None, None, "never", None, "same")], df.schema)
    assert [e["slot"] for e in block.entries(other).collect()] == [max(r["slot"] for r in block.table.collect())]
    vector = block.vector(other)[0].first()["features"]
    assert np.count_nonzero(vector.toArray()) == 1


@pytest.mark.parametrize("percentile,want", [(0, []), (20, [3]), (40, [1, 3]), (60, [1, 2, 3]), (80, [0, 1, 2, 3]), (100, [0, 1, 2, 3, 4])])
def test_the_cut_breaks_ties_by_slot_and_puts_missing_values_last(spark, percentile, want):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, 2.0), (3, float("inf")), (4, float("nan"))], "slot long, f_value double")
    assert [r["slot"] for r in SL.keep_best(df, percentile).where("keep").orderBy("slot").collect()] == want


def test_no_rows_with_a_label(spark):
    df = spark.createDataFrame([(1, None, 2.0, "x")], "id long, target int, a double, s string")
    got = SL.fit_slots(df, ["a"], ["s"], "target", 50.0).table.orderBy("slot").collect()
    assert [(r["f_value"], r["keep"]) for r in got] == [(None, True), (None, False)]
