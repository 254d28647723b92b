"""Dense columns and one-hot slots as one block: F values, selection and scaling without a dense matrix.

Slots are numbered: the dense columns first, then the categories of every categorical column in code order.
All that ANOVA and scaling need of a 0/1 slot follows from counts (rows, rows of each class, and how many
of them hold the category), so one unpivoted (column, value, class) aggregate serves every slot, and a row
only ever carries the slots that it holds. Scaling keeps zeros: an entry is divided by its slot's
standard deviation, and the mean goes into the slot's ``shift``, so that the scaled value is ``value + shift``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.feature import ElementwiseProduct, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.categories import Categories, fit_categories, long_values, lookup
from rankfold.operators.encode import Scaler, f_classif, fit_scaler
from rankfold.operators.order import N, N_BEFORE, row_number_by, running_totals
from rankfold.session import materialize


def slot_f_values(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """ANOVA F of every category's 0/1 slot against the class label: (column, text, f_value).

    Rows without a label take no part; a NULL category is a row that holds no slot of its column. A slot
    that all rows hold gets NULL; one that separates the classes without error gets infinity.
    """
    labelled = df.where(F.col(label).isNotNull())
    sizes = materialize(labelled.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_n")), "classes")
    rows, classes = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    held = labelled.select(F.col(label).alias("_y"), long_values(df, cols)).where("text is not null") \
                   .groupBy("column", "text", "_y").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    held = lookup(held, sizes, "_y", classes)
    c, n, rows = F.col("_c"), F.col("_n"), float(rows or 0.0)
    held = held.withColumn("_all", F.sum("_c").over(Window.partitionBy("column", "text")))
    mean = F.col("_all") / F.lit(rows)
    sums = held.groupBy("column", "text", "_all").agg(
        F.sum(c * (n - c) / n).alias("_within"), F.sum(n * (c / n - mean) * (c / n - mean)).alias("_between"), F.sum("_n").alias("_met"))
    # Classes without the category have mean 0.
    between = F.col("_between") + (F.lit(rows) - F.col("_met")) * mean * mean
    ratio = F.try_divide(F.try_divide(between, F.lit(float(classes - 1))), F.try_divide(F.col("_within"), F.lit(rows - classes)))
    f = F.when(F.col("_all") == F.lit(rows), F.lit(None)) \
         .when((F.col("_within") == 0) & F.lit(1 < classes < rows), F.lit(float("inf"))).otherwise(ratio)
    return sums.select("column", "text", f.cast("double").alias("f_value"))


def keep_best(scores: DataFrame, percentile: float) -> DataFrame:
    """``scores`` (slot, f_value, ...) with ``keep``: the best ``int(n * percentile / 100)`` by F value, NULL and NaN last,
    ties by slot. The cut is found by prefix sums over distinct F values, then over the slots that share the cut's
    value (rare categories share theirs by the million), so no task ranks all slots.
    """
    n = scores.count()
    wanted = int(n * percentile / 100)
    if wanted <= 0 or wanted >= n:
        return scores.withColumn("keep", F.lit(wanted > 0))
    f = F.when(~F.isnan("f_value"), F.col("f_value"))
    totals = running_totals(scores.select(f.alias("_f")), ["_f"], descending=True)
    cut = totals.where((F.col(N_BEFORE) < wanted) & (F.col(N_BEFORE) + F.col(N) >= wanted)).select("_f", N_BEFORE).first()
    if cut is not None:
        ahead, tied, above = cut[N_BEFORE], f == F.lit(cut["_f"]), f > F.lit(cut["_f"])
    else:
        ahead, tied, above = scores.where(f.isNotNull()).count(), f.isNull(), f.isNotNull()
    places = row_number_by(scores.where(tied).select("slot"), "slot", out="_place")
    last = places.where(F.col("_place") == wanted - int(ahead) - 1).first()["slot"]
    return scores.withColumn("keep", F.coalesce(above, F.lit(False)) | (F.coalesce(tied, F.lit(False)) & (F.col("slot") <= F.lit(last))))


@dataclass
class SlotBlock:
    """A fitted block. ``table`` has one row per slot: slot, feature, column and text (NULL for dense columns), f_value, keep,
    scale (1 / population std, 1 without variance), shift (-mean * scale; 0 for dense columns, whose entries are centred)."""

    dense: list[str]
    categories: Categories
    scaler: Scaler
    table: DataFrame

    def offsets(self) -> dict[str, int]:
        """First slot of every categorical column."""
        at, out = len(self.dense), {}
        for c, k in self.categories.sizes.items():
            out[c] = at
            at += k
        return out

    def entries(self, df: DataFrame, key: str = "id", selected: bool = True) -> DataFrame:
        """Long sparse rows (key, slot, value, shift) of the scaled block; ``selected`` leaves out slots that were not kept.

        NULL and unseen categories have no entry, nor have NULL dense values.
        """
        x = self.scaler.transform(df)
        kept = {r["slot"] for r in self.table.where((F.col("slot") < len(self.dense)) & F.col("keep")).select("slot").collect()}
        parts: list[Column] = [F.struct(F.lit(i).cast("long").alias("slot"), F.col(c).alias("value"), F.lit(0.0).alias("shift"))
                               for i, c in enumerate(self.dense) if not selected or i in kept]
        entry = F.struct("slot", F.col("scale").alias("value"), "shift")
        for j, (c, k) in enumerate(self.categories.sizes.items()):
            own = self.table.where(F.col("column") == c)
            own = own.where("keep") if selected else own
            own = own.select(F.col("text").cast(self.categories.kinds[c]).alias(c), entry.alias(f"__s{j}"))
            x = lookup(x, own, c, k)
            parts.append(F.col(f"__s{j}"))
        return x.select(key, F.explode(F.array(*parts)).alias("_e")).select(key, "_e.*").where("value is not null")

    def vector(self, df: DataFrame, out: str = "features") -> tuple[DataFrame, list[float]]:
        """``df`` with the kept, scaled block as one sparse vector, and the shifts of its positions.

        A linear model with weights w on the centred block has the same scores as one on this vector whose
        intercept is larger by w . shifts. The scales of all slots pass the driver, as many numbers as
        a model has weights. NULL dense values become the mean.
        """
        rows = {r["slot"]: r for r in self.table.select("slot", "scale", "shift", "keep").collect()}
        # The encoder keeps one more place per column for NULL and unseen categories; it is never selected.
        places = list(range(len(self.dense)))
        at = len(self.dense)
        for c, k in self.categories.sizes.items():
            places += list(range(at, at + k))
            at += k + 1
        scales, kept, shifts = [0.0] * at, [], []
        for slot, place in enumerate(places):
            scales[place] = 1.0 if slot < len(self.dense) else rows[slot]["scale"]
            if rows[slot]["keep"]:
                kept.append(place)
                shifts.append(rows[slot]["shift"])
        dense = [f"__d{i}" for i in range(len(self.dense))]
        scaled = [F.coalesce((F.col(c).cast("double") - F.lit(self.scaler.means[c])) / F.lit(self.scaler.stds[c]), F.lit(0.0)).alias(d)
                  for c, d in zip(self.dense, dense)]
        x = self.categories.onehot(df.select("*", *scaled), out="__oh", unseen="keep")
        x = VectorAssembler(inputCols=[*dense, "__oh"], outputCol="__all").transform(x)
        x = ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol="__all", outputCol="__scaled").transform(x)
        x = VectorSlicer(inputCol="__scaled", outputCol=out, indices=kept).transform(x)
        return x.select(*df.columns, out), shifts


def fit_slots(df: DataFrame, dense: Sequence[str], cats: Sequence[str], label: str, percentile: float = 100.0) -> SlotBlock:
    """Fit categories and scaling on all rows of ``df``, F values on its rows with a label (train), and keep the best
    ``percentile`` per cent of all dense columns and slots together."""
    dense, cats = list(dense), list(cats)
    src = materialize(df.select(*dict.fromkeys([label, *dense, *cats])), "slots_src")
    fitted, scaler, rows = fit_categories(src, cats), fit_scaler(src, dense), src.count()
    block = SlotBlock(dense, fitted, scaler, fitted.table)
    first = F.create_map(*[F.lit(v) for pair in block.offsets().items() for v in pair])
    mean = F.col("n") / F.lit(float(rows))
    std = F.sqrt(mean * (1 - mean))
    scale = F.when(std > 0, 1 / std).otherwise(F.lit(1.0))
    sparse = fitted.table.join(slot_f_values(src, label, cats), ["column", "text"], "left").select(
        (first[F.col("column")] + F.col("code")).cast("long").alias("slot"), F.concat_ws("=", "column", "text").alias("feature"), "column", "text",
        "f_value", scale.alias("scale"), (-mean * scale).alias("shift"))
    if dense:
        given = df.sparkSession.createDataFrame([(i, c, 1.0 / scaler.stds[c]) for i, c in enumerate(dense)], "slot long, feature string, scale double")
        sparse = sparse.unionByName(given.join(f_classif(src, label, dense).drop("pos"), "feature", "left").select(
            "slot", "feature", F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("text"), "f_value", "scale",
            F.lit(0.0).alias("shift")))
    block.table = materialize(keep_best(materialize(sparse, "slot_scores"), percentile), "slots")
    return block
