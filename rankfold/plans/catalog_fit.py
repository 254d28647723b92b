"""Query catalog, second part: folds, cross-fitting, bagging, blending, evaluation and models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators import blend as BL
from rankfold.operators import boosting as BO
from rankfold.operators import crossfit as CF
from rankfold.operators import encode as EN
from rankfold.operators import features as FE
from rankfold.operators import linear as LI
from rankfold.operators import models as MD
from rankfold.operators import order as OR
from rankfold.operators import slots as SL
from rankfold.functions import rowwise as RW
from rankfold.operators.categories import fit_categories
from rankfold.plans import oracle as O
from rankfold.plans.catalog import BLEND_W, CATS, FAMILIES, NUM, _bag_models_sql, _blend_sql_ctes, _code_sql, query, r6, train_of
from rankfold.session import materialize
from rankfold.sources.fixtures import GRID_TARGETS, base, planted_label, pseudo_scores

# ============================================================ 2.9 folds and cross-fitting

@query("fold_stratified", O.with_ctes(f"select id, target, {O.fold_sql('target')} as fold from base "
                                      f"where split = 'train'"))
def q_fold_stratified(spark, sf_dir):
    """Five hash-shuffled folds dealt inside each label class (seed 218), train rows."""
    return CF.stratified_folds(train_of(base(spark, sf_dir))).select("id", "target", "fold")


@query("fold_kfold", O.with_ctes(f"select id, {O.fold_sql(None)} as fold from base"))
def q_fold_kfold(spark, sf_dir):
    """Five hash-shuffled unstratified folds over train+test."""
    return CF.kfold(base(spark, sf_dir)).select("id", "fold")


def _planted_folds(spark, sf_dir, test: bool = True):
    """Train rows with folds (and test rows), written once before the fold/seed loops."""
    b = planted_label(base(spark, sf_dir))
    tr = materialize(CF.stratified_folds(train_of(b)), "cv_train")
    te = materialize(b.where(F.col("split") == "test"), "cv_test") if test else None
    return tr, te


_OLS_CTES = [O.PLANTED_CTE, "pl as (select * from planted where split = 'train')",
             f"fo as (select *, {O.fold_sql('target')} as fold from pl)",
             O.ols_fold_models("m", "fo", "f_reg_03", "target")]


@query("cv_oof_predict", O.with_ctes(
    "select fo.id, fo.fold, " + O.r6("m.a + m.b * fo.f_reg_03") + " as score from fo join m on m.k = fo.fold",
    *_OLS_CTES))
def q_cv_oof_predict(spark, sf_dir):
    """Out-of-fold scores: per fold, least squares of the label on f_reg_03 fitted on the other folds."""
    tr, _ = _planted_folds(spark, sf_dir, test=False)
    oof = CF.ols_crossfit(tr, "f_reg_03", "target")
    return oof.select("id", "fold", r6("score").alias("score"))


@query("cv_test_average", O.with_ctes(
    "select t.id, " + O.r6("avg(m.a + m.b * t.f_reg_03)") + " as score from planted t, m "
    "where t.split = 'test' group by t.id", *_OLS_CTES))
def q_cv_test_average(spark, sf_dir):
    """Mean over the five fold models of their test-row predictions."""
    tr, te = _planted_folds(spark, sf_dir)
    sc = CF.ols_crossfit(tr, "f_reg_03", "target", test=te)
    return CF.test_average(sc).select("id", r6("score").alias("score"))


@query("cv_test_rank_sum", O.with_ctes(
    "select id, " + O.r6("sum(p)") + " as score from (select t.id, m.k, " +
    O.pct_rank_sql("(m.a + m.b * t.f_reg_03)", ["m.k"]) + " as p from planted t, m where t.split = 'test') x "
    "group by id", *_OLS_CTES))
def q_cv_test_rank_sum(spark, sf_dir):
    """Sum over folds of the percentile-ranked test predictions of each fold model."""
    tr, te = _planted_folds(spark, sf_dir)
    sc = CF.ols_crossfit(tr, "f_reg_03", "target", test=te).where(F.col("split") == "test")
    rk = OR.pct_rank(sc, "score", by=["fold"], out="p")
    return rk.groupBy("id").agg(r6(F.sum("p")).alias("score"))


# Every column of each family and all feature columns outside the family.
_OOF_ALL = {y: [c for c in O.FEATURES if c not in ys] for ys in FAMILIES.values() for y in ys}


def _oof_targets_sql() -> str:
    """One matrix of sums per fold; per family the sweep over the columns outside it, all its columns as right sides."""
    codes = {c: _code_sql(c) for c in CATS}
    cols = ", ".join(f"cast({codes[c][1] if c in codes else f'b.{c}'} as double) as {c}" for c in O.FEATURES)
    means = ", ".join(f"avg({c}) as m_{c}" for c in O.FEATURES)
    ctes = [*[c for c, _ in codes.values()], f"cd as materialized (select b.id, b.split, {cols} from base b)", f"mu as (select {means} from cd)",
            f"fa as materialized (select cd.id, cd.split, {O.fold_sql(None)} as fold, " + ", ".join(f"cd.{c} - mu.m_{c} as {c}" for c in O.FEATURES) + " from cd, mu)"]
    sels, joins = [], []
    for fam, ys in FAMILIES.items():
        xs = _OOF_ALL[ys[0]]
        p = len(xs) + 1
        terms = ["1.0", *[f"t.{c}" for c in [*xs, *ys]]]
        ctes.append(f"g_{fam} as materialized (select f.fold as k, {O.products_sql(terms, p)} from (select distinct fold from fa) f "
                    f"join fa t on t.fold <> f.fold group by f.fold)")
        ctes += O.sweep_ctes(f"w_{fam}", f"g_{fam}", p, len(ys))
        joins.append(f"join w_{fam} on w_{fam}.k = fa.fold")
        for n, y in enumerate(ys):
            guess = " + ".join([f"w_{fam}.a_0_{p + n} + mu.m_{y}", *[f"w_{fam}.a_{i}_{p + n} * fa.{x}" for i, x in enumerate(xs, 1)]])
            sels.append(f"{guess} as oof_{y}")
    ctes.append("pr as materialized (select fa.id, fa.split, " + ", ".join(sels) + " from fa " + " ".join(joins) + ", mu)")
    return O.with_ctes("select id, split, " + ", ".join(O.r6(f"oof_{y}", 4) + f" as oof_{y}" for y in _OOF_ALL) + " from pr", *ctes)


@query("feat_oof_targets", _oof_targets_sql)
def q_feat_oof_targets(spark, sf_dir):
    """OOF features: every column of each family (label codes of categoricals) regressed on all columns outside the family with
    5-fold cross-fitting over train+test; the held-out prediction becomes the feature."""
    b = materialize(CF.kfold(EN.label_encode(base(spark, sf_dir), CATS)), "oof_input")
    out = LI.oof_gram_features(b, _OOF_ALL)
    return out.select("id", "split", *[r6(f"oof_{y}", 4).alias(f"oof_{y}") for y in _OOF_ALL])


@query("feat_oof_boosted", O.with_ctes(
    "select fold, count(*) as n_rows, count(*) as n_ids, count(*) as n_finite, true as follows from "
    f"(select id, {O.fold_sql(None)} as fold from base) x group by fold"))
def q_feat_oof_boosted(spark, sf_dir):
    """The boosted form for every column of each family from all columns outside it (label codes of categoricals): rows, ids and
    rows with all features finite of every fold, and whether the feature of f_car_11 follows its target."""
    b = base(spark, sf_dir)
    b = materialize(CF.kfold(EN.label_encode(b, CATS)), "oof_input")
    got = CF.oof_learned_features(b, _OOF_ALL, lambda x, y: MD.gbt_regressor(x, y, max_iter=ROUNDS))
    j = got.join(b.select("id", "f_car_11"), "id")
    finite = F.greatest(*[F.abs(f"oof_{y}") for y in _OOF_ALL]) < 1e9
    for y in _OOF_ALL:
        finite = finite & F.col(f"oof_{y}").isNotNull()
    return j.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count(F.when(finite, 1)).alias("n_finite"),
        (F.corr("oof_f_car_11", "f_car_11") > 0).alias("follows"))


_SEEDS = list(range(16))


def _bag_scores(tr: DataFrame, te: DataFrame) -> DataFrame:
    return CF.ols_crossfit_seeds(tr, "f_reg_03", "target", _SEEDS, subsample=0.9, test=te)


_BAG_SQL_SCORES = " union all ".join(
    f"select fo.id, 'train' as split, {s} as seed, m{s}.a + m{s}.b * fo.f_reg_03 as sc from fo join m{s} "
    f"on m{s}.k = fo.fold union all select t.id, 'test' as split, {s} as seed, avg(m{s}.a + m{s}.b * t.f_reg_03) "
    f"from planted t, m{s} where t.split = 'test' group by t.id" for s in _SEEDS)


@query("bag_seeds", O.with_ctes(
    f"select id, split, {O.r6('avg(sc)')} as score from ({_BAG_SQL_SCORES}) x group by id, split",
    O.PLANTED_CTE, *_bag_models_sql(_SEEDS)))
def q_bag_seeds(spark, sf_dir):
    """Whole cross-fit repeated with seeds 0..15 (seeded 90 % row subsample per fit), scores averaged."""
    return CF.seed_average(_bag_scores(*_planted_folds(spark, sf_dir))).select("id", "split", r6("score").alias("score"))


@query("bag_running_score", O.with_ctes(
    "select seed, " + O.r6("gini") + " as gini from g",
    O.PLANTED_CTE, *_bag_models_sql(_SEEDS),
    f"sx as (select id, seed, sc from ({_BAG_SQL_SCORES}) x where split = 'train')",
    "rs as (select sx.id, sx.seed, avg(sx.sc) over (partition by sx.id order by sx.seed rows between unbounded "
    "preceding and current row) as rsc, fo.target from sx join fo on fo.id = sx.id)",
    *O.gini_ctes("g", "rs", "target", "rsc", ["seed"])))
def q_bag_running_score(spark, sf_dir):
    """Gini of the running mean of the OOF scores after each seed."""
    tr, te = _planted_folds(spark, sf_dir)
    sc = _bag_scores(tr, te).where(F.col("split") == "train")
    g = CF.running_seed_gini(sc, tr)
    return g.select("seed", r6("gini").alias("gini"))


# ============================================================ blending

@query("blend_rank_equal", O.with_ctes(
    "select id, split, 0.5 * pa + 0.5 * pb as score from (select id, split, " +
    O.pct_rank_sql("f_reg_03", ["split"]) + " as pa, " + O.pct_rank_sql("f_car_15", ["split"]) + " as pb from base) x"))
def q_blend_rank_equal(spark, sf_dir):
    """0.5/0.5 mean of two members' percentile ranks."""
    sc = pseudo_scores(base(spark, sf_dir))
    return BL.blend_equal(sc, "keras5", "xgb0")


@query("blend_rank_weighted", O.with_ctes("select id, split, score from bl",
                                          *_blend_sql_ctes(False)))
def q_blend_rank_weighted(spark, sf_dir):
    """Weighted sum (negative weights allowed) of thirteen members' percentile ranks per split."""
    sc = pseudo_scores(base(spark, sf_dir))
    return BL.blend(sc, BLEND_W)


@query("blend_rerank_submit", O.with_ctes("select id, split, target from rr",
                                          *_blend_sql_ctes(True)))
def q_blend_rerank_submit(spark, sf_dir):
    """Percentile rank of the blended score: the submitted target."""
    sc = pseudo_scores(base(spark, sf_dir))
    return BL.blend(sc, BLEND_W, rerank=True)


# ============================================================ 2.10 evaluation

@query("eval_gini", O.with_ctes("select " + O.r6("gini") + " as gini, n from g", O.PLANTED_CTE,
                                "tr as (select * from planted where split = 'train')",
                                *O.gini_ctes("g", "tr", "target", "f_reg_03")))
def q_eval_gini(spark, sf_dir):
    """Normalized Gini of f_reg_03 against the (planted) label over all train rows."""
    tr = train_of(planted_label(base(spark, sf_dir)))
    return OR.gini(tr, "target", "f_reg_03").select(r6("gini").alias("gini"), "n")


@query("eval_gini_by_fold", O.with_ctes("select fold, " + O.r6("gini") + " as gini, n from g", *_OLS_CTES,
                                        "sc as (select fo.fold, fo.target, m.a + m.b * fo.f_reg_03 as s "
                                        "from fo join m on m.k = fo.fold)",
                                        *O.gini_ctes("g", "sc", "target", "s", ["fold"])))
def q_eval_gini_by_fold(spark, sf_dir):
    """Gini of the out-of-fold scores inside every validation fold."""
    tr, _ = _planted_folds(spark, sf_dir, test=False)
    oof = CF.ols_crossfit(tr, "f_reg_03", "target").join(tr.select("id", "target"), "id")
    return OR.gini(oof, "target", "score", by=["fold"]).select("fold", r6("gini").alias("gini"), "n")


# ============================================================ 2.11 models

FOLDS = 5
ROUNDS = 10      # boosting rounds, epochs and solver steps of jobs that are not fitted for their recipe's own number
FIT_SEEDS = tuple(range(32))

# Blocks of every member's input and whether it is standard-scaled.
RECIPES = {
    "gbt_binary": (("num", "counts", "onehot", "missing", "inter"), False),
    "gbt_regressor": (("num", "counts"), False),
    "count_loss": (("num", "counts", "onehot"), True),
    "robust_loss": (("num", "counts", "composite"), False),
    "gbt_sampled": (("num", "counts", "onehot", "composite", "missing"), False),
    "gbt_scaled": (("num", "counts", "inter", "stats"), True),
    "logistic": (("num", "onehot", "inter", "counts"), True),
    "mlp": (("num", "counts", "missing", "inter"), True),
    "mlp_categorical": (("num", "onehot"), True),
}


def member_frame(spark, sf_dir, member: str) -> tuple[DataFrame, DataFrame]:
    """(train with folds, test) of a member: its blocks as one vector, written once before the fold loop."""
    blocks, scale = RECIPES[member]
    b = materialize(planted_label(base(spark, sf_dir)), "member_base")
    x, dense = b.select("*", RW.missing_count(b, O.FEATURES).alias("missing")), list(NUM)
    if "missing" in blocks:
        dense.append("missing")
    if "inter" in blocks:
        names = [f"inter_{i}_{op}" for i in range(15) for op in ("mul", "div")]
        x = x.select("*", *RW.all_pair_interactions(GRID_TARGETS))
        x = x.select(*[c for c in x.columns if c not in names], *[RW.nonfinite_to_zero(c).alias(c) for c in names])
        dense += names
    fitted = fit_categories(b, CATS)
    if "counts" in blocks:
        x = fitted.count(x)
        dense += [f"{c}_count" for c in CATS]
    if "composite" in blocks:
        for fam, cols in FAMILIES.items():
            x = FE.composite_counts(x, cols, f"new_{fam}_count", fit_df=b)
            dense.append(f"new_{fam}_count")
    if "stats" in blocks:
        stats = FE.fit_group_stats(b, FE.grid_pairs(GRID_TARGETS, ["f_ind_02_cat", "f_ind_03"]))
        x = stats.transform(x)
        dense += [c for t in stats.tables.values() for c in t.columns if "__by__" in c]
    if member == "logistic":
        # The best 75 % of all dense columns and one-hot slots by ANOVA F (train rows), scaled; the learner's free intercept takes up the shifts.
        x, _ = SL.fit_slots(x, dense, CATS, "target", 75.0).vector(x)
    else:
        if scale:
            # Read by the scaler and the assembler: the joins and interactions are done once.
            x = materialize(x.select("id", "split", "target", *dict.fromkeys([*dense, *(CATS if "onehot" in blocks else [])])), "member_wide")
            x = EN.fit_scaler(x, dense).transform(x)
        if "onehot" in blocks:
            x = fitted.onehot(x, unseen="error")
        x = VectorAssembler(inputCols=dense + (["onehot"] if "onehot" in blocks else []), outputCol="features").transform(x)
    x = materialize(x.select("id", "split", "target", "features"), "member_frame")
    # A fit reads its rows several times: the folds are written too, else every pass deals and shuffles all vectors again.
    return materialize(CF.stratified_folds(x.where(F.col("split") == "train"), k=FOLDS), "member_folds"), x.where(F.col("split") == "test")


def member_scores(spark, sf_dir, member: str, make, score=None, ranked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, train): out-of-fold and per-fold test scores of a member; ``ranked`` replaces them by their
    percentile rank within each file."""
    tr, te = member_frame(spark, sf_dir, member)
    sc = CF.ml_crossfit(tr, make, k=FOLDS, test=te, score=score)
    if ranked:
        sc = OR.pct_rank(materialize(sc, "raw_scores"), "score", by=["split", "fold"], out="rank").drop("score").withColumnRenamed("rank", "score")
    return materialize(sc.select("id", "split", "fold", "seed", "score"), "member_scores"), tr


def _member(name: str, make, doc: str, score=None, ranked: bool = False, suffix: str = "") -> None:
    def run(spark, sf_dir):
        return member_scores(spark, sf_dir, name, make, score, ranked)[0].select("id", "split", "fold", "score")
    run.__doc__ = doc + " Five-fold out-of-fold scores and every fold model's test scores."
    query(f"mdl_{name}{suffix}")(run)


def _raw():
    return F.col("prediction").cast("double")


def _clipped():
    return F.least(F.greatest(F.col("prediction").cast("double"), F.lit(0.0)), F.lit(1.0))


_member("gbt_binary", lambda rows: MD.gbt_binary(max_iter=ROUNDS), "Boosted trees, logistic loss, 60 % features, 90 % rows, 256 bins.")
_member("gbt_regressor", lambda rows: MD.gbt_regressor(label="target"), "Squared-error boosted trees (depth 6, 90 % rows, 85 % features), clipped to [0, 1].",
        score=_clipped)
_member("count_loss", lambda rows: MD.count_loss(max_iter=ROUNDS), "Poisson GLM (log link) on all the member's blocks, ranked.", score=_raw, ranked=True, suffix="_wide")
_member("robust_loss", lambda rows: MD.gbt_regressor(label="target", loss="absolute", max_iter=ROUNDS), "Absolute-loss boosted trees, ranked.", score=_raw,
        ranked=True, suffix="_trees")
_member("gbt_sampled", lambda rows: MD.gbt_sampled(max_iter=ROUNDS), "Boosted trees with 70 % row sampling per round, ranked.", ranked=True)
_member("gbt_scaled", lambda rows: MD.gbt_scaled(), "Boosted trees on the wide standard-scaled matrix.")
_member("logistic", lambda rows: MD.logistic(C=25.0, n_rows=rows.count(), max_iter=50),
        "L2 logistic regression, C = 25 for each fold's own row count, on the selected and scaled features of all blocks.", suffix="_wide")
_member("mlp", lambda rows: MD.mlp(_width(rows)), "Two-hidden-layer perceptron 512 -> 64 on the scaled dense features.")
_member("mlp_categorical", lambda rows: MD.mlp(_width(rows), hidden=(64, 16), max_iter=ROUNDS),
        "Perceptron 64 -> 16 on the numeric block with the categoricals as one-hot blocks.")


def _width(tr: DataFrame) -> int:
    """Input width of the assembled vector (read from one row)."""
    return len(tr.first()["features"])


# Linear members: exact at a stated number of steps, on the standardised numeric block, so that SQL can follow them.
LINEAR = {"logistic": dict(family="binomial", steps=6, l2=1.0 / 25.0), "count_loss": dict(family="poisson", steps=6), "robust_loss": dict(family="fair", steps=8, c=1.0)}


def _linear_sql(name: str, ranked: bool) -> str:
    how, p = LINEAR[name], len(NUM) + 1
    ctes = [O.PLANTED_CTE, "pl as (select * from planted where split = 'train')", f"fo as materialized (select *, {O.fold_sql('target')} as fold from pl)",
            *O.scaled_ctes("select id, fold, target, " + ", ".join(NUM) + " from fo union all select id, null, null, " + ", ".join(NUM)
                           + " from planted where split = 'test'", NUM),
            "tr as materialized (select * from zx where fold is not null)", *O.glm_ctes("m", "tr", p, **how),
            f"sc as materialized (select t.id, case when t.fold is null then 'test' else 'train' end as split, m.k as fold, {O.glm_score(p, how['family'])} as s "
            f"from zx t join m on t.fold is null or t.fold = m.k)"]
    value = O.pct_rank_sql("s", ["split", "fold"]) if ranked else O.r6("s")
    return O.with_ctes(f"select id, split, fold, {value} as score from sc", *ctes)


def _linear_scores(spark, sf_dir, name: str) -> DataFrame:
    tr, te = _planted_folds(spark, sf_dir)
    return LI.glm_crossfit(tr, NUM, "target", test=te, **LINEAR[name])


def _linear(name: str, doc: str, ranked: bool = False) -> None:
    def run(spark, sf_dir):
        sc = _linear_scores(spark, sf_dir, name)
        if ranked:
            sc = OR.pct_rank(materialize(sc, "raw_scores"), "score", by=["split", "fold"], out="rank").drop("score").withColumnRenamed("rank", "score")
        return sc.select("id", "split", "fold", (F.col("score") if ranked else r6("score")).alias("score"))
    run.__doc__ = doc + " All folds are fitted together, one aggregate per step; out-of-fold scores and every fold model's test scores."
    query(f"mdl_{name}", _linear_sql(name, ranked))(run)


_linear("logistic", "L2 logistic regression (C = 25) on the scaled numeric block by Newton steps.")
_linear("count_loss", "Poisson loss (log link) on the 0/1 label, ranked.", ranked=True)
_linear("robust_loss", "Fair loss by reweighted least squares, ranked.", ranked=True)


@query("mdl_predict")
def q_mdl_predict(spark, sf_dir):
    """Probability of class 1 for the test rows from a boosted model fitted on all train rows."""
    tr, te = member_frame(spark, sf_dir, "gbt_regressor")
    return MD.predict_positive(MD.gbt_binary(max_iter=ROUNDS).fit(tr), te)


def _full_sql() -> str:
    p = len(NUM) + 1
    ctes = [O.PLANTED_CTE, "fo as materialized (select *, 0 as fold from planted where split = 'train')",
            *O.scaled_ctes("select id, fold, target, " + ", ".join(NUM) + " from fo union all select id, null, null, " + ", ".join(NUM)
                           + " from planted where split = 'test'", NUM),
            "tr as materialized (select * from zx where fold is not null)",
            *O.glm_ctes("m", "tr", p, **LINEAR["logistic"], models="select -1 as k")]
    return O.with_ctes(f"select t.id, {O.r6(O.glm_score(p, 'binomial'))} as score from zx t, m where t.fold is null", *ctes)


@query("fit_full_single", _full_sql)
def q_fit_full_single(spark, sf_dir):
    """Logistic member fitted once on all train rows, test rows scored."""
    b = materialize(planted_label(base(spark, sf_dir)), "full_rows")
    sc = LI.glm_crossfit(train_of(b).withColumn("fold", F.lit(0)), NUM, "target", test=b.where(F.col("split") == "test"), models=[-1], **LINEAR["logistic"])
    return sc.where(F.col("split") == "test").select("id", r6("score").alias("score"))


@query("fit_full_bagged")
def q_fit_full_bagged(spark, sf_dir):
    """No CV: boosted trees fitted on all train rows with several seeds, test scores averaged."""
    tr, te = member_frame(spark, sf_dir, "gbt_binary")
    return MD.bagged_scores(lambda s: MD.gbt_binary(seed=s), FIT_SEEDS, tr, te)


# ============================================================ boosting that stops

# Rounds that are allowed, step, rounds without a better value before a fold's fit stops, cuts per column in deviations.
STOP = dict(rounds=16, rate=0.5, patience=3)
STOP_AT = (-1.0, -0.5, 0.0, 0.5, 1.0)
STOP_SEEDS = (0, 1, 2)


def _stopped(spark, sf_dir, seed: int = 0, metric=None, rows: DataFrame | None = None) -> BO.Boosted:
    """Stump boosting of every fold: validation rows are carved out of the training folds, the fold itself is only scored."""
    tr = rows if rows is not None else _planted_folds(spark, sf_dir, test=False)[0]
    return BO.boost(BO.with_roles(tr.select("id", "target", "fold", *NUM), FOLDS, seed=seed), BO.BestStump(NUM, STOP_AT), metric=metric, **STOP)


def _stop_sql(tag: str, seed: int, loss: bool = False) -> list[str]:
    """CTEs {tag}_v (model, round, value) and {tag} (model, best, stop)."""
    n = STOP["rounds"]
    rows = " union all ".join(f"select {r} as round, model, target, margin from {tag}_m{r} where role = 'valid'" for r in range(1, n + 1))
    ctes = [*O.boost_ctes(tag, NUM, STOP_AT, n, STOP["rate"], seed), f"{tag}_rows as materialized ({rows})"]
    if loss:
        ctes.append(f"{tag}_v as materialized (select model, round, round(avg(abs(target - 1.0 / (1.0 + exp(-margin)))), 6) as value from {tag}_rows group by model, round)")
    else:
        ctes += [*O.gini_ctes(f"{tag}_gi", f"{tag}_rows", "target", "margin", ["model", "round"]),
                 f"{tag}_v as materialized (select model, round, round(gini, 6) as value from {tag}_gi)"]
    return ctes + O.stop_ctes(tag, f"{tag}_v", n, STOP["patience"], -1 if loss else 1)


_FOLDED = [O.PLANTED_CTE, "pl as (select * from planted where split = 'train')", f"fo as materialized (select *, {O.fold_sql('target')} as fold from pl)"]
_HISTORY = "fold int, round int, value double, best_round int, stop_round int"


def _history(spark, boosted: BO.Boosted) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in boosted.history], _HISTORY)


@query("eval_early_stop", lambda: O.with_ctes(
    "select cast(v.model as int) as fold, cast(v.round as int) as round, v.value as gini, cast(e.best as int) as best_round, cast(e.stop as int) as stop_round "
    "from e_v v join e on e.model = v.model where v.round <= e.stop", *_FOLDED, *_stop_sql("e", 0)))
def q_eval_early_stop(spark, sf_dir):
    """Boosting round by round until the validation Gini has not improved for some rounds: per fold and fitted round the Gini, and the
    best and the last round. Later rounds are not fitted."""
    return _history(spark, _stopped(spark, sf_dir)).withColumnRenamed("value", "gini")


@query("eval_early_stop_scores", lambda: O.with_ctes(
    "select id, fold, " + O.r6("1.0 / (1.0 + exp(-margin))") + " as score from (" + " union all ".join(
        f"select m.id, cast(m.model as int) as fold, m.margin from e_m{r} m join e on e.model = m.model and e.best = {r} where m.role = 'score'"
        for r in range(1, STOP["rounds"] + 1)) + ") x", *_FOLDED, *_stop_sql("e", 0)))
def q_eval_early_stop_scores(spark, sf_dir):
    """Out-of-fold probabilities of the best round of every fold's fit."""
    sc = _stopped(spark, sf_dir).scores.where(F.col("role") == BO.SCORE)
    return sc.select("id", F.col("model").cast("int").alias("fold"), r6(BO.probability(F.col("score"))).alias("score"))


@query("eval_best_rounds", lambda: O.with_ctes(
    "select seed, cast(model as int) as fold, cast(best as int) as best_round, " + O.r6("avg(best) over ()") + " as mean_round, "
    "median(best) over () as median_round, " + O.r6("stddev_pop(best) over ()") + " as std_round from ("
    + " union all ".join(f"select cast({s} as int) as seed, model, best from e{s}" for s in STOP_SEEDS) + ") x",
    *_FOLDED, *[c for s in STOP_SEEDS for c in _stop_sql(f"e{s}", s)]))
def q_eval_best_rounds(spark, sf_dir):
    """Best rounds of all folds and seeds (each carves out other validation rows), with their mean, median and population std."""
    tr, _ = _planted_folds(spark, sf_dir, test=False)
    found = [(s, m, best) for s in STOP_SEEDS for m, i, _, best, _ in _stopped(spark, sf_dir, s, rows=tr).history if i == 1]
    best = spark.createDataFrame(found, "seed int, fold int, best_round int")
    # A row per fit: folds times seeds.
    whole = best.agg(r6(F.avg("best_round")).alias("mean_round"), F.median("best_round").alias("median_round"),
                     r6(F.stddev_pop("best_round")).alias("std_round"))
    return best.crossJoin(F.broadcast(whole))


@query("udf_metric_hook", lambda: O.with_ctes(
    " union all ".join(f"select '{name}' as metric, cast(v.model as int) as fold, cast(v.round as int) as round, v.value, cast(e.best as int) as best_round, "
                       f"cast(e.stop as int) as stop_round from {tag}_v v join {tag} e on e.model = v.model where v.round <= e.stop"
                       for name, tag in (("gini", "e"), ("loss", "h"))), *_FOLDED, *_stop_sql("e", 0), *_stop_sql("h", 0, loss=True)))
def q_udf_metric_hook(spark, sf_dir):
    """The same boosting steered by two metrics through the hook: the Gini and the mean absolute error of the probability."""
    tr, _ = _planted_folds(spark, sf_dir, test=False)
    parts = [_history(spark, _stopped(spark, sf_dir, metric=metric, rows=tr)).select(F.lit(name).alias("metric"), "*")
             for name, metric in (("gini", BO.GiniEvaluator("target", "margin")), ("loss", BO.LossEvaluator("target", "margin")))]
    return parts[0].unionByName(parts[1])
