"""Query catalog: one entry per operator of the inventory, each a (Spark job, SQL oracle) pair.

Every Spark job reads the driver's tables (through ``rankfold.sources.fixtures.base``)
and runs the library's operator over all rows. Doubles that come out of aggregations
(whose summation order differs between engines) are rounded to six decimals on both
sides; exact-arithmetic outputs (percentile ranks, fixed-order blends) are returned
unrounded because both engines produce the same bits.
Entries whose semantics SQL cannot state (model training) have no oracle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.functions import rowwise as RW
from rankfold.operators import blend as BL
from rankfold.operators import crossfit as CF
from rankfold.operators import encode as EN
from rankfold.operators import features as FE
from rankfold.operators import order as OR
from rankfold.operators import slots as SL
from rankfold.operators.categories import distinct_counts, fit_categories
from rankfold.plans import oracle as O
from rankfold.roles import FeatureRoles
from rankfold.session import materialize, scratch_dir
from rankfold.sources import files as IO
from rankfold.sources.seed_run import SeedRun
from rankfold.sources.fixtures import GRID_GROUPS, GRID_TARGETS, PSEUDO_MODELS, base, planted_label, pseudo_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql=None):
    """Register a job under ``name`` with its SQL (text, or a function that makes it)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql() if callable(sql) else sql
        fn.__name__ = name
        return fn
    return deco


def r6(c, digits: int = 6) -> "F.Column":
    """Round for the comparison; the oracle applies the same formula (see ``oracle.r6``):
    magnitude-dependent decimals, a 1e-12 relative nudge for exact ties, IEEE-only rounding."""
    x0 = F.col(c) if isinstance(c, str) else c
    x = x0 + F.abs(x0) * F.lit(1e-12)

    def rd(d: int):
        sc = F.lit(10.0 ** d)
        return F.floor(x * sc + F.lit(0.5)).cast("double") / sc
    ax = F.abs(x0)
    return F.when(ax < 1e3, rd(digits)).when(ax < 1e6, rd(digits - 2)).otherwise(rd(max(digits - 4, 0))) + F.lit(0.0)


def round_doubles(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keep
                       else F.col(f.name) for f in df.schema.fields])


def _rounded_stats(table: DataFrame, g: str) -> DataFrame:
    """A fitted table of group statistics, rounded: the same values as rounding them on every row."""
    return round_doubles(table, keep=(g,))


def train_of(b: DataFrame) -> DataFrame:
    return b.where(F.col("split") == "train")


ROLES = FeatureRoles(tuple(["id", "split", "target"] + O.FEATURES))
CATS = ROLES.cat                      # 5 categoricals (2 int, 3 string)
NUM = ROLES.num                       # numeric block without calc
IND = ROLES.family("ind")
FAMILIES = {fam: ROLES.family(fam) for fam in ("ind", "reg", "car")}
CAR_NUM = [c for c in ROLES.family("car") if c not in CATS]
PSEUDO = list(PSEUDO_MODELS)
BLEND_W = BL.REFERENCE_WEIGHTS

_DTYPES = {"f_ind_01": "int", "f_ind_02_cat": "int", "f_ind_03": "int", "f_ind_04_cat": "string",
           "f_ind_06_bin": "int", "f_ind_15": "int", "f_reg_01": "double", "f_reg_02_cat": "int",
           "f_reg_03": "double", "f_car_01_cat": "string", "f_car_02_cat": "string", "f_car_11": "double",
           "f_car_12": "double", "f_car_13": "double", "f_car_15": "double", "f_calc_01": "double",
           "id": "bigint", "target": "int"}


def _cols(cs) -> str:
    return ", ".join(cs)


# ============================================================ 2.1 sources and sinks

BASE_SCHEMA = ("id bigint, split string, target int, f_ind_01 int, f_ind_02_cat int, f_ind_03 int, "
               "f_ind_04_cat string, f_ind_06_bin int, f_ind_15 int, f_reg_01 double, f_reg_02_cat int, "
               "f_reg_03 double, f_car_01_cat string, f_car_02_cat string, f_car_11 double, f_car_12 double, "
               "f_car_13 double, f_car_15 double, f_calc_01 double")


def _csv_roundtrip(spark, sf_dir, columns=None):
    path = scratch_dir(spark, "src_csv")
    IO.write_csv(base(spark, sf_dir), path)
    return IO.read_csv(spark, path, schema=BASE_SCHEMA, columns=columns)


@query("src_csv", O.with_ctes("select * from base"))
def q_src_csv(spark, sf_dir):
    """Write the wide table as headered CSV and read it back with an explicit schema."""
    return _csv_roundtrip(spark, sf_dir)


@query("src_csv_pruned", O.with_ctes("select id, target from base"))
def q_src_csv_pruned(spark, sf_dir):
    """Read only (id, target) of the CSV table; the scan parses only those columns."""
    return _csv_roundtrip(spark, sf_dir, columns=["id", "target"])


_PSEUDO_SQL = " union all ".join(f"select id, '{m}' as model, split, cast({c} as double) as score from base" for m, c in PSEUDO_MODELS.items())


@query("src_predictions", O.with_ctes(f"select * from ({_PSEUDO_SQL}) s"))
def q_src_predictions(spark, sf_dir):
    """Member score files written partitioned by model/split and read back in one scan."""
    path = scratch_dir(spark, "scores")
    IO.write_scores(pseudo_scores(base(spark, sf_dir)), path)
    return IO.read_scores(spark, path).select("id", "model", "split", "score")


@query("src_feature_block", O.with_ctes(
    f"select id, split, target, {O.missing_sql()} as missing from base"))
def q_src_feature_block(spark, sf_dir):
    """Persist a feature block partitioned by split, load its train and test parts, join the label back on id."""
    b = base(spark, sf_dir)
    path = scratch_dir(spark, "block")
    IO.write_feature_block(b.select("id", "split", RW.missing_count(b, O.FEATURES).alias("missing")), path)
    blk = IO.read_feature_block(spark, path, split="train").unionByName(IO.read_feature_block(spark, path, split="test"))
    return blk.join(b.select("id", "target"), "id").select("id", "split", "target", "missing")


@query("src_glob_columns", O.with_ctes("select id, f_car_13, f_reg_01, f_reg_03 from base"))
def q_src_glob_columns(spark, sf_dir):
    """Per-feature files in one folder; pick the names containing 'reg' or 'car_13', one column per file."""
    b = base(spark, sf_dir)
    folder = scratch_dir(spark, "featfiles")
    IO.write_feature_files(b, ["f_reg_01", "f_reg_03", "f_car_13", "f_car_15"], folder)
    return IO.read_feature_files(spark, folder, ["reg", "car_13"])


def _blend_sql_ctes(rerank: bool) -> list[str]:
    wide = ", ".join(f"max(case when model = '{m}' then pct end) as p_{m}" for m in BLEND_W)
    total = " + ".join(f"{w} * p_{m}" for m, w in BLEND_W.items())
    ctes = [f"sc as ({_PSEUDO_SQL})",
            f"rk as (select id, model, split, {O.pct_rank_sql('score', ['model', 'split'])} as pct from sc "
            f"where score is not null)",
            f"wd as (select id, split, {wide} from rk group by id, split)",
            f"bl as (select id, split, {total} as score from wd)"]
    if rerank:
        ctes.append(f"rr as (select id, split, {O.pct_rank_sql('score', ['split'])} as target from bl)")
    return ctes


@query("snk_csv", O.with_ctes("select id, target from rr where split = 'test'",
                              *_blend_sql_ctes(True)))
def q_snk_csv(spark, sf_dir):
    """Write the re-ranked blend of the test rows as an ``id,target`` CSV and read it back."""
    sc = pseudo_scores(base(spark, sf_dir))
    sub = BL.blend(sc, BLEND_W, rerank=True).where(F.col("split") == "test")
    path = scratch_dir(spark, "submission")
    IO.write_csv(sub.select("id", "target"), path)
    return IO.read_csv(spark, path, schema="id bigint, target double")


def _stat_sql_select(t: str, g: str, src: str = "base") -> str:
    """Stats table of target t by group g (six statistics, reference semantics)."""
    n = lambda s: f'"{FE.stat_name(t, g, s)}"'
    return (f"select {g}, count(*) as {n('size')}, avg(cast({t} as double)) as {n('mean')}, "
            f"coalesce(stddev_samp(cast({t} as double)), 0) as {n('std')}, "
            f"median(cast({t} as double)) as {n('median')}, max(cast({t} as double)) as {n('max')}, "
            f"min(cast({t} as double)) as {n('min')} from {src} where {g} is not null group by {g}")


def _grid_sql(targets, groups, keep=("id", "split")) -> str:
    ctes, sels, joins = [], [], []
    seen = []
    for g in groups:
        if g not in seen:
            seen.append(g)
    for i, g in enumerate(seen):
        ts = [t for t in targets if t != g]
        n = lambda t, s: f'"{FE.stat_name(t, g, s)}"'
        aggs = ", ".join(
            f"avg(cast({t} as double)) {n(t, 'mean')}, coalesce(stddev_samp(cast({t} as double)), 0) {n(t, 'std')}, "
            f"median(cast({t} as double)) {n(t, 'median')}, max(cast({t} as double)) {n(t, 'max')}, "
            f"min(cast({t} as double)) {n(t, 'min')}" for t in ts)
        ctes.append(f"g{i} as (select {g}, count(*) as _size, {aggs} from base where {g} is not null group by {g})")
        joins.append(f"left join g{i} on g{i}.{g} = b.{g}")
        for t in ts:
            for s in FE.STATS:
                col = f"g{i}._size" if s == "size" else f"g{i}.{n(t, s)}"
                sels.append(f"{col if s == 'size' else O.r6(col)} as {n(t, s)}")
    body = (f"select {', '.join('b.' + k for k in keep)}, {', '.join(sels)} from base b " + " ".join(joins))
    return O.with_ctes(body, *ctes)


@query("snk_feature_block", _grid_sql(["f_reg_03"], ["f_ind_03"]))
def q_snk_feature_block(spark, sf_dir):
    """Write a group-statistic block partitioned by split; read both parts back."""
    b = base(spark, sf_dir)
    blk = FE.group_stats(b, "f_reg_03", "f_ind_03").drop(*[c for c in b.columns if c not in ("id", "split")])
    path = scratch_dir(spark, "statblock")
    IO.write_feature_block(round_doubles(blk), path)
    return IO.read_feature_block(spark, path).select("id", "split", *[c for c in blk.columns if "__" in c])


def _bag_models_sql(seeds, frac=0.9) -> list[str]:
    ctes = [f"pl as (select * from planted where split = 'train')",
            f"fo as (select *, {O.fold_sql('target')} as fold from pl)"]
    for s in seeds:
        ctes.append(O.ols_fold_models(f"m{s}", "fo", "f_reg_03", "target", sub_seed=s, frac=frac))
    return ctes


CHECKPOINT_SEEDS = list(range(8))


@query("snk_checkpoint_pred", O.with_ctes(
    "select id, split, seed, " + O.pct_rank_sql("sc", ["split", "seed"]) + " as score from (select id, split, seed, " +
    O.r6("avg(sc) over (partition by id order by seed rows between unbounded preceding and current row)") + " as sc from (" +
    " union all ".join(
        f"select t.id, 'test' as split, {s} as seed, avg(m.a + m.b * t.f_reg_03) as sc from planted t, m{s} m where t.split = 'test' "
        f"group by t.id union all select fo.id, 'train' as split, {s} as seed, m.a + m.b * fo.f_reg_03 as sc from fo join m{s} m "
        f"on m.k = fo.fold" for s in CHECKPOINT_SEEDS) + ") x) y",
    O.PLANTED_CTE, *_bag_models_sql(CHECKPOINT_SEEDS)))
def q_snk_checkpoint_pred(spark, sf_dir):
    """After each seed overwrite only partition seed=s of the out-of-fold and the test file with the ranked running mean."""
    b = planted_label(base(spark, sf_dir))
    tr = materialize(CF.stratified_folds(train_of(b)), "cv_train")
    te = materialize(b.where(F.col("split") == "test"), "cv_test")
    run = SeedRun(spark, scratch_dir(spark, "interim"))

    def scores(s: int) -> dict[str, DataFrame]:
        sc = CF.ols_crossfit_seeds(tr, "f_reg_03", "target", [s], subsample=0.9, test=te)
        return {"train": sc.where(F.col("split") == "train").select("id", "score"), "test": CF.test_average(sc).select("id", "score")}

    paths = run.through(CHECKPOINT_SEEDS, scores, lambda total, n: OR.pct_rank(
        total.select("id", r6(F.col("score") / F.lit(float(n))).alias("mean")), "mean", out="score").select("id", "score"))
    both = [spark.read.parquet(path).select("id", F.lit(split).alias("split"), "seed", "score") for split, path in paths.items()]
    return both[0].unionByName(both[1])


# ============================================================ 2.2 projections and filters

@query("proj_drop", O.with_ctes(f"select split, {_cols(O.FEATURES)} from base"))
def q_proj_drop(spark, sf_dir):
    """Drop id and target."""
    return base(spark, sf_dir).drop("id", "target")


@query("proj_select_roles", O.with_ctes(f"select id, {_cols(NUM)} from base"))
def q_proj_select_roles(spark, sf_dir):
    """Numeric block by role: not categorical, not calc."""
    b = base(spark, sf_dir)
    return b.select("id", *FeatureRoles.of(b).num)


def _level(c):
    roles = FeatureRoles(tuple(_DTYPES), {k: T.DoubleType() if v == "double" else T.IntegerType()
                                          for k, v in _DTYPES.items()})
    return roles.level(c)


@query("meta_feature_profile", O.with_ctes(" union all ".join(
    f"select '{c}' as varname, '{_level(c)}' as level, {str(c != 'id').lower()} as keep, '{_DTYPES[c]}' as dtype, "
    f"cast(sum(case when {O.sentinel(c)} then 1 else 0 end) as bigint) as n_missing, "
    f"count(distinct {c}) as n_distinct from base" for c in ["id", "target"] + O.FEATURES)))
def q_meta_feature_profile(spark, sf_dir):
    """Variable metadata (level, keep, dtype) plus missing and distinct counts; distinct values are
    counted per unpivoted column."""
    b = base(spark, sf_dir).drop("split")
    roles = FeatureRoles.of(b, keys=())
    cols = b.columns
    one = b.agg(*[F.sum(RW.is_sentinel(b, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    missing = one.selectExpr(f"stack({len(cols)}, {stack}) as (varname, n_missing)")
    long = missing.join(distinct_counts(b, cols).withColumnRenamed("column", "varname"), "varname")
    meta = spark.createDataFrame(
        [(c, roles.level(c), c != "id", b.schema[c].dataType.simpleString()) for c in cols],
        "varname string, level string, keep boolean, dtype string")
    return meta.join(long, "varname").select("varname", "level", "keep", "dtype",
                                             F.coalesce("n_missing", F.lit(0)).alias("n_missing"), "n_distinct")


@query("flt_split", O.with_ctes("select * from base where split = 'train'"))
def q_flt_split(spark, sf_dir):
    """Train rows of the combined table."""
    return train_of(base(spark, sf_dir))


@query("flt_fold", O.with_ctes(
    "select id, target, fold from (select id, target, " + O.fold_sql("target") +
    " as fold from base where split = 'train') x where fold <> 0"))
def q_flt_fold(spark, sf_dir):
    """Training part of fold 0: every train row outside fold 0."""
    tr = CF.stratified_folds(train_of(base(spark, sf_dir)))
    return tr.where(F.col("fold") != 0).select("id", "target", "fold")


@query("proj_sentinel_to_null", O.with_ctes(
    "select id, split, target, " + ", ".join(
        f"case when {O.sentinel(c)} then null else {c} end as {c}" for c in O.FEATURES) + " from base"))
def q_proj_sentinel_to_null(spark, sf_dir):
    """-1 (or '-1') becomes NULL in every feature column."""
    b = base(spark, sf_dir)
    return RW.sentinel_to_null(b, O.FEATURES)


_INTER = GRID_TARGETS


def _inter_names():
    from itertools import combinations
    out = []
    for e, _ in enumerate(combinations(_INTER, 2)):
        out += [f"inter_{e}_mul", f"inter_{e}_div"]
    return out


def _spark_interactions(b: DataFrame) -> list:
    return RW.all_pair_interactions(_INTER)


def _sql_interactions(wrap=lambda e: e) -> list[str]:
    from itertools import combinations
    out = []
    for e, (x, y) in enumerate(combinations(_INTER, 2)):
        out.append(f"{O.r6(wrap(f'cast({x} as double) * cast({y} as double)'))} as inter_{e}_mul")
        out.append(f"{O.r6(wrap(O.div(x, y)))} as inter_{e}_div")
    return out


@query("proj_nonfinite_to_zero", O.with_ctes(
    "select id, " + ", ".join([f"{O.r6(O.nonfinite0(f'cast({c} as double)'))} as {c}" for c in NUM] +
                              _sql_interactions(O.nonfinite0)) + " from base"))
def q_proj_nonfinite_to_zero(spark, sf_dir):
    """Numeric block plus interactions with NaN/inf/NULL replaced by 0."""
    b = base(spark, sf_dir)
    x = b.select("id", *NUM, *_spark_interactions(b))
    return x.select("id", *[r6(RW.nonfinite_to_zero(c)).alias(c) for c in x.columns if c != "id"])


_RECODE = ["f_ind_01", "f_ind_02_cat", "f_reg_02_cat"]


@query("proj_recode_negative", O.with_ctes(
    "select id, " + ", ".join(f"case when {c} < 0 then 99 else {c} end as {c}" for c in _RECODE) + " from base"))
def q_proj_recode_negative(spark, sf_dir):
    """Negative codes become 99."""
    return base(spark, sf_dir).select("id", *[RW.recode_negative(c) for c in _RECODE])


@query("proj_overlay_column", O.with_ctes(
    "select b.id, coalesce(r.f_reg_03, b.f_reg_03) as f_reg_03 from base b left join "
    "(select id, abs(f_reg_03) as f_reg_03 from base where split = 'train') r on r.id = b.id"))
def q_proj_overlay_column(spark, sf_dir):
    """Overlay f_reg_03 with an externally repaired version that covers the train rows only."""
    b = base(spark, sf_dir)
    repaired = train_of(b).select("id", F.abs("f_reg_03").alias("f_reg_03"))
    return FE.overlay_column(b.select("id", "f_reg_03"), repaired, "f_reg_03")


_HSTACK_COLS = NUM + [f"{c}_count" for c in CATS]


@query("proj_hstack", O.with_ctes(
    "select b.id, " + str(len(_HSTACK_COLS)) + " as vec_size, " + O.r6(" + ".join(
        [f"cast(b.{c} as double)" for c in NUM] + [f"cast(k{i}.n as double)" for i in range(len(CATS))])) +
    " as vec_sum from base b " + " ".join(
        f"left join (select {c}, count(*) n from base group by {c}) k{i} on k{i}.{c} = b.{c}"
        for i, c in enumerate(CATS))))
def q_proj_hstack(spark, sf_dir):
    """Assemble numeric block + count features into one vector column; report its size and sum."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    b = base(spark, sf_dir)
    x = FE.value_counts(b, CATS)
    v = VectorAssembler(inputCols=_HSTACK_COLS, outputCol="features", handleInvalid="error").transform(x)
    arr = vector_to_array("features")
    return v.select("id", F.size(arr).alias("vec_size"),
                    r6(F.aggregate(arr, F.lit(0.0), lambda a, e: a + e)).alias("vec_sum"))


# ============================================================ 2.3 row-wise features

@query("row_missing_count", O.with_ctes(f"select id, {O.missing_sql()} as missing from base"))
def q_row_missing_count(spark, sf_dir):
    """Per-row number of -1 values over all features, as double."""
    b = base(spark, sf_dir)
    return b.select("id", RW.missing_count(b, O.FEATURES).alias("missing"))


@query("row_null_count", O.with_ctes(
    "select id, cast(" + " + ".join(f"(case when {O.sentinel(c)} then 1 else 0 end)" for c in O.FEATURES) +
    " as int) as num_na from base"))
def q_row_null_count(spark, sf_dir):
    """-1 -> NULL first, then per-row NULL count."""
    b = RW.sentinel_to_null(base(spark, sf_dir), O.FEATURES)
    return b.select("id", RW.null_count(b, O.FEATURES).alias("num_na"))


@query("interact_mul", O.with_ctes(
    f"select id, {O.r6('cast(f_car_13 as double) * cast(f_ind_03 as double)')} as inter_0_mul from base"))
def q_interact_mul(spark, sf_dir):
    """f_car_13 * f_ind_03."""
    b = base(spark, sf_dir)
    mul = RW.interaction_cols("f_car_13", "f_ind_03", 0)[0]
    return b.select("id", r6(mul).alias("inter_0_mul"))


@query("interact_div", O.with_ctes(f"select id, {O.r6(O.div('f_reg_01', 'f_car_13'))} as inter_div from base"))
def q_interact_div(spark, sf_dir):
    """f_reg_01 / f_car_13 with NULL for a zero divisor (both columns hold zeros)."""
    b = base(spark, sf_dir)
    return b.select("id", r6(RW.interaction_cols("f_reg_01", "f_car_13", 0)[1]).alias("inter_div"))


@query("interact_all_pairs", O.with_ctes("select id, " + ", ".join(_sql_interactions()) + " from base"))
def q_interact_all_pairs(spark, sf_dir):
    """All 15 unordered pairs of the six interaction columns -> 30 columns."""
    b = base(spark, sf_dir)
    return round_doubles(b.select("id", *_spark_interactions(b)))


# Decimal texts of doubles differ between engines, so the key of a family is compared with whole-number
# members as text and fractional ones as hundredths.
def _key_form(c: str) -> str:
    return f"cast(cast(floor({c} * 100 + 0.5) as bigint) as string)" if _DTYPES[c] == "double" else c


def _key_sql(cols) -> str:
    return " || '_' || ".join(f"cast({_key_form(c).replace('as string', 'as varchar')} as varchar)" for c in cols)


@query("composite_key", lambda: O.with_ctes(
    "select id, " + ", ".join(f"{_key_sql(cs)} as new_{f}" for f, cs in FAMILIES.items()) + " from base"))
def q_composite_key(spark, sf_dir):
    """String forms of every family's members joined with '_' (doubles in hundredths)."""
    b = base(spark, sf_dir)
    x = b.select("id", *[F.expr(_key_form(c)).alias(c) for c in O.FEATURES])
    return x.select("id", *[RW.composite_key(cs).alias(f"new_{f}") for f, cs in FAMILIES.items()])


# ============================================================ 2.4 joins

_LS = ("f_reg_03", "f_reg_02_cat")


@query("join_left_stats", O.with_ctes(
    "select b.id, b.f_reg_02_cat, " + ", ".join(
        (f's."{FE.stat_name(*_LS, k)}"' if k == "size" else O.r6(f's."{FE.stat_name(*_LS, k)}"')) + f' as "{FE.stat_name(*_LS, k)}"'
        for k in FE.STATS) + " from base b left join s on s.f_reg_02_cat = b.f_reg_02_cat",
    "tr as (select * from base where split = 'train')", "s as (" + _stat_sql_select(*_LS, src="tr") + ")"))
def q_join_left_stats(spark, sf_dir):
    """Six statistics fitted per group on the train rows, applied to every row."""
    b = base(spark, sf_dir)
    fitted = FE.fit_group_stats(train_of(b), FE.grid_pairs(_LS[:1], _LS[1:]))
    return round_doubles(fitted.transform(b.select("id", "f_reg_02_cat")))


@query("join_inner_stats", O.with_ctes(
    "select f_ind_03, " + ", ".join(
        (f'"{FE.stat_name("f_car_15", "f_ind_03", s)}"' if s == "size" else
         f'{O.r6(chr(34) + FE.stat_name("f_car_15", "f_ind_03", s) + chr(34))} as "{FE.stat_name("f_car_15", "f_ind_03", s)}"')
        for s in FE.STATS) + " from (" + _stat_sql_select("f_car_15", "f_ind_03") + ") x"))
def q_join_inner_stats(spark, sf_dir):
    """Per-group table of size, mean, std, median, max, min (the chained inner joins, fused into one
    aggregation plus the exact-median table joined on the group key)."""
    b = base(spark, sf_dir)
    return round_doubles(FE.group_stats_table(b, "f_ind_03", ["f_car_15"]))


@query("join_map_lookup", O.with_ctes(
    "select b.id, b.f_car_01_cat, coalesce(d.n, 0) as f_car_01_cat_count from base b left join "
    "(select f_car_01_cat, count(*) n from base where split = 'train' group by f_car_01_cat) d "
    "on d.f_car_01_cat = b.f_car_01_cat"))
def q_join_map_lookup(spark, sf_dir):
    """Dictionary lookup with default 0: counts fitted on train rows, looked up for all rows."""
    b = base(spark, sf_dir)
    return FE.value_counts(b.select("id", "f_car_01_cat"), ["f_car_01_cat"], fit_df=train_of(b))


@query("join_predictions", O.with_ctes(
    "select b.id, b.split, " + ", ".join(f"cast({c} as double) as {m}" for m, c in PSEUDO_MODELS.items()) + " from base b"))
def q_join_predictions(spark, sf_dir):
    """Member scores side by side on id; the job fails if a member misses an id."""
    return BL.join_members(pseudo_scores(base(spark, sf_dir)), PSEUDO)


# ============================================================ 2.5 aggregations

@query("agg_value_counts", O.with_ctes(
    "select b.id, " + ", ".join(f"coalesce(k{i}.n, 0) as {c}_count" for i, c in enumerate(CATS)) + " from base b " +
    " ".join(f"left join (select {c}, count(*) n from base group by {c}) k{i} on k{i}.{c} = b.{c}"
             for i, c in enumerate(CATS))))
def q_agg_value_counts(spark, sf_dir):
    """Frequency of each categorical value over train+test, mapped back to every row."""
    b = materialize(base(spark, sf_dir).select("id", *CATS), "wide")
    return FE.value_counts(b, CATS).select("id", *[f"{c}_count" for c in CATS])


def _composite_sql() -> list[str]:
    return [f"k_{f} as (select {_cols(cs)}, count(*) n from base group by {_cols(cs)})" for f, cs in FAMILIES.items()]


def _composite_joins() -> str:
    return " ".join(f"join k_{f} on " + " and ".join(f"k_{f}.{c} = b.{c}" for c in cs) for f, cs in FAMILIES.items())


@query("agg_composite_counts", O.with_ctes(
    "select b.id, " + ", ".join(f"k_{f}.n as new_{f}_count" for f in FAMILIES) + f" from base b {_composite_joins()}", *_composite_sql()))
def q_agg_composite_counts(spark, sf_dir):
    """Frequency of each family's combination, grouped on the columns (null-safe join back)."""
    b = materialize(base(spark, sf_dir), "wide")
    out = b
    for f, cs in FAMILIES.items():
        out = FE.composite_counts(out, cs, f"new_{f}_count", fit_df=b)
    return out.select("id", *[f"new_{f}_count" for f in FAMILIES])


@query("agg_cat_size", O.with_ctes(
    "select b.id, " + ", ".join(f"k{i}.n as {c}_size" for i, c in enumerate(CATS)) + " from base b " +
    " ".join(f"left join (select {c}, count(*) n from base group by {c}) k{i} on k{i}.{c} = b.{c}"
             for i, c in enumerate(CATS))))
def q_agg_cat_size(spark, sf_dir):
    """Group size per categorical value via groupby-size and left join."""
    b = base(spark, sf_dir)
    return FE.cat_size(b, CATS).select("id", *[f"{c}_size" for c in CATS])


@query("agg_group_stats", _grid_sql(["f_reg_03"], ["f_ind_03"]))
def q_agg_group_stats(spark, sf_dir):
    """Size, mean, std, median, max, min of f_reg_03 per f_ind_03, joined back to every row."""
    b = base(spark, sf_dir)
    out = FE.group_stats(b, "f_reg_03", "f_ind_03")
    return round_doubles(out.select("id", "split", *[c for c in out.columns if "__" in c]))


@query("agg_group_stats_grid", _grid_sql(GRID_TARGETS, GRID_GROUPS))
def q_agg_group_stats_grid(spark, sf_dir):
    """6 targets x 7 groups (t != g): 36 pairs x 6 statistics, fused into one aggregation per group."""
    b = base(spark, sf_dir)
    out = FE.group_stats_grid(b, GRID_TARGETS, GRID_GROUPS, each=_rounded_stats)
    return out.select("id", "split", *[c for c in out.columns if "__" in c])


_WIDE_GROUPS = GRID_GROUPS + [c for c in CATS if c not in GRID_GROUPS] + ["f_ind_02_cat"]


@query("agg_group_stats_wide_grid", _grid_sql(GRID_TARGETS, _WIDE_GROUPS))
def q_agg_group_stats_wide_grid(spark, sf_dir):
    """Grid over the ordered, de-duplicated union of the group list and all categoricals."""
    b = base(spark, sf_dir)
    out = FE.group_stats_grid(b, GRID_TARGETS, _WIDE_GROUPS, each=_rounded_stats)
    return out.select("id", "split", *[c for c in out.columns if "__" in c])


@query("agg_nunique", O.with_ctes(
    "select " + ", ".join(f"(select count(*) from (select distinct {_cols(cs)} from base) d) as new_{f}_nunique"
                          for f, cs in FAMILIES.items()) + ", " +
    ", ".join(f"(select count(distinct {c}) from base) as {c}_nunique" for c in CATS)))
def q_agg_nunique(spark, sf_dir):
    """Distinct count of every family's composite key and of every categorical."""
    return FE.nunique(base(spark, sf_dir), CATS, {f"new_{f}": cs for f, cs in FAMILIES.items()})


@query("agg_label_max", O.with_ctes(
    "select " + ", ".join(f"cast(count(distinct {c}) - 1 as int) as {c}_max" for c in CATS) + " from base"))
def q_agg_label_max(spark, sf_dir):
    """Largest label code per categorical, read from the fitted categories (train+test)."""
    return fit_categories(base(spark, sf_dir), CATS).largest_codes()


@query("agg_mean_median_std", O.with_ctes(
    "select split, " + O.r6("avg(f_ind_01)") + " as mean, " + O.r6("median(cast(f_ind_01 as double))") +
    " as median, " + O.r6("stddev_pop(f_ind_01)") + " as std from base group by split"))
def q_agg_mean_median_std(spark, sf_dir):
    """Mean, exact median and population std of a count column per split."""
    b = base(spark, sf_dir)
    st = b.groupBy("split").agg(F.avg("f_ind_01").alias("mean"), F.stddev_pop("f_ind_01").alias("std"))
    med = FE.exact_group_medians(b, "split", ["f_ind_01"]).withColumnRenamed(
        FE.stat_name("f_ind_01", "split", "median"), "median")
    return round_doubles(st.join(med, "split").select("split", "mean", "median", "std"))


# ============================================================ 2.6 windows, ranking, order

@query("win_rank_pct", O.with_ctes(f"select id, {O.pct_rank_sql('f_reg_03')} as pct from base"))
def q_win_rank_pct(spark, sf_dir):
    """Average-tie percentile rank of f_reg_03 over all rows."""
    b = base(spark, sf_dir).select("id", "f_reg_03")
    return OR.pct_rank(b, "f_reg_03", out="pct").select("id", "pct")


@query("win_rank_pct_by_fold", O.with_ctes(
    f"select id, fold, {O.pct_rank_sql('f_car_15', ['fold'])} as pct from "
    f"(select id, f_car_15, {O.fold_sql('target')} as fold from base where split = 'train') x"))
def q_win_rank_pct_by_fold(spark, sf_dir):
    """Percentile rank of a score within each validation fold."""
    tr = CF.stratified_folds(train_of(base(spark, sf_dir)))
    return OR.pct_rank(tr.select("id", "fold", "f_car_15"), "f_car_15", by=["fold"], out="pct").select(
        "id", "fold", "pct")


@query("win_rank_column", O.with_ctes(f"select id, {O.pct_rank_sql('f_ind_15')} as f_ind_15 from base"))
def q_win_rank_column(spark, sf_dir):
    """Replace a heavily tied column by its percentile rank, in place."""
    b = base(spark, sf_dir).select("id", "f_ind_15")
    r = OR.pct_rank(b, "f_ind_15", out="_r")
    return r.select("id", F.col("_r").alias("f_ind_15"))


@query("win_lorenz", O.with_ctes(
    "select f_reg_03, " + O.r6("cr") + " as cum_share_rows, " + O.r6("cl") + " as cum_share_label, " +
    O.r6("cr - cl") + " as diag_gap from (select f_reg_03, "
    "sum(c) over (order by f_reg_03 desc rows between unbounded preceding and current row) / sum(c) over () as cr, "
    "sum(y) over (order by f_reg_03 desc rows between unbounded preceding and current row) / sum(y) over () as cl "
    "from (select f_reg_03, count(*) c, sum(cast(target as double)) y from planted where split = 'train' "
    "group by f_reg_03) d) x", O.PLANTED_CTE))
def q_win_lorenz(spark, sf_dir):
    """Lorenz curve of the label in descending f_reg_03 order (train rows, planted label)."""
    tr = train_of(planted_label(base(spark, sf_dir)))
    return round_doubles(OR.lorenz(tr, "target", "f_reg_03"))


@query("win_row_id", O.with_ctes("select id, row_number() over (order by id) - 1 as row_id from base"))
def q_win_row_id(spark, sf_dir):
    """0-based row number in id order."""
    b = base(spark, sf_dir).select("id")
    return OR.row_number_by(b, "id").select("id", "row_id")


@query("srt_by_key", O.with_ctes("select id, target from base order by id"))
def q_srt_by_key(spark, sf_dir):
    """Rows sorted by id (a sink-side order)."""
    return base(spark, sf_dir).select("id", "target").orderBy("id")


@query("lim_head", O.with_ctes("select id, split, f_reg_03 from base order by id limit 5"))
def q_lim_head(spark, sf_dir):
    """First five rows in id order (the limit is the operator)."""
    return base(spark, sf_dir).select("id", "split", "f_reg_03").orderBy("id").limit(5)


# ============================================================ 2.7 set operations

@query("set_union_all", O.with_ctes(
    "select id, split, f_reg_03, target from base where split = 'train' union all "
    "select id, split, f_reg_03, null as target from base where split = 'test'"))
def q_set_union_all(spark, sf_dir):
    """Append the unlabelled rows (no target column) below the labelled rows, by column name."""
    b = base(spark, sf_dir)
    tr = train_of(b).select("id", "split", "f_reg_03", "target")
    te = b.where(F.col("split") == "test").select("id", "split", "f_reg_03")
    return tr.unionByName(te, allowMissingColumns=True)


# ============================================================ 2.8 encoders, scaling, selection

def _code_sql(c: str, fit_where: str = "true", keep_unseen: bool = False) -> tuple[str, str]:
    """(cte, expression) for the sorted-order label code of c."""
    cte = (f"c_{c} as (select {c} as v, cast(row_number() over (order by {c}) - 1 as int) as code "
           f"from (select distinct {c} from base where {fit_where} and {c} is not null) d)")
    expr = (f"coalesce((select code from c_{c} where v = b.{c}), (select cast(count(*) as int) from c_{c}))"
            if keep_unseen else f"(select code from c_{c} where v = b.{c})")
    return cte, expr


def _codes_query(fit_where: str, keep_unseen: bool) -> str:
    parts = [_code_sql(c, fit_where, keep_unseen) for c in CATS]
    return O.with_ctes("select b.id, " + ", ".join(f"{e} as {c}" for (_, e), c in zip(parts, CATS)) +
                       " from base b", *[p[0] for p in parts])


@query("enc_label_union", _codes_query("true", False))
def q_enc_label_union(spark, sf_dir):
    """Label codes 0..k-1 in sorted value order, fitted on train+test."""
    b = base(spark, sf_dir)
    return EN.label_encode(b, CATS).select("id", *CATS)


@query("enc_label_train", _codes_query("split = 'train'", True))
def q_enc_label_train(spark, sf_dir):
    """Label codes fitted on train rows only; a value unseen in train gets code k."""
    b = base(spark, sf_dir)
    return EN.label_encode(b, CATS, fit_df=train_of(b), unseen="keep").select("id", *CATS)


def _onehot_sql(fit_where: str, keep_unseen: bool) -> str:
    parts = [_code_sql(c, fit_where, keep_unseen) for c in CATS]
    ctes = [p[0] for p in parts]
    extra = 1 if keep_unseen else 0
    sizes = [f"((select count(*) from c_{c}) + {extra})" for c in CATS]
    sel = []
    for i, ((_, e), c) in enumerate(zip(parts, CATS)):
        off = " + ".join(sizes[:i]) if i else "0"
        sel.append(f"select b.id, cast({off} + {e} as int) as slot from base b")
    return O.with_ctes("select id, slot, 1.0 as value from (" + " union all ".join(sel) + ") x", *ctes)


@query("enc_onehot_union", _onehot_sql("true", False))
def q_enc_onehot_union(spark, sf_dir):
    """Sparse one-hot vector of all categoricals (fit on train+test), as (id, slot, value) triples."""
    b = base(spark, sf_dir)
    v = EN.onehot(b, CATS, unseen="error")
    return EN.vector_slots(v, "onehot").select("id", F.col("slot").cast("int").alias("slot"), "value")


@query("enc_onehot_train", _onehot_sql("split = 'train'", True))
def q_enc_onehot_train(spark, sf_dir):
    """One-hot fitted on train rows; unseen test values fall into one extra slot per column."""
    b = base(spark, sf_dir)
    v = EN.onehot(b, CATS, fit_df=train_of(b), unseen="keep")
    return EN.vector_slots(v, "onehot").select("id", F.col("slot").cast("int").alias("slot"), "value")


@query("scl_standard", O.with_ctes(
    "select b.id, " + ", ".join(
        f"{O.r6(f'(cast(b.{c} as double) - s.m{i}) / (case when s.s{i} = 0 or s.s{i} is null then 1 else s.s{i} end)')}"
        f" as {c}" for i, c in enumerate(NUM)) + " from base b, (select " +
    ", ".join(f"avg(cast({c} as double)) m{i}, stddev_pop(cast({c} as double)) s{i}" for i, c in enumerate(NUM)) +
    " from base) s"))
def q_scl_standard(spark, sf_dir):
    """(x - mean) / population std of the numeric block, fitted on train+test."""
    b = base(spark, sf_dir)
    return round_doubles(EN.standard_scale(b.select("id", *NUM), NUM))


def _fclassif_sql() -> str:
    rows = []
    for i, c in enumerate(NUM):
        x = f"cast({c} as double)"
        rows.append(
            f"select '{c}' as feature, {i} as pos, case when sw = 0 then null else (sb / (k - 1)) / (sw / (n - k)) "
            f"end as f_value from (select sum(a.nk * (a.mk - t.mt) * (a.mk - t.mt)) sb, sum(a.wk) sw, sum(a.nk) n, "
            f"count(*) k from (select target, count(*) nk, avg({x}) mk, var_pop({x}) * count(*) wk from base "
            f"where split = 'train' group by target) a, (select avg({x}) mt from base where split = 'train') t) q")
    return O.with_ctes(
        "select feature, " + O.r6("f_value", 4) + " as f_value, row_number() over (order by "
        "case when f_value is null or isnan(f_value) then 1 else 0 end, f_value desc, pos) <= "
        f"{int(len(NUM) * 0.75)} as keep from (" + " union all ".join(rows) + ") f")


@query("sel_f_classif", _fclassif_sql())
def q_sel_f_classif(spark, sf_dir):
    """ANOVA F of every numeric feature against the label (train rows); keep the top 75 %."""
    tr = train_of(base(spark, sf_dir))
    sc = EN.select_percentile(EN.f_classif(tr, "target", NUM), 75.0)
    return sc.select("feature", r6("f_value", 4).alias("f_value"), "keep")


def _slot_ctes() -> list[str]:
    """sl (slot, feature, column, value, n) of every one-hot slot, cls (rows of each class), st (slot, f_value, ...) of the whole block."""
    sizes = [f"(select count(distinct {c}) from base)" for c in CATS]
    slots = [f"select {len(NUM)} + " + "".join(f"{k} + " for k in sizes[:i]) + f"row_number() over (order by v) - 1 as slot, '{c}=' || cast(v as varchar) as feature, "
             f"'{c}' as col, cast(v as varchar) as v, n from (select {c} v, count(*) n from base where {c} is not null group by {c}) d" for i, c in enumerate(CATS)]
    held = [f"select '{c}' as col, cast({c} as varchar) as v, target, count(*) c from base where split = 'train' group by {c}, target" for c in CATS]
    return ["sl as (" + " union all ".join(slots) + ")", "held as (" + " union all ".join(held) + ")",
            "cls as (select target, cast(count(*) as double) nk from base where split = 'train' group by target)",
            "tot as (select sum(nk) n, count(*) k from cls)",
            "mk as (select sl.slot, sl.feature, cls.nk, coalesce(h.c, 0) / cls.nk as m from sl cross join cls "
            "left join held h on h.col = sl.col and h.v = sl.v and h.target = cls.target)",
            "mt as (select slot, sum(nk * m) / sum(nk) as mean from mk group by slot)",
            "sf as (select mk.slot, mk.feature, sum(nk * (m - mean) * (m - mean)) sb, sum(nk * m * (1 - m)) sw from mk join mt on mt.slot = mk.slot group by mk.slot, mk.feature)"]


@query("sel_f_classif_slots", O.with_ctes(
    "select cast(slot as bigint) as slot, feature, case when not isinf(f) then " + O.r6("f", 4) + " end as f_value, coalesce(isinf(f), false) as separates, "
    "row_number() over (order by case when f is null then 1 else 0 end, f desc, slot) <= floor((select count(*) from al) * 0.75) as keep from al",
    *_slot_ctes(),
    "de as (" + " union all ".join(
        f"select {i} as slot, '{c}' as feature, sum(nk * (a - t) * (a - t)) sb, sum(nk * w) sw from (select target, cast(count(*) as double) nk, avg(cast({c} as double)) a, "
        f"var_pop(cast({c} as double)) w from base where split = 'train' group by target) g, (select avg(cast({c} as double)) t from base where split = 'train') m"
        for i, c in enumerate(NUM)) + ")",
    "al as (select slot, feature, case when sw = 0 and sb = 0 then null when sw = 0 then cast('infinity' as double) else (sb / (k - 1)) / (sw / (n - k)) end as f "
    "from (select * from de union all select * from sf) x, tot)"))
def q_sel_f_classif_slots(spark, sf_dir):
    """ANOVA F of every numeric column and every one-hot slot against the label (train rows), and the best 75 % of them all."""
    table = SL.fit_slots(base(spark, sf_dir), NUM, CATS, "target", 75.0).table
    infinite = F.col("f_value") == F.lit(float("inf"))
    return table.select("slot", "feature", F.when(~infinite, r6("f_value", 4)).alias("f_value"), F.coalesce(infinite, F.lit(False)).alias("separates"), "keep")


@query("scl_standard_slots", O.with_ctes(
    "select id, cast(slot as bigint) as slot, " + O.r6("value") + " as value, " + O.r6("shift") + " as shift from (" + " union all ".join(
        [f"select b.id, {i} as slot, (cast(b.{c} as double) - s.m) / (case when s.s = 0 then 1 else s.s end) as value, 0.0::double as shift from base b, "
         f"(select avg(cast({c} as double)) m, stddev_pop(cast({c} as double)) s from base) s" for i, c in enumerate(NUM)] +
        [f"select b.id, w.slot, w.scale as value, w.shift from base b join w on w.col = '{c}' and w.v = cast(b.{c} as varchar)" for c in CATS]) + ") x",
    *_slot_ctes(),
    "p as (select col, v, slot, n / cast((select count(*) from base) as double) as p from sl)",
    "w as (select col, v, slot, case when p < 1 then 1 / sqrt(p * (1 - p)) else 1 end as scale, "
    "case when p < 1 then -p / sqrt(p * (1 - p)) else -1 end as shift from p)"))
def q_scl_standard_slots(spark, sf_dir):
    """Numeric columns and one-hot slots scaled to mean 0 and population std 1 (train+test) as sparse rows: scaled value = value + shift,
    and slots that a row does not hold have their shift alone."""
    b = materialize(base(spark, sf_dir), "wide")
    return round_doubles(SL.fit_slots(b, NUM, CATS, "target").entries(b, selected=False))


_SPEARMAN = [f"{c}_count" for c in CATS] + ["new_ind_count"]


@query("sta_spearman", O.with_ctes(
    " union all ".join(
        f"select '{c}' as feature, {O.r6('corr(rl, rc)')} as spearman from (select {O.pct_rank_sql('target')} as rl, "
        f"{O.pct_rank_sql(c)} as rc from cn) y" for c in _SPEARMAN),
    "cn as (select b.target, " + ", ".join(f"k{i}.n as {c}_count" for i, c in enumerate(CATS)) + ", k_ind.n as new_ind_count from base b " +
    " ".join(f"join (select {c}, count(*) n from base group by {c}) k{i} on k{i}.{c} = b.{c}" for i, c in enumerate(CATS)) +
    f" join (select {_cols(IND)}, count(*) n from base group by {_cols(IND)}) k_ind on " + " and ".join(f"k_ind.{c} = b.{c}" for c in IND) +
    " where b.split = 'train')"))
def q_sta_spearman(spark, sf_dir):
    """Spearman correlation of the label with every count feature, the composite's included (train rows)."""
    b = FE.value_counts(materialize(base(spark, sf_dir), "wide"), CATS)
    b = FE.composite_counts(b, IND, "new_ind_count")
    return round_doubles(EN.spearman_with_label(train_of(b), "target", _SPEARMAN))


# ============================================================ flagship

def _flagship_sql() -> str:
    codes = [_code_sql(c, "true", True) for c in CATS]
    grid = _grid_sql(GRID_TARGETS, GRID_GROUPS)
    body = grid[grid.rindex("\nselect b.id"):]
    ctes = grid[len(O.with_ctes("")) - 1: grid.rindex("\nselect b.id")].strip().lstrip(",")
    new = [f"{O.r6(O.missing_sql().replace('f_', 'b.f_'))} as missing", *[e.replace("cast(f_", "cast(b.f_") for e in _sql_interactions(O.nonfinite0)],
           *[f"{e} as {c}__code" for (_, e), c in zip(codes, CATS)], *[f"kc{i}.n as {c}_count" for i, c in enumerate(CATS)],
           *[f"k_{f}.n as new_{f}_count" for f in FAMILIES]]
    joins = " ".join(f"join (select {c}, count(*) n from base group by {c}) kc{i} on kc{i}.{c} = b.{c}" for i, c in enumerate(CATS))
    body = body.replace("select b.id, b.split, ", "select b.id, b.split, " + ", ".join(new) + ", ", 1)
    return O.with_ctes(body + f" {joins} {_composite_joins()}", ctes, *[c for c, _ in codes], *_composite_sql())


@query("flagship_feature_matrix", _flagship_sql)
def q_flagship_feature_matrix(spark, sf_dir):
    """The whole feature matrix of the neural-net member (all columns that it adds to the wide table)."""
    from rankfold.plans.flagship import feature_matrix
    out = feature_matrix(spark, sf_dir, each=_rounded_stats)
    stats = tuple(c for c in out.columns if "__by__" in c)
    return round_doubles(out.select("id", "split", *[c for c in out.columns if c not in ("id", "split", "target", *O.FEATURES)]), keep=stats)
