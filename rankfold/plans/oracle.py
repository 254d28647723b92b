"""Independent SQL (DuckDB dialect, also ANSI-ish) for the catalog's correctness oracle.

Written from the operator definitions, not from the Spark code: plain window
functions over the whole table, ``regr_slope``/``median``/``stddev_samp`` built-ins
and theta joins where that is the most direct statement of the semantics.
"""

from __future__ import annotations

from typing import Sequence

BASE_CTE = """li as (
  select l_orderkey, count(*) n_lines, min(l_quantity) min_qty, max(l_discount) max_disc, max(l_tax) max_tax,
         max(l_returnflag) max_rf, max(l_linestatus) max_ls, max(l_extendedprice) max_price
  from lineitem group by l_orderkey),
base as (
select o.o_orderkey as id,
  case when o.o_orderkey % 5 < 2 then 'train' else 'test' end as split,
  case when o.o_orderkey % 5 < 2 then cast(case when o.o_orderstatus='F' then 1 else 0 end as int) end as target,
  cast(coalesce(li.n_lines,-1) as int)                      as f_ind_01,
  cast(substr(o.o_orderpriority,1,1) as int)                as f_ind_02_cat,
  cast(month(o.o_orderdate) as int)                         as f_ind_03,
  c.c_mktsegment                                            as f_ind_04_cat,
  cast(case when c.c_acctbal<0 then 1 else 0 end as int)    as f_ind_06_bin,
  cast(day(o.o_orderdate) as int)                           as f_ind_15,
  cast(n.n_regionkey as double)/10                          as f_reg_01,
  c.c_nationkey                                             as f_reg_02_cat,
  c.c_acctbal                                               as f_reg_03,
  coalesce(li.max_rf,'-1')                                  as f_car_01_cat,
  coalesce(li.max_ls,'-1')                                  as f_car_02_cat,
  coalesce(li.min_qty,-1)                                   as f_car_11,
  coalesce(li.max_disc,-1)                                  as f_car_12,
  coalesce(li.max_tax,-1)                                   as f_car_13,
  coalesce(li.max_price,-1)                                 as f_car_15,
  o.o_totalprice                                            as f_calc_01
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
left join li on li.l_orderkey = o.o_orderkey)"""

PLANTED_CTE = """planted as (
  select * exclude (target),
    case when split = 'train' then cast(
      case when substr(md5(cast(id as varchar) || ':lbl'), 1, 1) < '3'
           then 1 - (case when f_reg_03 > 6000 then 1 else 0 end)
           else (case when f_reg_03 > 6000 then 1 else 0 end) end as int) end as target
  from base)"""

FEATURES = ["f_ind_01", "f_ind_02_cat", "f_ind_03", "f_ind_04_cat", "f_ind_06_bin", "f_ind_15", "f_reg_01",
            "f_reg_02_cat", "f_reg_03", "f_car_01_cat", "f_car_02_cat", "f_car_11", "f_car_12", "f_car_13",
            "f_car_15", "f_calc_01"]
STRING_FEATURES = {"f_ind_04_cat", "f_car_01_cat", "f_car_02_cat"}


def with_ctes(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"with {BASE_CTE}{extra}\n{body}"


def r6(expr: str, digits: int = 6) -> str:
    """Round for the comparison (same formula as ``catalog.r6``).

    * Precision follows magnitude: ``digits`` decimals below 1e3, two fewer below 1e6,
      four fewer above (at least 9 significant digits), so the engines' last-bit
      differences on large values cannot cross a rounding boundary.
    * Aggregates of short decimals (means of 2-decimal values over 32*k rows) often sit
      exactly on a tie, and the engines' summation orders land on opposite sides of it
      (~1e-16 apart); a relative nudge of 1e-12 moves every such tie the same way.
    * The rounding is plain IEEE arithmetic (``floor(x * 10^d + 0.5) / 10^d``), identical
      in both engines, unlike their ``round`` functions. ``+ 0.0`` turns -0.0 into 0.0.
    """
    x = f"(({expr}) + abs({expr}) * 1e-12)"

    def rd(d: int) -> str:
        return f"floor({x} * 1e{d} + 0.5) / 1e{d}"
    return (f"(case when abs({expr}) < 1e3 then {rd(digits)} when abs({expr}) < 1e6 then {rd(digits - 2)} "
            f"else {rd(max(digits - 4, 0))} end + 0.0)")


def sentinel(c: str) -> str:
    return f"{c} = '-1'" if c in STRING_FEATURES else f"{c} = -1"


def missing_sql(cols: Sequence[str] = FEATURES) -> str:
    return "cast(" + " + ".join(f"(case when {sentinel(c)} then 1 else 0 end)" for c in cols) + " as double)"


def div(a: str, b: str) -> str:
    return f"(case when cast({b} as double) = 0 then null else cast({a} as double) / cast({b} as double) end)"


def nonfinite0(e: str) -> str:
    return f"(case when {e} is null or isnan({e}) or isinf({e}) then 0.0 else {e} end)"


def pct_rank_sql(s: str, part: Sequence[str] = ()) -> str:
    """Average-tie rank / non-null count over the partition (pandas ``rank(pct=True)``)."""
    p = ", ".join(part)
    pw = f"partition by {p} " if p else ""
    pws = f"partition by {p}, {s}" if p else f"partition by {s}"
    return (f"(rank() over ({pw}order by {s}) + (count(*) over ({pws}) - 1) / 2.0) "
            f"/ count({s}) over ({pw.strip()})")


def fold_sql(label: str | None = "target", k: int = 5, seed: int = 218) -> str:
    part = f"partition by {label} " if label else ""
    return (f"cast((row_number() over ({part}order by md5(cast(id as varchar) || ':{seed}'), id) - 1) % {k} as int)")


def gini_ctes(name: str, src: str, y: str, s: str, part: Sequence[str] = ()) -> list[str]:
    """CTEs ``{name}`` with columns (part..., gini, n): tie-averaged normalized Gini, descending order."""
    p = list(part)
    pc = "".join(f"{c}, " for c in p)
    pw = f"partition by {', '.join(p)} " if p else ""
    gb = f"group by {', '.join(p)}" if p else ""
    jn = " and ".join(f"a.{c} = b.{c}" for c in p) if p else "true"

    def area(tag: str, order: str) -> list[str]:
        return [
            f"{name}_{tag}d as (select {pc}{order} as v, count(*) c, sum(cast({y} as double)) yy from {src} "
            f"where {y} is not null and {s} is not null group by {pc}{order})",
            f"{name}_{tag}p as (select {pc}c, yy, coalesce(sum(yy) over ({pw}order by v desc rows between "
            f"unbounded preceding and 1 preceding), 0) sb from {name}_{tag}d)",
            f"{name}_{tag} as (select {pc}(sum(c) + 1) / 2.0 - sum(c * sb + yy * (c + 1) / 2.0) / sum(yy) g, "
            f"sum(c) n from {name}_{tag}p {gb})",
        ]

    sel = ", ".join(f"a.{c}" for c in p)
    sel = sel + ", " if sel else ""
    return area("p", s) + area("t", y) + [
        f"{name} as (select {sel}a.g / b.g as gini, cast(a.n as bigint) as n from {name}_p a join {name}_t b on {jn})"]


def ols_fold_models(name: str, src: str, x: str, y: str, fold: str = "fold", sub_seed: int | None = None,
                    frac: float | None = None) -> str:
    """Per held-out fold f: least squares fitted on the rows of all other folds (theta join)."""
    cond = ""
    if frac is not None and frac < 1.0:
        share = f"cast(('0x' || substr(md5(cast(t.id as varchar) || ':bag:{sub_seed}'), 1, 8)) as bigint) / 4294967296.0"
        cond = f" and {share} < {frac}"
    return (f"{name} as (select f.{fold} as k, regr_slope(cast(t.{y} as double), cast(t.{x} as double)) b, "
            f"regr_intercept(cast(t.{y} as double), cast(t.{x} as double)) a "
            f"from (select distinct {fold} from {src}) f join {src} t on t.{fold} <> f.{fold}"
            f" and t.{x} is not null and t.{y} is not null{cond} group by f.{fold})")


# ---------------------------------------------------------------- solvers and boosting, unrolled

def sweep_ctes(name: str, src: str, p: int, m: int = 1, key: str = "k", keep: Sequence[str] = ()) -> list[str]:
    """Gauss-Jordan steps over the columns a_i_j (i < p, j < p + m) of ``src``; ``{name}`` has key, a_i_p.. as the solution.
    A pivot that is below 1e-9 of its first value gives weight 0."""
    more = "".join(f", {c}" for c in keep)
    ctes = [f"{name}_s as materialized (select *, " + ", ".join(f"a_{i}_{i} as d_{i}" for i in range(p)) + f" from {src})"]
    prev = f"{name}_s"
    for i in range(p):
        rest, diag = range(i + 1, p + m), "".join(f", d_{k}" for k in range(i + 1, p))
        ctes.append(f"{name}_r{i} as materialized (select *, " + ", ".join(
            f"case when a_{i}_{i} > 1e-9 * d_{i} then a_{i}_{j} / a_{i}_{i} else 0.0 end as r_{j}" for j in rest) + f" from {prev})")
        cols = [f"r_{j} as a_{k}_{j}" if k == i else f"a_{k}_{j} - a_{k}_{i} * r_{j} as a_{k}_{j}" for k in range(p) for j in rest]
        prev = f"{name}_{i}" if i < p - 1 else name
        ctes.append(f"{prev} as materialized (select {key}{more}{diag}, {', '.join(cols)} from {name}_r{i})")
    return ctes


def products_sql(terms: Sequence[str], p: int, weight: str = "1.0", ridge: float = 0.0) -> str:
    """All sums of products a_i_j of the terms; ``ridge`` is added to the diagonal, the first entry excepted."""
    out = []
    for i in range(p):
        for j in range(len(terms)):
            a, b = (i, j) if i <= j else (j, i)
            out.append(f"sum({weight} * ({terms[a]}) * ({terms[b]}))" + (f" + {ridge}" if ridge and i == j and i else "") + f" as a_{i}_{j}")
    return ", ".join(out)


def scaled_ctes(rows: str, xs: Sequence[str], src: str = "fo", out: str = "zx") -> list[str]:
    """``{out}``: id, fold, y and x_0.. (an intercept and the standardised columns) of ``rows``, scales from ``src``."""
    scale = ", ".join(f"avg(cast({x} as double)) m_{i}, coalesce(nullif(stddev_pop(cast({x} as double)), 0), 1.0) s_{i}" for i, x in enumerate(xs, 1))
    cols = ", ".join(f"(cast(t.{x} as double) - s.m_{i}) / s.s_{i} as x_{i}" for i, x in enumerate(xs, 1))
    return [f"{out}_s as materialized (select {scale} from {src})", f"{out} as materialized (select t.*, 1.0 as x_0, {cols} from ({rows}) t, {out}_s s)"]


def glm_ctes(name: str, src: str, p: int, family: str, steps: int, l2: float = 0.0, c: float = 1.0, models: str | None = None) -> list[str]:
    """Reweighted least squares of y on x_0..x_{p-1}, unrolled; ``{name}`` has k and b_0.. per model k, which learns from the other folds."""
    zero = ", ".join(f"0.0 as b_{i}" for i in range(p))
    ctes = [f"{name}_b0 as materialized (select k, {zero} from ({models or f'select distinct fold as k from {src}'}) f)"]
    for s in range(1, steps + 1):
        last = s == steps
        eta = " + ".join(f"f.b_{i} * t.x_{i}" for i in range(p))
        if family == "fair":
            held, w, z = "e", f"1.0 / (1.0 + abs(y - e) / {c})", f"y / (1.0 + abs(y - e) / {c})"
        else:
            held = "greatest(least(e, 30.0), -30.0)"
            mu = "1.0 / (1.0 + exp(-e))" if family == "binomial" else "exp(e)"
            w = "mu * (1.0 - mu)" if family == "binomial" else "mu"
            z = f"({w}) * e + (y - mu)"
        xs = ", ".join(f"x_{i}" for i in range(p))
        ctes.append(f"{name}_e{s} as materialized (select f.k, cast(t.target as double) as y, {', '.join(f't.x_{i}' for i in range(p))}, {eta} as e "
                    f"from {src} t join {name}_b{s - 1} f on t.fold <> f.k)")
        if family != "fair":
            ctes.append(f"{name}_h{s} as materialized (select * exclude (e), {held} as e, {mu.replace('(-e)', f'(-{held})').replace('exp(e)', f'exp({held})')} as mu "
                        f"from {name}_e{s})")
            source = f"{name}_h{s}"
        else:
            source = f"{name}_e{s}"
        ctes.append(f"{name}_w{s} as materialized (select k, {xs}, {w} as w, {z} as z from {source})")
        grams = products_sql([f"x_{i}" for i in range(p)], p, "w", l2)
        ctes.append(f"{name}_g{s} as materialized (select k, {grams}, {', '.join(f'sum(z * x_{i}) as a_{i}_{p}' for i in range(p))} "
                    f"from {name}_w{s} group by k)")
        ctes += sweep_ctes(f"{name}_q{s}", f"{name}_g{s}", p)
        ctes.append(f"{name if last else f'{name}_b{s}'} as materialized (select k, {', '.join(f'a_{i}_{p} as b_{i}' for i in range(p))} from {name}_q{s})")
    return ctes


def glm_score(p: int, family: str, model: str = "m", row: str = "t") -> str:
    eta = " + ".join(f"{model}.b_{i} * {row}.x_{i}" for i in range(p))
    if family == "fair":
        return f"({eta})"
    held = f"greatest(least({eta}, 30.0), -30.0)"
    return f"(1.0 / (1.0 + exp(-{held})))" if family == "binomial" else f"exp({held})"


def boost_ctes(name: str, xs: Sequence[str], at: Sequence[float], rounds: int, rate: float, seed: int, k: int = 5, src: str = "fo") -> list[str]:
    """Stump boosting of the logistic loss, unrolled: ``{name}_m{r}`` holds id, model, role, target, margin after round r."""
    cuts = [(x, t) for x in xs for t in at]
    n = len(cuts)
    scale = ", ".join(f"avg(cast({x} as double)) m_{x}, coalesce(nullif(stddev_pop(cast({x} as double)), 0), 1.0) s_{x}" for x in xs)
    flags = ", ".join(f"cast({x} as double) > c.m_{x} + ({t}) * c.s_{x}" for x, t in cuts)
    limit = f"{int(0.1875 * 16 ** 8):08x}"
    ctes = [f"{name}_c as materialized (select {scale} from {src})",
            f"{name}_z as materialized (select t.id, [{flags}] as z from {src} t, {name}_c c)",
            f"{name}_m0 as materialized (select t.id, f.model, t.target, case when t.fold = f.model then 'score' when "
            f"substr(md5(cast(t.id as varchar) || ':valid:{seed}'), 1, 8) < '{limit}' then 'valid' else 'fit' end as role, 0.0 as margin "
            f"from {src} t, (select unnest(range({k})) as model) f)"]
    for r in range(1, rounds + 1):
        sums = ", ".join(f"sum(case when z[{i}] then 1 else 0 end) as n{i}, sum(case when z[{i}] then g else 0.0 end) as s{i}" for i in range(1, n + 1))
        ctes += [
            f"{name}_s{r} as materialized (select model, count(*) as n, sum(g) as s, {sums} from (select m.model, z.z, "
            f"m.target - 1.0 / (1.0 + exp(-m.margin)) as g from {name}_m{r - 1} m join {name}_z z on z.id = m.id where m.role = 'fit') x group by model)",
            f"{name}_g{r} as materialized (select model, ["
            + ", ".join(f"case when n{i} > 0 and n > n{i} then s{i} * s{i} / n{i} + (s - s{i}) * (s - s{i}) / (n - n{i}) else -1.0 end" for i in range(1, n + 1))
            + "] as gains, [" + ", ".join(f"case when n{i} > 0 then s{i} / n{i} else 0.0 end" for i in range(1, n + 1))
            + "] as high, [" + ", ".join(f"case when n > n{i} then (s - s{i}) / (n - n{i}) else 0.0 end" for i in range(1, n + 1)) + f"] as low from {name}_s{r})",
            f"{name}_p{r} as materialized (select model, i, high[i] as high, low[i] as low from (select *, list_position(gains, list_max(gains)) as i "
            f"from {name}_g{r}) x)",
            f"{name}_m{r} as materialized (select m.id, m.model, m.target, m.role, m.margin + {rate} * (case when z.z[p.i] then p.high else p.low end) as margin "
            f"from {name}_m{r - 1} m join {name}_z z on z.id = m.id join {name}_p{r} p on p.model = m.model)"]
    return ctes


def stop_ctes(name: str, values: str, rounds: int, patience: int, sign: int = 1) -> list[str]:
    """``{name}`` (model, best, stop) from (model, round, value): stop when the best value is ``patience`` rounds old."""
    better = "value > top" if sign > 0 else "value < top"
    top = "max" if sign > 0 else "min"
    return [
        f"{name}_ta as (select *, {top}(value) over (partition by model order by round rows between unbounded preceding and 1 preceding) as top from {values})",
        f"{name}_tb as (select *, max(case when value is not null and (top is null or {better}) then round end) over (partition by model order by round) as best "
        f"from {name}_ta)",
        f"{name}_tc as (select model, coalesce(min(case when round - greatest(coalesce(best, 0), 1) >= {patience} then round end), {rounds}) as stop "
        f"from {name}_tb group by model)",
        f"{name} as (select b.model, greatest(coalesce(b.best, 0), 1) as best, c.stop from {name}_tb b join {name}_tc c on b.model = c.model and b.round = c.stop)"]
