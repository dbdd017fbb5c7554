"""Feature screening, scaling and scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators.aggregates import column_quantiles, exact_quantiles, grouped_spearman, long_form, rank_matrix


def score_pack(df: DataFrame, group: Sequence[str], obs: str, pred: str) -> DataFrame:
    """Per group: n, Pearson r, MAE, RMSE, R2, NSE, KGE and bias of predictions."""
    o, p = F.col(obs), F.col(pred)
    both = df.where(o.isNotNull() & p.isNotNull())
    agg = both.groupBy(*group).agg(
        F.count("*").alias("n"), C.corr(obs, pred).alias("r"), F.avg(F.abs(p - o)).alias("mae"), F.avg((p - o) ** 2).alias("mse"),
        F.var_pop(obs).alias("vo"), F.avg(obs).alias("mo"), F.avg(pred).alias("mp"), F.stddev_pop(obs).alias("so"), F.stddev_pop(pred).alias("sp"),
    )
    nse = 1 - F.col("mse") / F.nullif(F.col("vo"), F.lit(0.0))
    kge = 1 - F.sqrt((F.col("r") - 1) ** 2 + (C.ratio("sp", "so") - 1) ** 2 + (C.ratio("mp", "mo") - 1) ** 2)
    return agg.select(*group, "n", "r", "mae", F.sqrt("mse").alias("rmse"), (F.col("r") ** 2).alias("r2"), nse.alias("nse"), kge.alias("kge"), (F.col("mp") - F.col("mo")).alias("bias"))


def quantile_scores(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(quantile, n, r, rho, mae, rmse, ...): the scores of each quantile's (observed, predicted) columns, then their means as ``mean``."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(o).cast("double").alias("obs"), F.col(p).cast("double").alias("pred")) for q, (o, p) in pairs.items()]))
    rows = df.select(each.alias("s")).select("s.*")
    rho = grouped_spearman(rows, ["quantile"], "obs", "pred", large=True).select("quantile", "rho")
    scores = score_pack(rows, ["quantile"], "obs", "pred").join(rho, "quantile")
    mean = scores.agg(*[F.avg(c).alias(c) for c in scores.columns if c not in ("quantile", "n")], F.sum("n").alias("n")).withColumn("quantile", F.lit("mean"))
    return scores.unionByName(mean)


def group_r2(df: DataFrame, group: Sequence[str], obs: str, pred: str) -> DataFrame:
    """1 - SSE / SST per group; NULL where the observations don't vary."""
    o, p = F.col(obs), F.col(pred)
    agg = df.groupBy(*group).agg(F.avg((p - o) ** 2).alias("mse"), F.var_pop(obs).alias("v"))
    return agg.select(*group, (1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation, as <col>_z."""
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(m))  # one row
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols}).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs replaced by the column's exact median."""
    m = column_quantiles(df, cols, (0.5,)).groupBy().agg(*[F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(f"_{c}") for c in cols])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])  # one row


def decorrelate(correlations: DataFrame, order: Sequence[str], limit: float = 0.85) -> list[str]:
    """Greedy: a later column stays unless its |r| with a kept one exceeds ``limit``.

    correlations: (a, b, r) of column pairs, a table of columns and not of rows, at most a few thousand rows.
    """
    r = {(x.a, x.b): abs(x.r or 0.0) for x in correlations.collect()}
    kept: list[str] = []
    for c in order:
        if all(r.get((c, k), r.get((k, c), 0.0)) <= limit for k in kept):
            kept.append(c)
    return kept


def collinearity_prune(correlations: DataFrame, strength: dict[str, float], limit: float, process: dict[str, str] | None = None) -> list[str]:
    """Strongest pairs first: of a pair above ``limit`` the member with less strength goes (ties: the later name).

    ``process``: a variable's process group; only pairs of one group are looked at.
    """
    pairs = sorted(((abs(x.r or 0.0), x.a, x.b) for x in correlations.collect()), key=lambda t: (-t[0], t[1], t[2]))
    gone: set[str] = set()
    for r, a, b in pairs:
        if r > limit and a not in gone and b not in gone and (process is None or process.get(a) == process.get(b)):
            weaker = [c for c in (a, b) if strength[c] == min(strength[a], strength[b])]
            gone.add(max(weaker))
    return [c for c in strength if c not in gone]


def max_abs_rho(df: DataFrame, predictors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(variable, top): each predictor's greatest absolute Spearman correlation with any target."""
    r = rank_matrix(df, [*predictors, *targets]).where(F.col("a").isin(*predictors) & F.col("b").isin(*targets))
    return r.groupBy(F.col("a").alias("variable")).agg(F.max(F.abs("r")).alias("top"))


def quantile_knots(df: DataFrame, value: str, steps: int = 1000) -> np.ndarray:
    """The value's quantiles 0, 1 / steps ... 1: ``steps`` + 1 numbers, or none without values."""
    found = exact_quantiles(df, [], value, [i / steps for i in range(steps + 1)]).first()
    return np.array(found.q, dtype=np.float64) if found and found.q and found.q[0] is not None else np.empty(0)


def inverse_quantile(df: DataFrame, u: str, knots: np.ndarray, out: str = "value") -> DataFrame:
    """``df`` with the value at the place ``u`` (0..1) among train quantiles: undoes ``empirical_quantile``."""
    at = np.linspace(0, 1, len(knots)) if len(knots) else knots

    @F.pandas_udf("double")
    def back(places: pd.Series) -> pd.Series:
        return pd.Series(np.where(places.isna() | (len(knots) == 0), np.nan, np.interp(places.fillna(0.0), at, knots) if len(knots) else 0.0))

    return df.withColumn(out, F.nullif(back(u), F.lit(float("nan"))))


def empirical_quantile(df: DataFrame, train: Column, value: str, steps: int = 1000) -> DataFrame:
    """``df`` with u, the value's place among the train quantiles (0..1, interpolated), by a vectorized helper."""
    probs = [i / steps for i in range(steps + 1)]
    knots, at = quantile_knots(df.where(train), value, steps), np.array(probs)
    if not len(knots):
        return df.withColumn("u", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0.0), knots, at)))

    return df.withColumn("u", F.nullif(place(value), F.lit(float("nan"))))


def normal_score(u: str | Column) -> Column:
    """Standard normal value of a quantile, by a rational approximation inside the JVM (absolute error below 5e-4)."""
    u = F.col(u) if isinstance(u, str) else u
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), u))
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def violations(a: str | Column) -> Column:
    """Places where an array falls."""
    a = F.col(a) if isinstance(a, str) else a
    return F.size(F.filter(F.sequence(F.lit(1), F.size(a) - 1), lambda i: a[i - 1] > a[i]))


def monotone_quantiles(df: DataFrame, array: str, out: str = "monotone") -> DataFrame:
    """``df`` with the least-squares non-decreasing fit of each row's array, as a column expression.

    The fit at a place is the greatest, over the beginnings up to it, of the least mean from there to an end at or after it.
    Arrays are as long as there are quantiles; NULL and empty arrays stay as they are.
    """
    a = F.transform(F.col(array), lambda x: x.cast("double"))
    n = F.size(a)
    upto = F.transform(F.sequence(F.lit(0), n), lambda i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))
    held = df.withColumns({"_a": a, "_s": upto})
    mean = lambda i, j: (F.col("_s")[j] - F.col("_s")[i - 1]) / (j - i + 1)
    least = lambda i, k: F.array_min(F.transform(F.sequence(k, F.size("_a")), lambda j: mean(i, j)))
    fit = F.transform(F.sequence(F.lit(1), F.size("_a")), lambda k: F.array_max(F.transform(F.sequence(F.lit(1), k), lambda i: least(i, k))))
    return held.withColumn(out, F.when(F.size("_a") > 0, fit).otherwise(F.col("_a"))).drop("_a", "_s")


def cv_filter(cv: DataFrame, limit: float, by: str = "mad_cv", least: int = 5, top: int = 10) -> DataFrame:
    """The rows of ``robust_cv`` with a CV at or above ``limit``; if fewer than ``least`` of at least that many variables have one, the ``top`` greatest (ties by name)."""
    w = Window.orderBy(F.col(by).desc_nulls_last(), "variable")  # one row per variable
    marked = cv.withColumns({"_k": F.row_number().over(w), "_good": F.sum((F.col(by) >= limit).cast("int")).over(Window.partitionBy()), "_all": F.count("*").over(Window.partitionBy())})
    few = (F.col("_good") < least) & (F.col("_all") >= least)
    return marked.where((few & (F.col("_k") <= top)) | (~few & (F.col(by) >= limit))).drop("_k", "_good", "_all")


def station_best_predictor(df: DataFrame, station: str, target: str, predictors: Sequence[str], least: int = 3) -> DataFrame:
    """Per station: the predictor with the greatest |r| (ties: the first by name), from one pass."""
    n = F.count("*").alias("_n")
    one = df.groupBy(station).agg(n, *[C.corr(p, target).alias(p) for p in predictors]).where(F.col("_n") >= least)
    rows = long_form(one.select(station, *predictors), [station], list(predictors), "predictor", "r").where("r is not null and not isnan(r)")
    best = rows.groupBy(station).agg(F.min_by(F.struct("predictor", "r"), F.struct(-F.round(F.abs("r"), 9), "predictor")).alias("s"))
    return best.select(station, "s.predictor", "s.r")


def kernel_density(points: DataFrame, size: float, radius: float, scale: float = 10.0) -> DataFrame:
    """(row, col, density): quartic kernel sums at the middles of the cells within ``radius`` of a point.

    Along a row of cells, a point's kernel is a polynomial of the fourth degree between two columns: it is switched on at one and
    off after the other, and running sums of the coefficients give every cell. So a point costs two rows per row of cells and block
    it reaches, as the radius grows, and not one per cell. Rows of cells are cut into blocks of the radius' width, whose own
    coordinates run from 0 to 1: coefficients stay near 1, and sums lose no more than sums of the kernels themselves would.
    """
    wide = max(1, int(radius // size))  # columns of a block
    reach = int(radius // size) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = points.where("x is not null and y is not null").select("x", "y", F.explode(F.transform(steps, lambda k: F.floor(F.col("y") / size) + k)).alias("row"))
    across = F.pow((F.col("row") + 0.5) * size - F.col("y"), 2)
    inside = lambda c: (F.pow((c + 0.5) * size - F.col("x"), 2) + across) / (radius * radius) < 1
    half = F.sqrt(F.greatest(F.lit(0.0), radius * radius - across))
    rows = rows.where(across < radius * radius).withColumns({"a": F.floor((F.col("x") - half) / size - 0.5) + 1, "b": F.ceil((F.col("x") + half) / size - 0.5) - 1})
    # the ends by the test itself, as roots are rounded
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumns({"a": F.when(inside(a - 1), a - 1).when(inside(a), a).otherwise(a + 1), "b": F.when(inside(b + 1), b + 1).when(inside(b), b).otherwise(b - 1)}).where("a <= b")
    part = rows.withColumn("block", F.explode(F.sequence(F.floor(a / wide), F.floor(b / wide))))
    first = F.col("block") * wide
    # t: columns from the block's first, in radii; 1 - ((t - c)^2 + d), squared, by powers of t
    unit = size / radius
    c, k = (F.col("x") / size - 0.5 - first) * unit, 1 - across / (radius * radius)
    p0, p1 = k - c * c, 2 * c
    powers = {"q0": p0 * p0, "q1": 2 * p0 * p1, "q2": p1 * p1 - 2 * p0, "q3": -2 * p1, "q4": F.lit(1.0)}
    part = part.withColumns(powers).withColumns({"on": F.greatest(a, first), "off": F.least(b + 1, first + wide)})
    ends = F.explode(F.array(F.struct(F.col("on").alias("col"), F.lit(1).alias("sign")), F.struct(F.col("off").alias("col"), F.lit(-1).alias("sign"))))
    switched = part.select("row", "block", *powers, ends.alias("e")).groupBy("row", "block", "e.col").agg(*[F.sum(F.col(n) * F.col("e.sign")).alias(n) for n in powers], F.sum("e.sign").alias("n"))
    w = Window.partitionBy("row", "block").orderBy("col")
    on = switched.select("row", "block", "col", *[F.sum(n).over(w).alias(n) for n in (*powers, "n")], F.lead("col").over(w).alias("until")).where("n > 0")
    cells = on.withColumn("col", F.explode(F.sequence("col", F.col("until") - 1)))
    t = (F.col("col") - F.col("block") * wide) * unit
    value = F.col("q0") + t * (F.col("q1") + t * (F.col("q2") + t * (F.col("q3") + t * F.col("q4"))))
    return cells.select("row", "col", (F.greatest(value, F.lit(0.0)) * scale).alias("density"))
