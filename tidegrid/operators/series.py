"""Time series per station: lags, gaps, runs, sequences and splits. Windows are always partitioned by station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.session import written


def calendar_lags(df: DataFrame, key: str, month_idx: str, value: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Values of the calendar months before, not of the rows before; NULL where a month is missing."""
    w = Window.partitionBy(key).orderBy(month_idx)
    return df.withColumns({f"{value}{k}": F.max(value).over(w.rangeBetween(-k, -k)) for k in lags})


def row_lags(df: DataFrame, key: str, order: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags})


def relay_filter(df: DataFrame, key: str, order: str, value: str, skip: int) -> DataFrame:
    """Without each station's first ``skip`` rows and without missing values."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") > skip) & F.col(value).isNotNull()).drop("_k")


def lag_autocorr(df: DataFrame, key: str, order: Sequence[str], value: str, lags: Sequence[int], least: int) -> DataFrame:
    """Correlation of a station's series with itself ``k`` rows on, per lag; series shorter than ``least`` pairs are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    lagged = df.withColumns({f"_b{k}": F.lag(value, k).over(w) for k in lags})
    pairs = lagged.select(key, F.col(value).alias("_a"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_b{k}").alias("b")) for k in lags])).alias("s"))
    out = pairs.select(key, "_a", "s.lag", "s.b").where("_a is not null and b is not null").groupBy(key, "lag").agg(C.corr("_a", "b").alias("r"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def best_lags(df: DataFrame, key: str, month_idx: str, xs: Sequence[str], ys: Sequence[str], lags: Sequence[int] = (0, 1, 2, 3), least: int = 50) -> DataFrame:
    """(variable, target, lag, rho, n, best): rho over all stations' months of each variable at each lag with each target.

    ``best`` marks the greatest absolute rho of a (variable, target) pair (ties to the shorter lag).
    """
    from tidegrid.operators.matrix import lagged_correlations

    rho = written(lagged_correlations(df, key, month_idx, xs, ys, lags).where(F.col("n") > least), "best-lags")
    top = rho.groupBy("variable", "target").agg(F.max_by("lag", F.struct(F.abs("rho"), -F.col("lag"))).alias("_best"))
    return rho.join(top, ["variable", "target"]).select("variable", "target", "lag", "rho", "n", (F.col("lag") == F.col("_best")).alias("best"))


def best_lag(df: DataFrame, key: str, month_idx: str, x: str, y: str, lags: Sequence[int] = (0, 1, 2, 3), least: int = 50) -> DataFrame:
    """``best_lags`` of one variable and one target."""
    return best_lags(df, key, month_idx, [x], [y], lags, least).select("lag", "rho", "n", "best")


def relevance(lags: DataFrame, limit: float = 0.5, least: int = 5) -> DataFrame:
    """(variable, rho) of ``best_lags``: the mean best absolute rho over the targets, of variables at or above ``limit``; of the ``least`` best if none is."""
    mean = lags.where("best").groupBy("variable").agg(F.avg(F.abs("rho")).alias("rho"))  # one row per variable from here on
    w = Window.orderBy(F.desc("rho"), "variable")
    marked = mean.withColumns({"_k": F.row_number().over(w), "_top": F.max("rho").over(Window.partitionBy())})
    return marked.where((F.col("rho") >= limit) | (F.col("_top") < limit) & (F.col("_k") <= least)).select("variable", "rho")


def mean_autocorr(autocorr: DataFrame) -> DataFrame:
    """(lag, mean_r, n_stations) of ``lag_autocorr``."""
    return autocorr.groupBy("lag").agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_stations"))


def gap_analysis(df: DataFrame, key: str, date: str, large: int = 90) -> DataFrame:
    """Per station: observations, greatest and mean gap in days, gaps above ``large``, span in years."""
    w = Window.partitionBy(key).orderBy("_d")
    gaps = df.select(key, F.to_date(date).alias("_d")).withColumn("_g", F.datediff("_d", F.lag("_d").over(w)))
    return gaps.groupBy(key).agg(
        F.count("*").alias("n_obs"), F.max("_g").alias("max_gap"), F.avg("_g").alias("mean_gap"), F.coalesce(F.sum((F.col("_g") > large).cast("long")), F.lit(0)).alias("n_large"),
        (F.datediff(F.max("_d"), F.min("_d")) / 365.25).alias("span_years"),
    )


def month_contiguity(df: DataFrame, key: str, month_idx: str, large: int = 3) -> DataFrame:
    """Per station: missing months between rows, gaps above ``large``, and whether there is none."""
    w = Window.partitionBy(key).orderBy(month_idx)
    gaps = df.select(key, month_idx).distinct().withColumn("_g", F.col(month_idx) - F.lag(month_idx).over(w) - 1)
    return gaps.groupBy(key).agg(
        F.count("*").alias("n_months"), F.coalesce(F.sum("_g"), F.lit(0)).alias("missing"), F.coalesce(F.sum((F.col("_g") > large).cast("long")), F.lit(0)).alias("n_large"),
        (F.coalesce(F.max("_g"), F.lit(0)) == 0).alias("contiguous"),
    )


def longest_run(df: DataFrame, key: str, month_idx: str) -> DataFrame:
    """Per station: the longest run of consecutive months (the earliest on ties), runs, span, completeness, break entropy in bits."""
    w = Window.partitionBy(key).orderBy("_m")
    marked = df.select(key, F.col(month_idx).alias("_m")).distinct().withColumn("_run", F.col("_m") - F.row_number().over(w))
    runs = marked.groupBy(key, "_run").agg(F.min("_m").alias("_a"), F.max("_m").alias("_b"), F.count("*").alias("_n"))
    out = runs.groupBy(key).agg(
        F.max_by(F.struct("_a", "_b", "_n"), F.struct("_n", -F.col("_a"))).alias("s"), F.count("*").alias("n_runs"), F.min("_a").alias("_first"), F.max("_b").alias("_last"), F.sum("_n").alias("_all")
    )
    span = F.col("_last") - F.col("_first") + 1
    p = (F.col("n_runs") - 1) / span
    h = F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return out.select(key, F.col("s._a").alias("run_start"), F.col("s._b").alias("run_end"), F.col("s._n").alias("run_months"), "n_runs", span.alias("span_months"), (100.0 * F.col("_all") / span).alias("pct_complete"), h.alias("break_entropy"))


def sliding_sequences(df: DataFrame, key: str, month_idx: str, value: str, size: int = 12) -> DataFrame:
    """The last ``size`` values of each row's station as an array, oldest first; full windows only."""
    w = Window.partitionBy(key).orderBy(month_idx).rowsBetween(1 - size, 0)
    return df.select(key, month_idx, F.collect_list(value).over(w).alias("history")).where(F.size("history") == size)


def fill_forward(df: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value that isn't NULL, up to and with this row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def expand_months(df: DataFrame, year: str) -> DataFrame:
    """A yearly row as twelve rows with its month."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mm"), F.col(year).alias("yyyy"))


def tile_completeness(df: DataFrame, key: str, month_idx: str) -> DataFrame:
    """Expected (from first to last month) against present months per station, with the number missing."""
    have = df.groupBy(key).agg(F.countDistinct(month_idx).alias("present"), (F.max(month_idx) - F.min(month_idx) + 1).alias("expected"))
    return have.withColumn("missing", F.col("expected") - F.col("present"))


def pooled_rank(correlations: DataFrame, name: str, r: str, top: int = 30, share: float = 0.8) -> DataFrame:
    """Variables by |r|: place, cumulative share, whether among those that reach ``share``. A table of variables, not of rows."""
    w = Window.orderBy(F.desc(F.abs(r)), name)
    total = F.sum(F.abs(r)).over(Window.partitionBy())
    run = C.ratio(F.sum(F.abs(r)).over(w.rowsBetween(Window.unboundedPreceding, 0)), total)
    out = correlations.withColumn("place", F.row_number().over(w)).withColumn("cum_share", run)
    return out.withColumn("needed", F.col("cum_share") - C.ratio(F.abs(r), total) < share).where(F.col("place") <= top)
