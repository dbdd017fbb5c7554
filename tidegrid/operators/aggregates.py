"""Grouped summaries: quantiles, correlations, profiles, zones and composites.

Every function takes DataFrames and column names and gives a DataFrame. Ranks and exact quantiles of whole columns or of large
groups come from ``ordered_counts``, so that no task sees more than its range of the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators.tables import small_or_shuffled
from tidegrid.session import written

#: The eleven quantile columns and their probabilities.
QUANTILES = ("QMIN", "Q10", "Q20", "Q30", "Q40", "Q50", "Q60", "Q70", "Q80", "Q90", "QMAX")
PROBS = tuple(i / 10 for i in range(11))
#: Aggregates of one stage beyond which a matrix is summed by blocks; rows of a zone up to which its percentiles are taken in one task.
MANY_PAIRS, SMALL_ZONE = 100, 200_000
#: Rows of whole groups that a task ranks at a time, on average.
RANKED_AT_ONCE = 250_000


def monthly_quantiles(df: DataFrame, station: str, date: str, value: str, min_obs: int = 1) -> DataFrame:
    """Eleven exact quantiles (linear interpolation) per station and month with at least ``min_obs`` values.

    One ``percentile`` call makes all eleven, so values are gathered once; groups are bounded by the days of a month.
    """
    q = F.percentile(value, F.array(*map(F.lit, PROBS)))
    found = df.where(F.col(value).isNotNull()).groupBy(F.col(station), F.year(date).alias("yyyy"), F.month(date).alias("mm")).agg(q.alias("q"), F.count("*").alias("n_obs"))
    return found.where(F.col("n_obs") >= min_obs).select(station, "yyyy", "mm", "n_obs", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def with_middle(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` on the row in the middle of its group (on both, if the values are even in number), NULL elsewhere.

    So ``avg(out)`` is a group's exact median beside other aggregates of ``keys``, after one sort of the rows: many small groups need no
    table of values each.
    """
    w = Window.partitionBy(*keys)
    placed = df.withColumns({"_i": 2 * F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())), "_n": F.count(value).over(w)})
    return placed.withColumn(out, F.when(F.col("_i").between(F.col("_n"), F.col("_n") + 2), F.col(value))).drop("_i", "_n")


def approx_monthly_quantiles(df: DataFrame, station: str, date: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """The same from a sketch of bounded size, for groups of any size."""
    q = F.percentile_approx(value, list(PROBS), accuracy)
    found = df.groupBy(F.col(station), F.year(date).alias("yyyy"), F.month(date).alias("mm")).agg(q.alias("q"))
    return found.select(station, "yyyy", "mm", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def group_sum(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])


def joined_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right`` where ``keys`` are equal; NULL is a key like any other, as in a grouping."""
    own = {k: f"_k_{k}" for k in keys}
    return left.join(right.withColumnsRenamed(own), [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()]).drop(*own.values())


def ordered_values(counts: DataFrame, value: str, count: str) -> DataFrame:
    """``counts`` (one row per value) with _upto: how many rows aren't larger than the value, by a written range sort."""
    from tidegrid.operators.running import running_sums

    others = [c for c in counts.columns if c not in (value, count)]
    found = running_sums(counts.withColumn("_all", F.lit(0)), "_all", [value], [count], [value, *others])
    return found.withColumnRenamed(f"{count}_upto", "_upto").drop("_all")


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _n, _upto): the distinct values of each key, how often they occur, and how many of the key's rows are not larger.

    Values are counted and range-sorted; offsets come from one row per key and partition. What was sorted is written first:
    numbers and offsets then speak of the same partitions, whatever is computed again. NULL values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id())
    placed = written(placed.withColumn("_key", F.struct(*keys)) if keys else placed, "ordered")
    by = ["_p", "_key"] if keys else ["_p"]  # structs with NULL inside are equal, so the windows' partitioning serves the join
    parts = placed.groupBy(*by).agg(F.sum("_n").alias("_s"))
    before = parts.select(*by, (F.sum("_s").over(Window.partitionBy(*by[1:]).orderBy("_p")) - F.col("_s")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    return placed.withColumn("_inside", inside).join(before, by).select(*keys, "_v", "_n", (F.col("_before") + F.col("_inside")).alias("_upto"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, q): exact quantiles with linear interpolation per key, as an array in the order of ``probs``; NULLs don't count.

    For whole columns and large groups; ``percentile`` would merge a group's distinct values in one task. The sizes of few keys
    are sent to all tasks: a shuffle by key would bring a key's values together.
    """
    ranked = ordered_counts(df, keys, value)
    ranked = written(ranked.withColumn("_v", F.col("_v").cast("double")), "ranked")
    total = ranked.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    rows = joined_on_keys(ranked, small_or_shuffled(total), keys) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    if len(probs) > 32 and all(p == i / (len(probs) - 1) for i, p in enumerate(probs)):
        return _even_quantiles(rows, keys, len(probs) - 1)
    found = []
    for i, p in enumerate(probs):
        at = (F.col("_all") - 1) * F.lit(float(p))
        for name, rank in ((f"_l{i}", F.floor(at)), (f"_h{i}", F.ceil(at))):
            found.append(F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_v"))).alias(name))
    one = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), *found)
    share = lambda p: (F.col("_all") - 1) * F.lit(float(p)) - F.floor((F.col("_all") - 1) * F.lit(float(p)))
    return one.select(*keys, F.array(*[F.col(f"_l{i}") * (1 - share(p)) + F.col(f"_h{i}") * share(p) for i, p in enumerate(probs)]).alias("q"))


def _even_quantiles(rows: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """(keys, q) for the probabilities 0, 1 / steps ... 1: each value finds the few places it stands at, instead of being asked for all."""
    first, after = F.col("_upto") - F.col("_n"), F.col("_upto")
    scale = F.lit(float(steps)) / F.greatest(F.col("_all") - 1, F.lit(1))
    low, high = F.greatest(F.lit(0), F.floor((first - 1) * scale) - 1), F.least(F.lit(steps), F.ceil(after * scale) + 1)
    at = (F.col("_all") - 1) * (F.col("_i") / F.lit(float(steps)))
    rows = rows.select("*", F.explode(F.sequence(low, F.greatest(low, high))).alias("_i")).withColumn("_at", at)
    under, over = [(x >= first) & (x < after) for x in (F.floor("_at"), F.ceil("_at"))]
    each = rows.where(under | over).groupBy(*keys, "_i").agg(F.max(F.when(under, F.col("_v"))).alias("_l"), F.max(F.when(over, F.col("_v"))).alias("_h"), F.max("_at").alias("_at"))
    share = F.col("_at") - F.floor("_at")
    each = each.select(*keys, F.struct("_i", (F.col("_l") * (1 - share) + F.col("_h") * share).alias("v")).alias("_s"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]).alias("q"))  # steps + 1 of a key


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(variable, q) of whole columns."""
    return exact_quantiles(long_form(df.select(*[F.col(c).cast("double") for c in cols]), [], cols), ["variable"], "value", probs)


def zonal_stats(df: DataFrame, zone: str, value: str, percentiles: Sequence[float] = ()) -> DataFrame:
    """Counts, moments and exact percentiles per zone; a zone may hold most of the rows.

    Zones are counted first: if none has more than ``SMALL_ZONE`` values, percentiles come with the other aggregates; otherwise from
    a sort of all values. Both are exact.
    """
    moments = [
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.sum(value).alias("sum"),
    ]
    if not percentiles:
        return df.groupBy(zone).agg(*moments)
    names = [f"p{round(100 * p):02d}" for p in percentiles]
    if (df.groupBy(zone).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0) <= SMALL_ZONE:
        out = df.groupBy(zone).agg(*moments, F.percentile(value, F.array(*[F.lit(float(p)) for p in percentiles])).alias("_q"))
        return out.select(*[c for c in out.columns if c != "_q"], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    out = df.groupBy(zone).agg(*moments)
    q = exact_quantiles(df.select(F.col(zone).alias("_z"), value), ["_z"], value, percentiles)
    return out.join(q, out[zone].eqNullSafe(F.col("_z")), "left").select(*out.columns, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def average_ranks(df: DataFrame, value: str, rank: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the average rank of ``value`` over all rows (or those of each key); ties share it. NULLs get none.

    The ranks of the distinct values come back by a join on the value; ``df`` is read once there, so ranks of many columns
    can follow one another. Rows without a value have no partner: a hash of the row spreads them, or they would all meet in one task.
    """
    ranks = ordered_counts(df, keys, value).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(rank))
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(4096)) + 1).otherwise(0)
    on = [F.col(value) == F.col("_v"), spread == F.col("_v").isNull().cast("long"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return df.join(ranks, on, "left").select(*df.columns, rank)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho over all rows where both are given. Both columns are ranked by one sort of their distinct values."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    ranks = ordered_counts(long_form(both, [], ["x", "y"]), ["variable"], "value")
    of = lambda c: ranks.where(F.col("variable") == c).select(F.col("_v").alias(c), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r{c}"))
    return both.join(of("x"), "x").join(of("y"), "y").agg(C.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def grouped_average_rank(group: Sequence[str], value: str) -> Column:
    """Average rank inside groups of bounded size, as a window expression; groups are spread by their key."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def grouped_spearman(df: DataFrame, group: Sequence[str], x: str, y: str, large: bool = False) -> DataFrame:
    """rho and n per group; ``large``: for few groups of any size, whose rows must not meet in one task.

    Groups of bounded size are dealt to as many tasks as their rows need, so that a task's memory doesn't grow with the table.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if large:
        both = both.select(*group, F.col(x).alias("_x"), F.col(y).alias("_y"))
        ranked = average_ranks(average_ranks(both, "_x", "_rx", group), "_y", "_ry", group)
    else:
        both = both.select(*dict.fromkeys([*group, x, y]))
        both = both.repartition(both.count() // RANKED_AT_ONCE + 1, *group)
        ranked = both.withColumn("_rx", grouped_average_rank(group, x)).withColumn("_ry", grouped_average_rank(group, y))
    return ranked.groupBy(*group).agg(C.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair a < b in the order of ``cols``, from one pass: an aggregate per pair, or cross products where these would be many."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if len(pairs) > MANY_PAIRS:
        from tidegrid.operators.matrix import many_correlations

        return many_correlations(df, cols).select("a", "b", "r")
    one = df.agg(*[C.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return one.select(rows.alias("s")).select("s.*")


def rank_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r): Spearman's correlation of every pair, over all rows of each column: all columns are ranked by one sort."""
    from tidegrid.operators.matrix import many_rank_correlations

    return many_rank_correlations(df, cols).select("a", "b", "r")


def corr_above_deciles(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of the rows at or above each of x's deciles 0..90 %, from one pass over the rows."""
    cut = exact_quantiles(df, [], x, PROBS[:10]).select(F.col("q").alias("cut"))
    tagged = df.select(F.col(x).alias("x"), F.col(y).alias("y")).crossJoin(F.broadcast(cut))  # one row
    return tagged.select("x", "y", F.posexplode("cut").alias("decile", "limit")).where("x >= limit").groupBy("decile").agg(C.corr("x", "y").alias("r"), F.count("*").alias("n"))


def difference_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select((F.col(a) - F.col(b)).alias("d")).withColumn("size", F.abs("d"))
    one = d.agg(F.avg("d").alias("mean_diff"), F.avg("size").alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    q = column_quantiles(d, ["d", "size"], (0.1, 0.5, 0.9)).groupBy().pivot("variable", ["d", "size"]).agg(F.first("q"))  # one row
    return one.crossJoin(F.broadcast(q)).select("mean_diff", F.col("d")[1].alias("median_diff"), F.col("d")[0].alias("d10"), F.col("d")[2].alias("d90"), "mae", "rmse", F.col("size")[1].alias("median_abs"))


def rank_sum(df: DataFrame, group: str, first: str, value: str) -> DataFrame:
    """Two-sample rank sum test, one row: (w, n1, n2, z, p) of the group ``first`` against the other rows.

    z by the normal approximation with the variance corrected for ties; p is two-sided, with a continuity correction of one half.
    """
    given = df.select((F.col(group) == first).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and g is not null")
    counts = given.groupBy("v").agg(F.sum(F.col("g").cast("long")).alias("m"), F.count("*").alias("t"))
    counts = written(counts, "counts")
    ranks = ordered_values(counts, "v", "t").withColumn("rank", F.col("_upto") - (F.col("t") - 1) / 2)
    t = F.col("t").cast("double")
    one = ranks.agg(F.sum(F.col("m") * F.col("rank")).alias("s"), F.sum("m").alias("n1"), F.sum(F.col("t") - F.col("m")).alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    w, n = F.col("s") - n1 * (n1 + 1) / 2, n1 + n2
    std = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    off = w - n1 * n2 / 2
    return one.select(w.alias("w"), "n1", "n2", C.ratio(off, std).alias("z"), C.two_sided(C.ratio(off - F.signum(off) * 0.5, std)).alias("p"))


def distribution_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per variable: n, mean, std (n - 1), min, max, median, population skewness and kurtosis, CV, q10, q90."""
    rows = long_form(df.select(*[F.col(c).cast("double") for c in cols]), [], cols)
    v = F.col("value")
    out = rows.groupBy("variable").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )
    out = out.join(exact_quantiles(rows, ["variable"], "value", (0.1, 0.5, 0.9)), "variable", "left")
    return out.select("*", C.ratio("std", "mean").alias("cv"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90")).drop("q")


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, null_pct), from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), C.ratio(100.0 * F.col(c), "_n").alias("null_pct")) for c in cols]))
    return one.select(rows.alias("s")).select("s.*")


def block_aggregate(cells: DataFrame, k: int, value: str, how: str, row: str = "row", col: str = "col") -> DataFrame:
    """Coarser cells of k x k: sum, mean, max, mode (ties to the smaller value) or nearest (the block's middle cell)."""
    keys = F.floor(F.col(row) / k).alias("brow"), F.floor(F.col(col) / k).alias("bcol")
    if how == "mode":
        counts = cells.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
        return counts.groupBy("brow", "bcol").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias(value))
    if how == "nearest":
        middle = (F.col(row) % k == k // 2) & (F.col(col) % k == k // 2)
        return cells.where(middle).select(*keys, value)
    return cells.groupBy(*keys).agg({"sum": F.sum, "mean": F.avg, "max": F.max}[how](value).alias(value))


def trimmed_composite(df: DataFrame, key: Sequence[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Median of a group's values strictly between its two percentiles; the plain median if none is."""
    limits = df.groupBy(*key).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"), F.percentile(value, F.lit(0.5)).alias("_m"))
    v = F.col(value)
    inner = df.join(limits, list(key)).where((v > F.col("_q")[0]) & (v < F.col("_q")[1])).groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("_t"))
    return limits.join(inner, list(key), "left").select(*key, F.coalesce("_t", "_m").alias("composite"))


def robust_cv(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per variable, over group means: MAD / |median| and std / |mean|."""
    means = long_form(df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols]), [group], cols)
    half = lambda d: exact_quantiles(d, ["variable"], "value", (0.5,)).select("variable", F.col("q")[0].alias("m"))
    mid = means.groupBy("variable").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s")).join(half(means), "variable")
    off = means.join(F.broadcast(mid), "variable").select("variable", F.abs(F.col("value") - F.col("m")).alias("value"))  # one row per variable
    mad = half(off).withColumnRenamed("m", "mad")
    return mid.join(mad, "variable").select("variable", C.ratio("mad", F.abs("m")).alias("mad_cv"), C.ratio("s", F.abs("a")).alias("std_cv"))


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def equal_count_zones(df: DataFrame, zone_by: str, zones: int = 3) -> DataFrame:
    """``df`` with a zone number from 1, cut at right-closed quantiles of ``zone_by``."""
    cut = exact_quantiles(df, [], zone_by, [i / zones for i in range(1, zones)]).select(F.col("q").alias("_cut"))
    above = F.size(F.filter("_cut", lambda c: F.col(zone_by) > c))
    return df.crossJoin(F.broadcast(cut)).withColumn("zone", above + 1).drop("_cut")  # one row


def overlap_counts(shots: DataFrame, cell: Column, first_sensor: Column, value: str) -> DataFrame:
    """Agreement of two sensors: medians per cell of each, then n, r and slope over the cells that both saw. One shuffle."""
    med = lambda which: F.percentile(F.when(which, F.col(value)), F.lit(0.5))
    cells = shots.groupBy(cell.alias("cell")).agg(med(first_sensor).alias("a"), med(~first_sensor).alias("b")).where("a is not null and b is not null")
    return cells.agg(F.count("*").alias("n"), F.round(C.corr("a", "b"), 6).alias("r"), F.round(C.slope("b", "a"), 6).alias("slope"))


def cluster_characteristics(df: DataFrame, cluster: str, station: str, x: str, value: str, probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Per cluster of stations: stations, rows, middle and spread of ``x``, mean, the ratio of the last of the cluster's quantiles to
    the first, and the mean over its stations of each of their own quantiles (mean_q10 ...).

    A cluster may hold most of the rows: its quantiles come from a sort, its stations' from their own rows.
    """
    own = df.groupBy(cluster, station).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("sx"), F.count(x).alias("nx"), F.sum(value).alias("sv"), F.count(value).alias("nv"), F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    means = [F.avg(F.col("q")[i]).alias(f"mean_q{round(100 * p):02d}") for i, p in enumerate(probs)]
    one = own.groupBy(cluster).agg(F.count(station).alias("n_stations"), F.sum("n").alias("n_obs"), C.ratio(F.sum("sx"), F.sum("nx")).alias("centre"), (F.max("hi") - F.min("lo")).alias("spread"), C.ratio(F.sum("sv"), F.sum("nv")).alias("mean"), *means)
    q = exact_quantiles(df, [cluster], value, probs).select(F.col(cluster).alias("_c"), C.ratio(F.col("q")[len(probs) - 1], F.col("q")[0]).alias("high_low"))
    return one.join(q, F.col(cluster).eqNullSafe(F.col("_c")), "left").drop("_c")
