"""Tables of cells and observations: rules, masks, layers, profiles, composites and reshaping.

Every function takes DataFrames, column names and expressions and gives a DataFrame; sums are combined before they are shuffled.
Medians and percentiles per key gather that key's values in a task: they are for keys with a bounded number of rows (a cell, a
station, a month); ``aggregates.exact_quantiles`` is for the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C


def relaxed_rules(conditions: Mapping[str, Column], base: Sequence[str] = ()) -> dict[str, Column]:
    """``base`` with all conditions, and any_<name> with all but one. ``base``: the conditions that are never left out."""
    every = lambda left: reduce(lambda a, b: a & b, [c for n, c in conditions.items() if n != left])
    return {"base": every(None)} | {f"any_{n}": every(n) for n in conditions if n not in base}


def by_rules(df: DataFrame, rules: Mapping[str, Column], name: str = "rule") -> DataFrame:
    """Each row once per rule that it passes, with the rule's name; all rules in one pass. A rule that is NULL isn't passed."""
    passed = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    return df.select("*", F.explode(passed).alias(name))


def range_keep(df: DataFrame, cols: Sequence[str], low: float, high: float, ids: Sequence[str] = ()) -> DataFrame:
    """(ids, variable, value) of the columns' values strictly between the limits."""
    rows = df.unpivot(list(ids), list(cols), "variable", "value")
    return rows.where((F.col("value") > low) & (F.col("value") < high))


def log_positive_pairs(df: DataFrame, a: str, b: str, above_a: float = 0.0, above_b: float = 0.0) -> DataFrame:
    """Rows where both values exceed their limits (0 at least), with log_a, log_b and their absolute difference diff."""
    if above_a < 0 or above_b < 0:
        raise ValueError("logarithms need positive values")
    kept = df.where((F.col(a) > above_a) & (F.col(b) > above_b))
    return kept.withColumns({"log_a": F.log(F.col(a)), "log_b": F.log(F.col(b)), "diff": F.abs(F.col(a) - F.col(b))})


def apply_masks(df: DataFrame, value: str, masks: Sequence[Column]) -> DataFrame:
    """``df`` with the value NULL where any mask holds; a mask that is NULL doesn't."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in masks])
    return df.withColumn(value, F.when(~hit, F.col(value)))


def cell_expr(layers: Mapping[str, DataFrame], on: Sequence[str], expression: str, name: str = "value") -> DataFrame:
    """(on, name): a formula over layers (each with ``on`` and a column value), named as in ``layers``, for the cells that all of them have."""
    named = [d.select(*on, F.col("value").alias(n)) for n, d in layers.items()]
    return reduce(lambda a, b: a.join(b, list(on)), named).select(*on, F.expr(expression).alias(name))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, mean): values weighed, as layers by their depth; rows without a value or a weight don't count, NULL if the weights are 0."""
    both = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return both.groupBy(*keys).agg(C.ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def volume_share(df: DataFrame, key: str, volume: str, area: str) -> DataFrame:
    """``df`` with log_share: the logarithm of a row's part, by its area, of the whole volume of its key; NULL where that isn't positive."""
    whole = df.groupBy(key).agg(F.sum(volume).alias("_volume"), F.sum(area).alias("_area"))
    part = C.ratio("_volume", "_area") * F.col(area)
    return df.join(whole, key).withColumn("log_share", F.when(part > 0, F.log(part))).drop("_volume", "_area")


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on several keys at once. Other columns that both have come from the left; keys are kept once; NULL keys don't match."""
    own = [c for c in right.columns if c in keys or c not in left.columns]
    return left.join(right.select(*own), list(keys), how)


def merged_zones(parts: DataFrame, zones: DataFrame, on: str, zone: str, sums: Sequence[str]) -> DataFrame:
    """(zone, sums): partial sums of tiles, by the zone that a table gives each tile."""
    known = parts.select(on, *sums).join(zones.select(on, zone), on)
    return known.groupBy(zone).agg(*[F.sum(c).alias(c) for c in sums])


def cross_tab_area(df: DataFrame, a: str, b: str, area: str | Column) -> DataFrame:
    """(a, b, n, area): rows and area of every combination of two classes that occurs."""
    area = F.col(area) if isinstance(area, str) else area
    return df.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(area).alias("area"))


def class_histogram(df: DataFrame, cls: str, valid: Column | None = None) -> DataFrame:
    """(cls, n): how often each class occurs among the valid rows."""
    return (df if valid is None else df.where(valid)).groupBy(cls).agg(F.count("*").alias("n"))


def nodata_count(df: DataFrame, zone: str, value: Column) -> DataFrame:
    """(zone, n, n_nodata): rows, and rows whose value is NULL or NaN."""
    missing = F.coalesce(value.isNull() | F.isnan(value.cast("double")), F.lit(True))
    return df.groupBy(zone).agg(F.count("*").alias("n"), F.sum(missing.cast("long")).alias("n_nodata"))


def range_check(df: DataFrame, zone: str, value: str, reference: DataFrame, reference_value: str) -> DataFrame:
    """(zone, lo, hi, below, above): zones whose least or greatest value lies outside those of a reference table."""
    zones = df.groupBy(zone).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    limits = reference.agg(F.min(reference_value).alias("_lo"), F.max(reference_value).alias("_hi"))  # one row
    marked = zones.crossJoin(F.broadcast(limits)).withColumns({"below": F.col("lo") < F.col("_lo"), "above": F.col("hi") > F.col("_hi")})
    return marked.where("below or above").select(zone, "lo", "hi", "below", "above")


def grid_medians(df: DataFrame, cell: Column, values: Mapping[str, Column], probs: Sequence[float] = (0.5,)) -> DataFrame:
    """(cell, n, names): exact percentiles of each value per cell, a number for one probability and an array for several."""
    q = lambda v: F.percentile(v, F.lit(float(probs[0])) if len(probs) == 1 else F.array(*[F.lit(float(p)) for p in probs]))
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *[q(v).alias(n) for n, v in values.items()])


def temporal_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: mean, min, median, p10, p90, std (population) and the number of valid values."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), q.alias("_q"), F.stddev_pop(value).alias("std"), F.count(value).alias("nvalid"))
    return out.select(*keys, "mean", "min", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("p10"), F.col("_q")[2].alias("p90"), "std", "nvalid")


def climatology(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """(keys, mm, clim, n): means of each calendar month over all years."""
    return df.groupBy(*keys, F.month(date).alias("mm")).agg(F.avg(value).alias("clim"), F.count(value).alias("n"))


def slot_composite(df: DataFrame, keys: Sequence[str], date: str, value: str, good: Column, days: int = 16) -> DataFrame:
    """(keys, slot, composite, n): the median of the good values of each slot of ``days`` days of the year, from 0."""
    slot = F.floor((F.dayofyear(date) - 1) / days).alias("slot")
    return df.where(good).groupBy(*keys, slot).agg(F.percentile(value, F.lit(0.5)).alias("composite"), F.count(value).alias("n"))


def permanent_class(df: DataFrame, key: str, date: str) -> DataFrame:
    """(key, n_years, permanent): 1 for keys that occur in every year in which any key occurs."""
    years = df.select(key, F.year(date).alias("_y")).where("_y is not null").distinct()
    every = years.select("_y").distinct().agg(F.count("*").alias("_all"))  # one row
    found = years.groupBy(key).agg(F.count("*").alias("n_years"))
    return found.crossJoin(F.broadcast(every)).select(key, "n_years", (F.col("n_years") == F.col("_all")).cast("int").alias("permanent"))


def period_stats(df: DataFrame, period: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, period, mean, std, n, cv) per month, season or year: ``period`` names it; std with n - 1."""
    out = df.groupBy(*keys, period.alias("period")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return out.withColumn("cv", C.ratio("std", "mean"))


def top_per_group(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str]) -> DataFrame:
    """The row with the greatest ``by`` of each key; ties go to the smallest ``ties``. One struct per key is kept, and no group is sorted."""
    kept = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(by)).alias("_by"), *ties)
    best = df.where(F.col(by).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("_s"))
    return best.select(*keys, *[F.col("_s")[c].alias(c) for c in kept])


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str) -> DataFrame:
    """(keys, names): sums of the values of each of the given names, NULL where there is none; other names are left out."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def presence_absence(presence: DataFrame, absence: DataFrame, cols: Sequence[str], missing: Mapping[str, object]) -> DataFrame:
    """Both tables' rows as ``cols`` with presence 1 or 0; columns that the absences lack get ``missing``."""
    there = presence.select(*cols, F.lit(1).alias("presence"))
    known = {c: F.col(c) if c in absence.columns else F.lit(missing[c]).cast(presence.schema[c].dataType) for c in cols}
    return there.unionByName(absence.select(*[x.alias(c) for c, x in known.items()], F.lit(0).alias("presence")))


def corrected(df: DataFrame, fixes: DataFrame, on: str, col: str) -> DataFrame:
    """``df`` with the column's values replaced by those of ``fixes`` (on, col), row by row of the key."""
    from tidegrid.operators.tables import small_or_shuffled

    new = fixes.select(on, F.col(col).alias("_fixed"))
    return df.join(small_or_shuffled(new), on, "left").withColumn(col, F.coalesce("_fixed", col)).drop("_fixed")
