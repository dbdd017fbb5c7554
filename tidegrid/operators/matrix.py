"""Correlations of many columns: blocked cross products per task, merged stably, instead of an aggregate per pair of columns.

A task sums what it read into one small matrix per set of columns (numpy), about its own means; the matrices are merged by
pair of columns. So a hundred columns cost one pass, and a shuffle of tasks times pairs of short rows. A pair counts the rows where
both values are given, as ``corr`` does; NaN counts as a missing value.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import columns as C
from tidegrid.operators.aggregates import ordered_counts
from tidegrid.operators.running import running_sums
from tidegrid.operators.tables import small_or_shuffled
from tidegrid.session import ship_package, written

#: Columns up to which ranks come back by a join per column.
FEW_COLUMNS = 8
MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


class PairMoments:
    """Counts, means and central products of all pairs of columns of the rows added so far, over the rows that have both.

    Entry (i, j) of ``mx`` is the mean of column i where j is given too; ``mx.T`` serves as that of the second column.
    """

    def __init__(self, size: int):
        self.n, self.mx, self.cxx, self.cxy = (np.zeros((size, size)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        there = (~np.isnan(x)).astype(np.float64)
        middle = np.divide(np.nansum(x, axis=0), there.sum(0), out=np.zeros(x.shape[1]), where=there.sum(0) > 0)
        v = np.where(there > 0, x - middle, 0.0)  # about the rows' own means
        n, s = there.T @ there, v.T @ there
        m = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        cxx, cxy = (v * v).T @ there - n * m * m, v.T @ v - n * m * m.T
        self.merge(n, m + middle[:, None], cxx, cxy)

    def merge(self, n: np.ndarray, mx: np.ndarray, cxx: np.ndarray, cxy: np.ndarray) -> None:
        total = self.n + n
        share = np.divide(n, total, out=np.zeros_like(n), where=total > 0)
        d = mx - self.mx
        self.cxx += cxx + d * d * self.n * share
        self.cxy += cxy + d * d.T * self.n * share
        self.mx += d * share
        self.n = total


def _shape(key: T.DataType) -> T.StructType:
    fields = [T.StructField("key", key), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
    return T.StructType([*fields, *[T.StructField(m, T.DoubleType()) for m in MOMENTS]])


def array_moments(rows: DataFrame) -> DataFrame:
    """(key, i, j, n, mx, my, cxx, cyy, cxy) per task and pair i < j, from rows (key, v): arrays of one length per key."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, PairMoments] = {}
        for b in batches:
            keys = b.column(0)
            for k in keys.unique().to_pylist():
                part = b.filter(pa.compute.equal(keys, k)).column(1)
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                held.setdefault(k, PairMoments(x.shape[1])).add(x)
        for k, m in held.items():
            i, j = np.triu_indices(len(m.n), 1)
            some = m.n[i, j] > 0
            i, j = i[some], j[some]
            values = (m.n[i, j], m.mx[i, j], m.mx[j, i], m.cxx[i, j], m.cxx[j, i], m.cxy[i, j])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(i), type=b.schema.field(0).type), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, values)], names=["key", "i", "j", *MOMENTS])

    return rows.select("key", "v").mapInArrow(run, _shape(rows.schema["key"].dataType))


def merged_correlations(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r, n) of partial moments: about the means of all parts, so that no digits are lost to large values. One shuffle."""
    w = Window.partitionBy(*keys)
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    about = parts.withColumns({"_dx": F.col("mx") - mean("mx"), "_dy": F.col("my") - mean("my")})
    total = lambda c, a, b: F.sum(F.col(c) + F.col("n") * F.col(a) * F.col(b))
    one = about.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), total("cxx", "_dx", "_dx").alias("_xx"), total("cyy", "_dy", "_dy").alias("_yy"), total("cxy", "_dx", "_dy").alias("_xy"), F.max(F.abs("mx")).alias("_mx"), F.max(F.abs("my")).alias("_my"))
    # what rounding leaves of a column without variance isn't variance
    flat = lambda c, m: F.col(c) <= F.col("n") * F.pow(F.col(m) * 1e-14, 2)
    r = F.when(flat("_xx", "_mx") | flat("_yy", "_my"), None).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))))
    return one.select(*keys, r.alias("r"), "n")


def _named(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r, n) of all pairs of names; pairs without a common row have n = 0."""
    pairs = [(i, j, a, names[j]) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    every = found.sparkSession.createDataFrame(pairs, "i int, j int, a string, b string")  # a row per pair of columns
    return every.join(found, ["i", "j"], "left").select("a", "b", "r", F.coalesce("n", F.lit(0)).alias("n"))


def many_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r, n) for every pair a < b in the order of ``cols``; r is NULL where one of them doesn't vary."""
    rows = df.select(F.lit(0).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    return _named(merged_correlations(array_moments(rows), ["i", "j"]), cols)


def ranked_arrays(rows: DataFrame) -> DataFrame:
    """(key, v) with each value replaced by its average rank among the values at its place under its key; missing stays missing.

    All columns of all keys are ranked by one sort of their distinct values: values travel once to their ranks and once back to
    their row.
    """
    placed = written(rows.select("key", F.monotonically_increasing_id().alias("row"), "v"), "arrays")
    long = placed.select("key", "row", F.size("v").alias("size"), F.posexplode("v").alias("i", "x")).where("x is not null and not isnan(x)")
    counts = ordered_counts(long.select("key", "i", "x"), ["key", "i"], "x").select("key", "i", F.col("_v").alias("x"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))
    entries = long.join(counts, ["key", "i", "x"]).groupBy("key", "row", "size").agg(F.map_from_entries(F.collect_list(F.struct("i", "rank"))).alias("_m"))  # one entry per column
    return entries.select("key", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.try_element_at("_m", i)).alias("v"))


def value_ranks(counts: Mapping[str, DataFrame], slots: int = 1) -> DataFrame:
    """(i, x, r0, r1 ...): average ranks of every column's values (x, n0, n1 ...), distinct or not, per slot: a set of rows that counts them.

    ``i`` is the column's place; a slot without rows of a value has no rank for it. All columns go through one sort of their distinct values.
    """
    n = [f"n{s}" for s in range(slots)]
    each = [c.where("x is not null").groupBy("x").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in n]).select(F.lit(i).alias("i"), "x", *n) for i, c in enumerate(counts.values())]
    upto = running_sums(reduce(DataFrame.union, each), "i", ["x"], n, ["x"])
    return written(upto.select("i", "x", *[F.when(F.col(m) > 0, F.col(f"{m}_upto") - (F.col(m) - 1) / 2).alias(f"r{s}") for s, m in enumerate(n)]), "ranks")


def with_ranks(rows: DataFrame, ranks: DataFrame, cols: Sequence[str], slots: int = 1) -> DataFrame:
    """``rows`` with the ranks of ``value_ranks`` as <col>_r0, <col>_r1 ...; missing values have none.

    Ranks of few distinct values are sent to all tasks, so the rows stay where they are; only columns of many cost a shuffle.
    """
    for i, c in enumerate(cols):
        one = small_or_shuffled(ranks.where(F.col("i") == i).select(F.col("x").alias("_v"), *[F.col(f"r{s}").alias(f"{c}_r{s}") for s in range(slots)]))
        spread = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)) + 1).otherwise(0)  # missing values must not meet in one task
        rows = rows.join(one, [F.col(c) == F.col("_v"), spread == F.col("_v").isNull().cast("long")], "left").drop("_v")
    return rows


def _given(c: str) -> Column:
    """A column as double; NaN is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def many_rank_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r, n): Spearman's correlation of every pair, with the ranks over all rows of each column."""
    if len(cols) > FEW_COLUMNS:
        ranked = ranked_arrays(df.select(F.lit(0).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))
    else:
        own = [f"_c{i}" for i in range(len(cols))]
        rows = written(df.select(*[_given(c).alias(o) for c, o in zip(cols, own)]), "columns")
        ranks = value_ranks({o: rows.select(F.col(o).alias("x"), F.lit(1).alias("n0")) for o in own})
        ranked = with_ranks(rows, ranks, own).select(F.lit(0).alias("key"), F.array(*[f"{o}_r0" for o in own]).alias("v"))
    return _named(merged_correlations(array_moments(ranked), ["i", "j"]), cols)


def interactions(df: DataFrame, predictors: Sequence[str], target: str, share: float = 0.5) -> DataFrame:
    """(a, b, n, r_both, r_a, r_b, keep) per pair of predictors: absolute correlations of their product and of each with the target.

    Over the rows where both and the target are given. ``keep``: the product's exceeds ``share`` of the greater of the two.
    """
    ship_package(df.sparkSession)
    size = len(predictors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(size, 1)
        held = [[PairMoments(2) for _ in range(3)] for _ in i]
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            y = x[:, size]
            for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
                both = x[:, p] * x[:, q]
                there = ~np.isnan(both + y)
                if there.any():
                    for m, v in zip(held[k], (both, x[:, p], x[:, q])):
                        m.add(np.column_stack([v[there], y[there]]))
        found = [(p, q, kind, m.n[0, 1], m.mx[0, 1], m.mx[1, 0], m.cxx[0, 1], m.cxx[1, 0], m.cxy[0, 1]) for p, q, of in zip(i.tolist(), j.tolist(), held) for kind, m in enumerate(of) if m.n[0, 1]]
        types = [pa.int32()] * 3 + [pa.float64()] * 6
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], names=["i", "j", "kind", *MOMENTS])

    rows = df.select(F.array(*[F.col(c).cast("double") for c in (*predictors, target)]).alias("v"))
    shape = "i int, j int, kind int, " + ", ".join(f"{m} double" for m in MOMENTS)
    each = merged_correlations(rows.mapInArrow(run, shape), ["i", "j", "kind"])
    pick = lambda k, c="r": F.max(F.when(F.col("kind") == k, F.abs(F.col(c))))
    one = each.groupBy("i", "j").agg(pick(0, "n").alias("n"), pick(0).alias("r_both"), pick(1).alias("r_a"), pick(2).alias("r_b"))
    at = F.array(*map(F.lit, predictors))
    kept = F.col("r_both") > share * F.greatest("r_a", "r_b")
    return one.select(F.element_at(at, F.col("i") + 1).alias("a"), F.element_at(at, F.col("j") + 1).alias("b"), "n", "r_both", "r_a", "r_b", kept.alias("keep"))


def _classes(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns that are given in exactly the same rows, by the first of them: counts and sums of hashes of the rows tell them apart."""
    shown = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64("_row").cast("decimal(38,0)"))
    one = df.agg(*[F.struct(F.count(c), F.coalesce(F.sum(shown(c)), F.lit(0))).alias(c) for c in cols]).first()
    found: dict[tuple, list[str]] = {}
    for c in cols:
        found.setdefault(tuple(one[c]), []).append(c)
    return {v[0]: v for v in found.values()}


def lagged_correlations(df: DataFrame, key: str, month_idx: str, xs: Sequence[str], ys: Sequence[str], lags: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """(variable, target, lag, rho, n): Spearman's rho over all stations' months of each variable at each lag with each target.

    Ranks are those among the months where both are given. Variables that are given in the same months share them, and so do targets.
    A value is ranked where it stands, once for every lag and class of the other side (a slot), and its ranks are lagged: what is sorted are
    the distinct values of the variables and targets themselves. Many variables or targets go in blocks.
    """
    if max(len(xs), len(ys)) > FEW_COLUMNS:
        blocks = lambda v: [v[i : i + FEW_COLUMNS] for i in range(0, len(v), FEW_COLUMNS)]
        return reduce(DataFrame.union, [lagged_correlations(df, key, month_idx, x, y, lags) for x in blocks(xs) for y in blocks(ys)])
    of = {f"_x{n}": x for n, x in enumerate(xs)} | {f"_y{n}": y for n, y in enumerate(ys)}
    own_x, own_y = list(of)[: len(xs)], list(of)[len(xs) :]
    raw = written(df.select(F.col(key).alias("_k"), F.col(month_idx).alias("_m"), *[_given(c).alias(o) for o, c in of.items()], F.monotonically_increasing_id().alias("_row")), "months")
    in_a, in_b = list(_classes(raw, own_x).values()), list(_classes(raw, own_y).values())
    width = max(len(in_a), len(in_b))
    slots = len(lags) * width
    w = Window.partitionBy("_k").orderBy("_m")
    at = lambda c, k: F.max(c).over(w.rangeBetween(-k, -k))
    first = ~F.lag(F.struct("_m")).over(w).eqNullSafe(F.struct("_m"))  # of rows of one month one gives the month's value
    counted = {f"{a[0]}_n{q * width + p}": F.when(first, F.count(b[0]).over(w.rangeBetween(k, k))).otherwise(0) for a in in_a for p, b in enumerate(in_b) for q, k in enumerate(lags)}
    counted |= {f"{b[0]}_n{q * width + p}": (F.col(b[0]).isNotNull() & at(a[0], k).isNotNull()).cast("long") for b in in_b for p, a in enumerate(in_a) for q, k in enumerate(lags)}
    rows = written(raw.select("_k", "_m", *[at(x, 0).alias(x) for x in own_x], *own_y, *[c.alias(n) for n, c in counted.items()]), "lagged")
    leads = {c: one[0] for one in (*in_a, *in_b) for c in one}
    weight = lambda c, s: F.col(f"{leads[c]}_n{s}") if f"{leads[c]}_n{s}" in counted else F.lit(0)
    ranks = value_ranks({c: rows.select(F.col(c).alias("x"), *[weight(c, s).alias(f"n{s}") for s in range(slots)]) for c in of}, slots)
    ranked = with_ranks(rows, ranks, list(of), slots)
    pairs = [(a, b, k, f"r{q * width + p}", f"r{q * width + o}", f"{b[0]}_n{q * width + o}") for o, a in enumerate(in_a) for p, b in enumerate(in_b) for q, k in enumerate(lags)]
    shown = [F.when(F.col(there) > 0, F.struct(F.lit(n).alias("key"), F.array(*[at(f"{x}_{rx}", k) for x in a], *[F.col(f"{y}_{ry}") for y in b]).alias("v"))) for n, (a, b, k, rx, ry, there) in enumerate(pairs)]
    arrays = ranked.select(F.array(*shown).alias("s")).select(F.explode(F.array_compact("s")).alias("s")).select("s.*")
    found = merged_correlations(array_moments(arrays), ["key", "i", "j"])
    names = [(n, i, len(a) + j, of[x], k, of[y]) for n, (a, b, k, *_) in enumerate(pairs) for i, x in enumerate(a) for j, y in enumerate(b)]
    lookup = df.sparkSession.createDataFrame(names, "key int, i int, j int, variable string, lag int, target string")  # one row per pair of columns
    return found.join(F.broadcast(lookup), ["key", "i", "j"]).select("variable", "target", "lag", F.col("r").alias("rho"), "n")
