"""Joins, reshaping, ids, splits and samples.

Broadcasts: a lookup is only hinted when its size is checked first (``small_or_shuffled``); all other joins leave the choice
to the planner, which broadcasts by measured size and otherwise shuffles, with skewed keys split at run time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.session import written

#: Rows up to which a lookup table may be broadcast.
LOOKUP_ROWS = 200_000


def small_or_shuffled(lookup: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``lookup`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(lookup) if lookup.limit(rows + 1).count() <= rows else lookup


def matched_else_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """All rows of ``left`` with the right columns, or their defaults where nothing matches."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def align_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both, only in a, only in b. NULL keys equal each other."""
    left = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.lit(1).alias("in_a"))
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.lit(1).alias("in_b"))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = left.join(right, on, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a_there, b_there = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(count(a_there & b_there).alias("matched"), count(a_there & ~b_there).alias("only_a"), count(b_there & ~a_there).alias("only_b"))


def sample_at_points(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Points with the value of their cell (columns row and col on both sides)."""
    return points.join(cells.select("row", "col", value), ["row", "col"], "left")


def neighbourhood_max(points: DataFrame, cells: DataFrame, value: str, reach: int, id_col: str) -> DataFrame:
    """Greatest value of the cells within ``reach`` of each point's cell: offsets are exploded, then an equi join."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = points.select(id_col, "row", F.col("col"), F.explode(steps).alias("dr")).select(id_col, (F.col("row") + F.col("dr")).alias("row"), "col", F.explode(steps).alias("dc"))
    around = around.select(id_col, "row", (F.col("col") + F.col("dc")).alias("col"))
    found = around.join(cells.select("row", "col", value), ["row", "col"]).groupBy(id_col).agg(F.max(value).alias(f"max_{value}"))
    return points.join(found, id_col, "left")


def overlap(left: DataFrame, right: DataFrame, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cells in both grids."""
    return left.join(right, list(on))


def crowding(spots: DataFrame, bins: Sequence[Column], level: str) -> dict[int, int]:
    """Per level, how often a radius is halved so that the bins around a point hold some 32 spots, where spots are as crowded as they mostly are."""
    held = spots.groupBy(level, *[b.alias(f"_b{i}") for i, b in enumerate(bins)]).agg(F.count("*").alias("_n"))
    mean = held.groupBy(level).agg((F.sum(F.col("_n").cast("double") * F.col("_n")) / F.sum("_n")).alias("_m")).collect()  # one row per level
    return {r[0]: min(20, max(0, math.ceil(math.log(max(1.0, 9 * r["_m"] / 32), 4)))) for r in mean}


def nearest_in_rounds(places: DataFrame, at: Sequence[str], spots: DataFrame, radius: float, near: Callable[[DataFrame, DataFrame, float], DataFrame], halvings: dict[int, int]) -> DataFrame:
    """(at, anchor_id, d, level) of the places (columns ``at``, a row each) with a spot (anchor_id, level) within ``radius``: the highest level, then the nearest, then the smallest id.

    Level by level, a place asks within a small reach first and within twice that if nothing was there: what lies within a reach is
    all seen, so the first answer is the nearest. Where spots are dense, few of them are looked at, whatever the radius.
    """
    found, left = None, written(places, "places")
    for level in sorted(halvings, reverse=True):
        some = spots.where(F.col("level") == level)
        for k in range(halvings[level], -1, -1):
            hit = near(left, some, radius / 2**k).groupBy(*at).agg(F.min_by(F.struct("anchor_id", "d", "level"), F.struct("d", "anchor_id")).alias("_s"))
            hit = written(hit, "nearest")
            found = hit if found is None else found.unionByName(hit)
            left = written(left.join(hit, list(at), "left_anti"), "places")
        if left.isEmpty():
            break
    return found.select(*at, "_s.*") if found is not None else places.select(*at, *[F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", spots.schema["anchor_id"].dataType), ("d", "double"), ("level", "int"))]).where(F.lit(False))


def near_on_plane(points: DataFrame, spots: DataFrame, reach: float) -> DataFrame:
    """Rows of ``points`` (x, y) and ``spots`` (ax, ay) at most ``reach`` apart, with their distance d."""
    b = lambda c: F.floor(F.col(c) / reach)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = points.select("*", F.explode(F.transform(steps, lambda k: b("x") + k)).alias("_bx"))
    near = near.select("*", F.explode(F.transform(steps, lambda k: b("y") + k)).alias("_by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2))
    return near.join(spots.withColumns({"_bx": b("ax"), "_by": b("ay")}), ["_bx", "_by"]).withColumn("d", d).where(F.col("d") <= reach).drop("_bx", "_by")


def levelled(anchors: DataFrame, at: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(at, level, anchor_id): anchors that meet a threshold, the smallest id of a place and level."""
    level = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("weight") >= t))
    there = anchors.where(" and ".join(f"{c} is not null" for c in at))
    return written(there.withColumn("level", level).where("level > 0").groupBy(*at, "level").agg(F.min("anchor_id").alias("anchor_id")), "spots")


def nearest_snap(points: DataFrame, anchors: DataFrame, radius: float, thresholds: Sequence[float], id_col: str) -> DataFrame:
    """Each point's anchor: the highest threshold that any anchor within ``radius`` meets, then the nearest, then the smallest id.

    Places are asked once, however many points share them, in rounds of growing reach (``nearest_in_rounds``). points: x, y;
    anchors: anchor_id, ax, ay, weight. Points without an anchor keep NULL.
    """
    spots = levelled(anchors, ["ax", "ay"], thresholds)
    halvings = crowding(spots, [F.floor(F.col("ax") / radius), F.floor(F.col("ay") / radius)], "level")
    places = points.select("x", "y").where("x is not null and y is not null").distinct()
    best = nearest_in_rounds(places, ["x", "y"], spots, radius, near_on_plane, halvings)
    return points.join(best.withColumnRenamed("d", "distance"), ["x", "y"], "left").select(*points.columns, "anchor_id", "distance", "level")


def outside_buffer(points: DataFrame, presence: DataFrame, radius: float) -> DataFrame:
    """Points with no presence point within ``radius``; both have x and y. Binned, so no pair beyond neighbours is made."""
    b = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = presence.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    near = near.select("px", "py", F.explode(F.transform(steps, lambda k: b("px") + k)).alias("bx")).select("px", "py", "bx", F.explode(F.transform(steps, lambda k: b("py") + k)).alias("by"))
    close = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) <= radius * radius
    keyed = points.withColumns({"_bx": b("x"), "_by": b("y")})
    return keyed.join(near, (F.col("_bx") == F.col("bx")) & (F.col("_by") == F.col("by")) & close, "left_anti").drop("_bx", "_by")


def reclass(df: DataFrame, lookup: DataFrame, on: Sequence[str], new: str, default: object = None) -> DataFrame:
    """``df`` with the new code of a one- or two-key table."""
    out = df.join(small_or_shuffled(lookup.select(*on, new)), list(on), "left")
    return out if default is None else out.withColumn(new, F.coalesce(F.col(new), F.lit(default)))


def dense_ids(df: DataFrame, keys: Sequence[str], name: str = "dense_id") -> DataFrame:
    """The distinct keys with consecutive ids from 1 in key order: per-partition numbers plus offsets, no global window."""
    # written first: numbers and offsets then speak of the same partitions, whatever is computed again
    placed = written(df.select(*keys).distinct().repartitionByRange(*keys).select("*", F.spark_partition_id().alias("_p")), "numbered")
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return placed.withColumn("_i", inside).join(F.broadcast(before), "_p").select(*keys, (F.col("_before") + F.col("_i")).alias(name))  # one row per partition


def distance_classes(points: DataFrame, sources: DataFrame, limits: Sequence[float]) -> DataFrame:
    """``points`` with distance to the nearest source and its class: 1 within the first limit, 2 within the second ...; NULL beyond the last.

    Both have x and y. Sources are binned by the last limit and looked up in the nine bins around a point.
    """
    reach = float(limits[-1])
    b = lambda c: F.floor(F.col(c) / reach)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spots = sources.select(F.col("x").alias("sx"), F.col("y").alias("sy")).distinct().withColumns({"bx": F.floor(F.col("sx") / reach), "by": F.floor(F.col("sy") / reach)})
    places = points.select("x", "y").distinct()
    near = places.select("x", "y", F.explode(F.transform(steps, lambda k: b("x") + k)).alias("bx")).select("x", "y", "bx", F.explode(F.transform(steps, lambda k: b("y") + k)).alias("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    found = near.join(spots, ["bx", "by"]).groupBy("x", "y").agg(F.min(d).alias("distance")).where(F.col("distance") <= reach)
    band = 1 + F.size(F.filter(F.array(*map(F.lit, map(float, limits))), lambda t: F.col("distance") > t))
    return points.join(found.withColumn("band", band), ["x", "y"], "left")


def near_pairs(points: DataFrame, key: str, reach: float) -> DataFrame:
    """(a, b, d): pairs of points less than ``reach`` apart, smaller key first; points meet through bins of ``reach`` and the bins around."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    binned = points.select(F.col(key).alias("a"), "x", "y", F.floor(F.col("x") / reach).alias("bx"), F.floor(F.col("y") / reach).alias("by"))
    other = binned.select(F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.transform(steps, lambda k: F.col("bx") + k)).alias("bx"), "by")
    other = other.withColumn("by", F.explode(F.transform(steps, lambda k: F.col("by") + k)))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    return binned.join(other, ["bx", "by"]).where("a < b").select("a", "b", d.alias("d")).where(F.col("d") < reach)


def band_correlations(points: DataFrame, series: DataFrame, key: str, month: str, value: str, reach: float | None, width: float, least: int = 3) -> DataFrame:
    """(band, n_pairs, mean_r): mean Pearson correlation of the series of stations less than ``reach`` apart (None: of all pairs), per ``width`` of distance.

    ``series`` has one row per station and month (a whole number). Stations meet in blocks, whose pairs are correlated by matrix
    products (``bands``): no row per pair is made. Pairs with fewer than ``least`` months in common are left out; a pair without
    variance counts as a pair and not in the mean. Stations without a finite position have no distance and no pairs.
    """
    from tidegrid.operators import bands as B

    points = points.select(key, *[F.col(c).cast("double").alias(c) for c in ("x", "y")]).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    if reach is None:
        ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()  # one row
        dx, dy = (ends[i + 1] - ends[i] if ends[i] is not None else 0.0 for i in (0, 2))
        number = int(np.floor(np.sqrt(dx * dx + dy * dy) / width)) + 1
        every = lambda cells: cells.select("_row", "_bin", F.col("_row").alias("_row2"), F.col("_bin").alias("_bin2"))
        found = B.band_moments(points, [F.lit(0), F.lit(0)], every, series, key, month, value, B.plane, lambda d: np.floor(d / width), number, least)
        return found.select("band", "n_pairs", "mean_r")
    cell = lambda c: F.floor(F.col(c) / reach)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])

    def around(cells: DataFrame) -> DataFrame:
        rows = cells.select("_row", "_bin", F.explode(F.transform(steps, lambda k: F.col("_row") + k)).alias("_row2"))
        return rows.select("*", F.explode(F.transform(steps, lambda k: F.col("_bin") + k)).alias("_bin2"))

    number = math.ceil(reach / width)
    band_of = lambda d: np.where(d < reach, np.floor(d / width), number)
    found = B.band_moments(points, [cell("y"), cell("x")], around, series, key, month, value, B.plane, band_of, number, least)
    return found.select("band", "n_pairs", "mean_r")


def group_kfold(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Fold of each group: place among the sorted groups modulo ``folds``."""
    numbered = dense_ids(df, [group], "_id")
    return df.join(numbered.select(group, ((F.col("_id") - 1) % folds).alias("fold")), group)


def hash_order(key: str | Column, seed: str = "") -> Column:
    """A repeatable shuffled order: md5 of the key as text and a seed."""
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(seed)))


def stratified_holdout(groups: DataFrame, group: str, stratum: str, share: float = 0.2, seed: str = "split") -> DataFrame:
    """``groups`` (one row each) with held_out for the first ceil(share * n) of each stratum in hash order."""
    w = Window.partitionBy(stratum)
    k = F.row_number().over(w.orderBy(hash_order(group, seed), group))
    return groups.withColumn("held_out", k <= F.ceil(F.count("*").over(w) * share))


def hash_sample(df: DataFrame, key: str | Column, share: float, seed: str = "sample") -> DataFrame:
    """Rows whose hash falls below ``share`` of its range: repeatable, without a shuffle."""
    limit = f"{int(share * 0x10000000):07x}"
    return df.where(F.substring(hash_order(key, seed), 1, 7) < limit)


def systematic(df: DataFrame, order: Sequence[str], step: int, group: Sequence[str]) -> DataFrame:
    """Every ``step``-th row of each group in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") % step == 0).drop("_k")


def first_by_hash(df: DataFrame, key: str | Column, cap: Column, groups: Sequence[str] = (), seed: str = "points", rows: int = 100_000) -> DataFrame:
    """The first ``cap`` rows of each group in hash order (ties by key), without a group in one task.

    ``cap`` is made of _n, a group's rows, and of columns named _cap_..., which are the same in all rows of a group. Rows are counted by the first digits of their hash, as many digits as
    leave about ``rows`` rows of the largest group together. The digits at which the running count passes the cap are
    cut; only the rows with exactly these are numbered one by one.
    """
    by = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups] + [F.col(g).isNull() for g in groups]
    named = df.withColumns({"_h": hash_order(key, seed), "_g": F.concat_ws("\x1f", *by) if groups else F.lit("")})
    size = named.groupBy("_g").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in groups and c.startswith("_cap_")])
    largest = size.agg(F.max("_n")).first()[0] or 0
    digits = 1
    while largest / 16**digits > rows and digits < 32:
        digits += 1
    counts = named.groupBy("_g", F.substring("_h", 1, digits).alias("_d")).agg(F.count("*").alias("_k"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy("_g").orderBy("_d"))).join(size.withColumn("_cap", cap), "_g")
    edge = upto.where((F.col("_upto") > F.col("_cap")) & (F.col("_upto") - F.col("_k") <= F.col("_cap"))).groupBy("_g").agg(F.min("_d").alias("_cut"), F.min_by(F.col("_cap") - F.col("_upto") + F.col("_k"), "_d").alias("_rest"))
    marked = named.withColumn("_d", F.substring("_h", 1, digits)).join(small_or_shuffled(edge), "_g", "left")
    whole = marked.where(F.col("_cut").isNull() | (F.col("_d") < F.col("_cut"))).select(*df.columns)
    last = marked.where(F.col("_d") == F.col("_cut")).withColumn("_i", F.row_number().over(Window.partitionBy("_g", "_d").orderBy("_h", key)))
    return whole.unionByName(last.where(F.col("_i") <= F.col("_rest")).select(*df.columns))


def capped_points(points: DataFrame, tile: str, key: str, presence: DataFrame, total: int, seed: str = "points") -> DataFrame:
    """Per tile at most min(n / 16, 2 * presence / tiles) points in hash order, then ``total`` of them in hash order.

    presence: (tile, n_presence). Both limits are what this sampling operator is for.
    """
    tiles = presence.agg(F.sum("n_presence").alias("_cap_all"), F.count("*").alias("_cap_tiles"))
    known = points.crossJoin(F.broadcast(tiles))  # one row
    cap = F.least(F.floor(F.col("_n") / 16), F.floor(2 * F.col("_cap_all") / F.col("_cap_tiles")))
    kept = written(first_by_hash(known, key, cap, [tile], seed).select(*points.columns), "capped")
    return first_by_hash(kept, key, F.lit(total), seed=seed + "2")


def first_valid(sources: Sequence[DataFrame], on: Sequence[str], value: str) -> DataFrame:
    """Overlay: the last source with a value wins."""
    every = None
    for i, s in enumerate(sources):
        part = s.where(F.col(value).isNotNull()).select(*on, value, F.lit(i).alias("_i"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*on).agg(F.max_by(value, "_i").alias(value))


def wide_to_long_months(df: DataFrame, ids: Sequence[str], cols: Sequence[str], first_month: str) -> DataFrame:
    """Month columns in order to rows (ids, month, value); missing values are left out."""
    rows = df.select(*ids, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_i", "value"))
    return rows.where("value is not null").select(*ids, F.add_months(F.lit(first_month).cast("date"), F.col("_i")).alias("month"), "value")


def label_encode(df: DataFrame, category: str) -> DataFrame:
    """``df`` with the place of the category among the sorted categories, from 0."""
    codes = dense_ids(df.where(F.col(category).isNotNull()), [category], "_code").select(category, (F.col("_code") - 1).alias("code"))
    return df.join(codes, category, "left")


def reconcile(a: DataFrame, b: DataFrame, on: str, b_area_factor: float) -> DataFrame:
    """Two catalogues (lon, lat as text; area, altitude): the more precise coordinates, and a's numbers before b's.

    ``b_area_factor`` brings b's areas to a's unit. Rows only in a stay.
    """
    from tidegrid.functions.columns import more_precise

    r = b.select(F.col(on), *[F.col(c).alias(f"b_{c}") for c in ("lon", "lat", "area", "altitude")])
    j = a.join(r, on, "left")
    return j.select(
        on, more_precise("lon", "b_lon").alias("lon"), more_precise("lat", "b_lat").alias("lat"),
        F.coalesce("area", F.col("b_area") * b_area_factor).alias("area"), F.coalesce("altitude", "b_altitude").alias("altitude"),
    )
