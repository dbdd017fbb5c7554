"""Cell and observation tables on hand-made rows: nulls, ties, empty groups, clashing columns and empty tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import cells as L


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rules_and_their_relaxed_forms(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, 0), (3, None, 1), (4, 1, 1)], "k long, a long, b long")
    rules = L.relaxed_rules({"a": F.col("a") > 2, "b": F.col("b") == 1})
    assert set(rules) == {"base", "any_a", "any_b"}
    assert rows(L.by_rules(df, rules).select("k", "rule")) == [(1, "any_a"), (1, "any_b"), (1, "base"), (2, "any_b"), (3, "any_a"), (4, "any_a")]
    assert set(L.relaxed_rules({"a": F.col("a") > 2, "b": F.col("b") == 1}, ["a"])) == {"base", "any_b"}
    assert L.by_rules(df.limit(0), rules).count() == 0


def test_ranges_and_logs(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 3.0, None), (3, 10.0, 2.0)], "k long, a double, b double")
    assert rows(L.range_keep(df, ["a", "b"], 0, 10, ["k"])) == [(1, "b", 5.0), (2, "a", 3.0), (3, "b", 2.0)]
    got = rows(L.log_positive_pairs(df, "a", "b", 0, 1).select("k", "log_a", "log_b", "diff"))
    assert got == [(3, pytest.approx(math.log(10)), pytest.approx(math.log(2)), 8.0)]
    with pytest.raises(ValueError):
        L.log_positive_pairs(df, "a", "b", -1)


def test_masks_flags_and_limits(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, 6.0, None), (3, None, "y")], "k long, v double, m string")
    assert rows(L.apply_masks(df, "v", [F.col("m") == "x", F.col("k") > 2]).select("k", "v")) == [(1, None), (2, 6.0), (3, None)]
    flags = C.class_flags("m", {"fx": ["x"], "fxy": ["x", "y"]})
    assert rows(df.select("k", *[c.alias(n) for n, c in flags.items()], C.inside("v", 5, 5.5).alias("i"))) == [(1, 1, 1, 1), (2, None, None, 0), (3, 0, 1, 0)]
    lat = spark.createDataFrame([(-60.0,), (-60.1,), (85.0,), (None,)], "lat double")
    assert sorted(r.lat for r in lat.where(C.in_latitudes("lat")).collect()) == [-60.0, 85.0]


def test_layers_and_shares(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "row long, col long, value double")
    b = spark.createDataFrame([(1, 1, 10.0), (1, 2, None), (9, 9, 1.0)], "row long, col long, value double")
    assert rows(L.cell_expr({"x": a, "y": b}, ["row", "col"], "x * y + 1", "out")) == [(1, 1, 21.0), (1, 2, None)]
    w = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 3.0), ("a", None, 9.0), ("b", 1.0, 0.0), (None, 5.0, 2.0)], "k string, v double, d double")
    assert rows(L.weighted_mean(w, ["k"], "v", "d")) == [("a", 3.5), ("b", None), (None, 5.0)]
    v = spark.createDataFrame([("a", 10.0, 1.0), ("a", 30.0, 3.0), ("b", -1.0, 1.0), ("c", 1.0, 0.0)], "k string, v double, s double")
    assert [(r.k, r.log_share and round(r.log_share, 6)) for r in sorted(L.volume_share(v, "k", "v", "s").collect(), key=str)] == [("a", round(math.log(10), 6)), ("a", round(math.log(30), 6)), ("b", None), ("c", None)]
    total, mean = C.sum_and_mean(["v", "s"])
    assert rows(v.where("k = 'a'").select(total.alias("t"), mean.alias("m"), C.area_weighted("v", "s", 10).alias("w"))) == [(11.0, 5.5, 20.0), (33.0, 16.5, 100.0)]


def test_joins_on_several_keys(spark):
    a = spark.createDataFrame([(1, 1, "l", 5), (1, 2, "l", 6), (None, 1, "l", 7)], "k long, m long, name string, x long")
    b = spark.createDataFrame([(1, 1, "r", 50), (1, 1, "r", 51), (None, 1, "r", 52)], "k long, m long, name string, y long")
    assert rows(L.keyed_join(a, b, ["k", "m"])) == [(1, 1, "l", 5, 50), (1, 1, "l", 5, 51)]
    assert len(rows(L.keyed_join(a, b, ["k", "m"], "left"))) == 4
    parts = spark.createDataFrame([("t1", 1.0, 2), ("t2", 3.0, 4), ("t3", 9.0, 9)], "tile string, s double, n long")
    zones = spark.createDataFrame([("t1", "z"), ("t2", "z")], "tile string, zone string")
    assert rows(L.merged_zones(parts, zones, "tile", "zone", ["s", "n"])) == [("z", 4.0, 6)]


def test_counts_by_class_and_zone(spark):
    df = spark.createDataFrame([("z", "a", 1.0), ("z", "b", None), ("z", "a", float("nan")), ("y", None, 4.0)], "zone string, cls string, v double")
    assert rows(L.cross_tab_area(df, "zone", "cls", "v").select("zone", "cls", "n"))[0:2] == [("y", None, 1), ("z", "a", 2)]
    assert rows(L.class_histogram(df, "cls", F.col("v").isNotNull())) == [("a", 2), (None, 1)]
    assert rows(L.nodata_count(df, "zone", F.col("v"))) == [("y", 1, 0), ("z", 3, 2)]
    limits = spark.createDataFrame([(0.0,), (3.0,)], "r double")
    assert rows(L.range_check(df.where("not isnan(v)"), "zone", "v", limits, "r")) == [("y", 4.0, 4.0, False, True)]
    assert L.range_check(df.limit(0), "zone", "v", limits, "r").count() == 0


def test_profiles_climatologies_and_composites(spark):
    days = [("a", dt.date(2001, 1, 1), 1.0), ("a", dt.date(2001, 1, 16), 3.0), ("a", dt.date(2001, 1, 17), 9.0), ("a", dt.date(2002, 1, 2), 5.0), ("b", dt.date(2002, 12, 31), None), ("b", None, 2.0)]
    df = spark.createDataFrame(days, "k string, d date, v double")
    assert rows(L.grid_medians(df, F.col("k"), {"m": F.col("v"), "sq": F.col("v") * F.col("v")})) == [("a", 4, 4.0, 17.0), ("b", 2, 2.0, 4.0)]
    assert L.grid_medians(df, F.col("k"), {"m": F.col("v")}, (0.0, 1.0)).where("cell = 'a'").first().m == [1.0, 9.0]
    p = {r.k: r for r in L.temporal_profile(df, ["k"], "v").collect()}
    assert (p["a"]["mean"], p["a"]["min"], p["a"]["median"], p["a"].nvalid) == (4.5, 1.0, 4.0, 4) and p["a"].p90 == pytest.approx(7.8) and p["b"].nvalid == 1
    assert rows(L.climatology(df, ["k"], "d", "v")) == [("a", 1, 4.5, 4), ("b", 12, None, 0), ("b", None, 2.0, 1)]
    assert rows(L.slot_composite(df, ["k"], "d", "v", F.col("v") < 8)) == [("a", 0, 3.0, 3), ("b", None, 2.0, 1)]
    assert rows(L.permanent_class(df, "k", "d")) == [("a", 2, 1), ("b", 1, 0)]
    assert rows(L.period_stats(df, F.year("d"), "v").select("period", "mean", "n"))[0] == (2001, pytest.approx(13 / 3), 3)
    assert rows(df.select("k", C.season("d").alias("s")).distinct()) == [("a", "DJF"), ("b", "DJF"), ("b", None)]
    assert [r.s for r in spark.createDataFrame([(dt.date(2000, m, 1),) for m in (3, 6, 9, 12)], "d date").select(C.season("d").alias("s")).collect()] == ["MAM", "JJA", "SON", "DJF"]


def test_reshaping(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("a", "z", 1.0), ("b", "x", None), (None, "y", 3.0)], "g string, k string, v double")
    assert rows(L.top_per_group(df, ["g"], "v", ["k"])) == [("a", "x", 2.0), (None, "y", 3.0)]
    assert rows(L.long_to_wide(df, ["g"], "k", ["x", "y", "none"], "v")) == [("a", 2.0, 2.0, None), ("b", None, None, None), (None, None, 3.0, None)]
    there = spark.createDataFrame([(1, 5.0, "extra")], "id long, v double, more string")
    gone = spark.createDataFrame([(2, "w")], "id long, other string")
    assert rows(L.presence_absence(there, gone, ["id", "v"], {"v": -9999})) == [(1, 5.0, 1), (2, -9999.0, 0)]
    fixes = spark.createDataFrame([(1, 7.0)], "id long, v double")
    assert rows(L.corrected(there.unionByName(there.selectExpr("3L as id", "v", "more")), fixes, "id", "v").select("id", "v")) == [(1, 7.0), (3, 5.0)]
