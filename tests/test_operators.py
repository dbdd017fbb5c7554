"""Hand-made cases: edges, ties, empty tables and invariants."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import plans
from tidegrid.functions import columns as C
from tidegrid.operators import aggregates as A
from tidegrid.operators import bands as B
from tidegrid.operators import matrix as X2
from tidegrid.operators import models as M
from tidegrid.operators import network as N
from tidegrid.operators import scores as S
from tidegrid.operators import series as T
from tidegrid.operators import space as P
from tidegrid.operators import tables as J
from tidegrid.sources import text as X


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_monthly_quantiles(spark):
    days = [("a", dt.date(2001, 12, d), float(d)) for d in range(1, 12)] + [("a", dt.date(2002, 1, 1), 5.0), ("b", dt.date(2001, 12, 1), None)]
    df = spark.createDataFrame(days, "s string, d date, q double")
    got = {(r.yyyy, r.mm): r for r in A.monthly_quantiles(df, "s", "d", "q").collect()}
    assert set(got) == {(2001, 12), (2002, 1)}
    assert [got[2001, 12][n] for n in A.QUANTILES] == [float(i) for i in range(1, 12)]
    assert got[2002, 1].QMIN == got[2002, 1].QMAX == 5.0
    assert A.monthly_quantiles(df, "s", "d", "q", 10).count() == 1
    assert A.monthly_quantiles(df.limit(0), "s", "d", "q").count() == 0


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(g), float(v) if v > 2 else None) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500))] + [(9, None), (8, 1.5)], "g int, v double").repartition(5)
    probs = (0.0, 0.05, 0.33, 0.5, 0.9, 1.0)
    values = {}
    for g, v in rows(df.where("v is not null")):
        values.setdefault(g, []).append(v)
    got = {r.g: r.q for r in A.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert got[g] == pytest.approx(np.quantile(v, probs).tolist())
    assert A.exact_quantiles(df, [], "v", probs).first().q == pytest.approx(np.quantile(sum(values.values(), []), probs).tolist())
    even = [i / 50 for i in range(51)]
    for r in A.exact_quantiles(df, ["g"], "v", even).collect():
        assert r.q == pytest.approx(np.quantile(values[r.g], even).tolist())
    assert A.exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0
    assert A.exact_quantiles(df.limit(0), [], "v", probs).first().q[0] is None


def test_large_groups_rank_as_small_ones(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(g), float(x), float(y) if y else None) for g, x, y in rng.integers(0, 6, (300, 3))], "g int, x double, y double")
    as_dict = lambda d: {r.g: (pytest.approx(r.rho), r.n) for r in d.collect()}
    assert as_dict(A.grouped_spearman(df, ["g"], "x", "y", large=True)) == as_dict(A.grouped_spearman(df, ["g"], "x", "y"))


def test_quantiles_back_to_values(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(50)] + [(None,)], "v double")
    knots = S.quantile_knots(df, "v", 98)
    back = S.inverse_quantile(S.empirical_quantile(df, F.lit(True), "v", 98), "u", knots)
    assert all(r.v == pytest.approx(r.value) if r.v is not None else r.value is None for r in back.collect())
    assert len(S.quantile_knots(df.limit(0), "v", 5)) == 0


def test_collinearity_ties_drop_the_later_name(spark):
    r = spark.createDataFrame([("l_a", "l_b", 0.9), ("l_b", "l_c", 0.8), ("l_a", "z", -0.95)], "a string, b string, r double")
    assert S.collinearity_prune(r.where("b = 'l_b'"), {"l_a": 1.0, "l_b": 1.0}, 0.5) == ["l_a"]
    strength = {"l_a": 2.0, "l_b": 1.0, "l_c": 1.0, "z": 3.0}
    assert S.collinearity_prune(r, strength, 0.5) == ["l_b", "z"]
    assert S.collinearity_prune(r, strength, 0.5, {"l_a": "p", "l_b": "p", "l_c": "q", "z": "q"}) == ["l_a", "l_c", "z"]


def test_distance_classes(spark):
    p = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 3, 5, 7, 50)], "x double, y double")
    got = {r.x: r.band for r in J.distance_classes(p, p.where("x in (0, 50)").limit(9), [1, 3, 6]).collect()}
    assert got == {0.0: 1, 1.0: 1, 3.0: 2, 5.0: 3, 7.0: None, 50.0: 1}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from tidegrid.session import shared_dir

    with pytest.raises(ValueError):
        shared_dir(Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://host:7077")))


def test_sentinels(spark):
    df = spark.createDataFrame([(-9999.0,), (float("nan"),), (float("inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(C.sentinel_to_null("v")).collect()] == [None, None, None, 1.5, None]


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, 2.0)], "k int, v double")
    assert {r.k: r.r for r in A.average_ranks(df, "v", "r").collect()} == {1: 3.5, 2: 1.0, 3: 3.5, 4: None, 5: 2.0}
    assert A.spearman(df.withColumn("w", F.col("v")), "v", "w").first().rho == pytest.approx(1.0)


def test_a_null_key_is_a_group_like_any_other(spark):
    df = spark.createDataFrame([(None, 4.0, 1), (None, 8.0, 2), (None, None, 3), (1, 5.0, 4), (1, 7.0, 5), (1, 7.0, 6)], "g int, v double, k int").repartition(3)
    assert {r.g: r.q for r in A.exact_quantiles(df, ["g"], "v", (0.0, 0.5, 1.0)).collect()} == {None: [4.0, 6.0, 8.0], 1: [5.0, 7.0, 7.0]}
    assert {r.k: r.r for r in A.average_ranks(df, "v", "r", ["g"]).collect()} == {1: 1.0, 2: 2.0, 3: None, 4: 1.0, 5: 2.5, 6: 2.5}
    assert {r.g: (r.n, r.p50) for r in A.zonal_stats(df, "g", "v", (0.5,)).collect()} == {None: (2, 6.0), 1: (3, 7.0)}


def test_rows_without_a_value_spread_over_tasks(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id").cast("double")).alias("v"))
    ranks = A.average_ranks(df, "v", "r")
    assert ranks.where("r is not null").agg(F.sum("r")).first()[0] == 1000 * 1001 / 2 and ranks.count() == 4000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = A.average_ranks(df, "v", "r").where("v is null").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        plan = A.average_ranks(df, "v", "r")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "xxhash64" in plan and (most[1] == 1 or most[0] < 2000)  # small tables may be read in one task


def test_band_correlations_equal_numpy(spark):
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 30, (25, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "s long, x double, y double")
    held = {(i, m): float(rng.normal()) for i in range(25) for m in range(12) if rng.random() < 0.5}
    series = spark.createDataFrame([(i, m, v) for (i, m), v in held.items()] + [(3, 50, None), (4, None, 1.0)], "s long, m int, v double")
    want = {}
    for a in range(25):
        for b in range(a + 1, 25):
            d, both = np.hypot(*(at[a] - at[b])), [m for m in range(12) if (a, m) in held and (b, m) in held]
            if d < 10 and len(both) >= 3:
                want.setdefault(int(d // 4), []).append(np.corrcoef([held[a, m] for m in both], [held[b, m] for m in both])[0, 1])
    got = {r.band: (r.n_pairs, r.mean_r) for r in J.band_correlations(points, series, "s", "m", "v", 10.0, 4.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == (len(v), pytest.approx(np.mean(v))) for k, v in want.items())


def test_band_correlations_by_blocks(spark, monkeypatch):
    """Blocks and tiles of a few stations: every pair is met once, complete and gappy, flat and at shared places, on the plane and the sphere."""
    monkeypatch.setattr(B, "BLOCK", 7)
    monkeypatch.setattr(B, "TILE", 3)
    rng = np.random.default_rng(9)
    at = np.column_stack([rng.integers(0, 12, 60) / 4 + 178.5, rng.integers(0, 8, 60) / 4 + 59.0])
    at[:, 0] = np.where(at[:, 0] > 180, at[:, 0] - 360, at[:, 0])
    v = rng.normal(size=(60, 10))
    v[rng.random((60, 10)) < 0.4] = np.nan
    v[::3] = rng.normal(size=(20, 10))
    v[6], v[7] = 5.0, np.where(np.isnan(v[7]), np.nan, 0.1)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "s long, lon double, lat double")
    series = spark.createDataFrame([(i, m, float(v[i, m])) for i in range(60) for m in range(10) if not np.isnan(v[i, m])], "s long, m int, v double")
    for places, reach in ((at, 1.2), (at, 60_000.0)):
        want = {}
        for a in range(60):
            for b in range(a + 1, 60):
                d = np.hypot(*(places[a] - places[b])) if reach < 10 else B.arc_metres(*places[a][:, None], *places[b][:, None])[0, 0]
                both = ~np.isnan(v[a]) & ~np.isnan(v[b])
                if d < reach and both.sum() >= 3:
                    flat = np.ptp(v[a, both]) == 0 or np.ptp(v[b, both]) == 0
                    want.setdefault(int(d // (reach / 3)), []).append(np.nan if flat else np.corrcoef(v[a, both], v[b, both])[0, 1])
        if reach < 10:
            got = J.band_correlations(points.select("s", F.col("lon").alias("x"), F.col("lat").alias("y")), series, "s", "m", "v", reach, reach / 3)
        else:
            got = P.band_correlations_on_sphere(points, series, "s", "m", "v", [reach / 3, 2 * reach / 3, reach])
        got = {r.band: (r.n_pairs, r.mean_r) for r in got.collect()}
        assert got.keys() == want.keys() and all(got[k] == (len(r), pytest.approx(np.nanmean(r))) for k, r in want.items())


@pytest.mark.parametrize("block", [7, 8192])
def test_band_correlations_of_all_pairs(spark, monkeypatch, block):
    """Without a reach no pair is left out, however far apart; stations without a finite position have no pairs."""
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "TILE", 16)
    rng = np.random.default_rng(12)
    at = np.vstack([rng.uniform(-5, 5, (30, 2)), rng.integers(90, 93, (10, 2)), [[-300.0, 40.0]]])
    v = rng.normal(1e4, 1.0, size=(41, 9))
    v[rng.random((41, 9)) < 0.3] = np.nan
    v[::4] = rng.normal(size=(11, 9))
    v[5] = 3.0
    lost = [(50, float("nan"), 1.0), (51, 1.0, float("inf")), (52, None, 1.0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + lost, "s long, x double, y double")
    series = [(i, m, float(v[i, m])) for i in range(41) for m in range(9) if not np.isnan(v[i, m])] + [(k, m, float(m)) for k, *_ in lost for m in range(9)]
    want = {}
    for a in range(41):
        for b in range(a + 1, 41):
            both = ~np.isnan(v[a]) & ~np.isnan(v[b])
            if both.sum() >= 3:
                want.setdefault(int(np.hypot(*(at[a] - at[b])) // 4), []).append(np.nan if 5 in (a, b) else np.corrcoef(v[a, both], v[b, both])[0, 1])
    series = spark.createDataFrame(series, "s long, m int, v double")
    got = {r.band: (r.n_pairs, r.mean_r) for r in J.band_correlations(points, series, "s", "m", "v", None, 4.0).collect()}
    assert max(got) > 90 and got.keys() == want.keys() and sum(n for n, _ in got.values()) == sum(map(len, want.values()))
    assert all(got[k] == (len(r), pytest.approx(np.nanmean(r)) if np.isfinite(r).any() else None) for k, r in want.items())
    assert J.band_correlations(points.limit(0), series, "s", "m", "v", None, 4.0).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_distance_band_pairs_are_all_pairs(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    got = plans.QUERIES["distance_band_pairs"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_pairs for r in got) == n * (n - 1) // 2 and max(r.band for r in got) > 20


def test_snapping_in_rounds_of_growing_reach(spark, monkeypatch):
    """As brute force, however often the radius is halved: crowded anchors, shared places, ties, points without a position."""
    rng = np.random.default_rng(11)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (80, 2)) / 2)] + [(900, None, 1.0)]
    a = [(i, float(x), float(y), int(w)) for i, (x, y, w) in enumerate(np.column_stack([rng.integers(0, 40, (70, 2)) / 2, rng.integers(0, 6, 70)]))]
    points, anchors = spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(a, "anchor_id long, ax double, ay double, weight int")
    def wanted(d):
        near = [[(-((w >= 1) + (w >= 3)), d(x, y, ax, ay), k) for k, ax, ay, w in a if w >= 1 and d(x, y, ax, ay) <= d(0, 0, 4, 0)] if x is not None else [] for _, x, y in p]
        return {q[0]: (min(n)[2], -min(n)[0]) if n else (None, None) for q, n in zip(p, near)}
    arc = lambda x, y, x2, y2: float(B.arc_metres(*[np.array([v], dtype=float) for v in (x, y, x2, y2)])[0, 0])
    globe = anchors.withColumnsRenamed({"ax": "lon", "ay": "lat"})
    for halved in (None, 5):
        if halved:
            monkeypatch.setattr(J, "crowding", lambda *_: {1: halved, 2: halved})
            monkeypatch.setattr(P, "crowding", lambda *_: {1: halved, 2: halved})
        plane = J.nearest_snap(points, anchors, 4.0, [1, 3], "id").collect()
        assert {r.id: (r.anchor_id, r.level) for r in plane} == wanted(lambda x, y, x2, y2: float(np.hypot(x - x2, y - y2)))
        sphere = P.snap_on_sphere(points.withColumnsRenamed({"x": "lon", "y": "lat"}), globe, arc(0, 0, 4, 0), [1, 3], "id").collect()
        assert {r.id: (r.anchor_id, r.level) for r in sphere} == wanted(arc)
        out = P.outside_buffer_on_sphere(points.withColumnsRenamed({"x": "lon", "y": "lat"}), globe.where("weight >= 1"), arc(0, 0, 4, 0)).collect()
        assert {r.id for r in out} == {k for k, v in wanted(arc).items() if v[0] is None}


def test_sums_in_extents_of_shared_places(spark):
    points = spark.createDataFrame([(1.0, 1.0)] * 3 + [(4.0, 1.0)], "x double, y double")
    extents = spark.createDataFrame([(1, 0.0, 3.0, 0.0, 3.0), (2, 0.0, 3.0, 0.0, 3.0), (3, 0.0, 9.0, 0.0, 9.0), (4, 1.0, 1.0, 0.0, 3.0)], "tile long, x0 double, x1 double, y0 double, y1 double")
    assert sorted(rows(P.sums_in_extents(points, extents, 2.0, F.col("x") + F.col("y")))) == [(1, 3, 6.0), (2, 3, 6.0), (3, 4, 11.0)]


def test_block_mode_ties_to_smaller(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 3), (1, 0, 5), (1, 1, 3)], "row int, col int, v int")
    assert rows(A.block_aggregate(df, 2, "v", "mode")) == [(0, 0, 3)]


def test_trimmed_composite_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)], "k string, v double")
    assert dict(rows(A.trimmed_composite(df, ["k"], "v"))) == {"a": 1.0, "b": 2.0}


def test_longest_run_first_on_ties_and_last(spark):
    m = 2000 * 12
    df = spark.createDataFrame([("t", m + i) for i in (0, 1, 5, 6)] + [("l", m + i) for i in (0, 3, 4, 5)] + [("s", m)], "k string, m int")
    got = {r.k: (r.run_start - m, r.run_months, r.n_runs) for r in T.longest_run(df, "k", "m").collect()}
    assert got == {"t": (0, 2, 2), "l": (3, 3, 2), "s": (0, 1, 1)}


def test_calendar_lags_cross_the_year(spark):
    df = spark.createDataFrame([("a", 2000 * 12 + 12, 1.0), ("a", 2001 * 12 + 1, 2.0), ("a", 2001 * 12 + 3, 4.0)], "k string, m int, q double")
    got = {r.m - 24000: (r.q1, r.q2) for r in T.calendar_lags(df, "k", "m", "q", (1, 2)).collect()}
    assert got == {12: (None, None), 13: (1.0, None), 15: (None, 2.0)}


def test_dense_ids_and_folds(spark):
    df = spark.createDataFrame([(g, i) for i, g in enumerate("baacdef")], "g string, i int")
    assert dict(rows(J.dense_ids(df, ["g"]))) == {c: i for i, c in enumerate("abcdef", 1)}
    assert J.group_kfold(df, "g", 2).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert J.dense_ids(df.limit(0), ["g"]).count() == 0


def test_thinned_points_are_apart_and_none_can_be_added(spark):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 60, (400, 2)), rng.uniform(20, 21, (200, 2)), np.repeat([[5.0, 5.0]], 50, 0), [[-3.5, -3.5]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9999, None, 1.0)], "k long, x double, y double")
    p = np.array([(r.x, r.y) for r in P.maximal_thinning(df, "k", 5.0).collect()])
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.eye(len(p)) * 99
    assert d.min() >= 5.0 and (np.linalg.norm(xy[:, None] - p[None], axis=2).min(1) < 5.0).all()
    assert P.maximal_thinning(df.limit(0), "k", 5.0).count() == 0


def test_align_check_counts(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert rows(J.align_check(a, b, ["k"])) == [(2, 1, 1)]
    assert rows(J.align_check(a.limit(0), b.limit(0), ["k"])) == [(0, 0, 0)]


EDGES = "id long, down_id long, w double"


def test_network_chain_star_and_lone_node(spark):
    chain = [(i, i - 1 if i > 1 else None, 1.0) for i in range(1, 10)]
    star = [(20, None, 1.0), *[(20 + i, 20, 1.0) for i in range(1, 5)]]
    df = spark.createDataFrame(chain + star + [(50, None, 2.0)], EDGES)
    acc = dict(rows(N.upstream_accumulate(df, "w")))
    assert [acc[i] for i in range(1, 10)] == [9.0 - i for i in range(9)]
    assert acc[20] == 5.0 and acc[50] == 2.0
    out = {r.id: (r.outlet, r.hops) for r in N.outlets(df).collect()}
    assert out[9] == (1, 8) and out[23] == (20, 1) and out[50] == (50, 0)
    assert sum(acc[i] for i in (1, 20, 50)) == 16.0
    assert dict(rows(N.members(df, df.where("id in (5, 20)")))) == {**{i: 5 for i in range(5, 10)}, **{i: 20 for i in range(20, 25)}}
    near = {r.id: (r.nearest, r.farthest) for r in N.headwater_distances(df).collect()}
    assert near[1] == (8, 8) and near[20] == (1, 1) and near[50] == (0, 0)
    assert dict(rows(N.shreve_order(df)))[20] == 4
    order = dict(rows(N.strahler_order(df)))
    assert order[20] == 2 and order[1] == 1
    assert dict(rows(N.strahler_by_basin(df.join(N.outlets(df).select("id", F.col("outlet").alias("basin")), "id")))) == order


def test_strahler_of_a_long_chain_and_of_random_trees(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None, 1.0) for i in range(1, 1001)], EDGES)
    assert {r.strahler for r in N.strahler_order(chain).collect()} == {1}
    rng = np.random.default_rng(9)
    tree = spark.createDataFrame([(i, int(i - 1) // 2 if i % 7 else int(rng.integers(0, i)) if i else None, 1.0) for i in range(60)], EDGES).withColumn("basin", F.lit(1))
    want = dict(rows(N.strahler_by_basin(tree)))
    assert max(want.values()) >= 3 and dict(rows(N.strahler_by_basin(tree, most=10))) == want
    with pytest.raises(Exception, match="cycle"):
        N.strahler_by_basin(spark.createDataFrame([(1, None, 1), (2, 3, 1), (3, 2, 1)], "id long, down_id long, basin int")).collect()


def test_network_cycle_raises(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_ROUNDS", 6)
    with pytest.raises(ValueError):
        N.upstream_accumulate(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], EDGES), "w")


def pooled(values):
    """Least-squares non-decreasing fit by pooling neighbours that fall."""
    blocks = []
    for v in values:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return [v for v, n in blocks for _ in range(n)]


def test_monotone_fits_equal_pooling(spark):
    rng = np.random.default_rng(1)
    arrays = [[1.0, 3.0, 2.0, 4.0], [], None, [5.0], [3.0, 2.0, 1.0], [2.0] * 11, *[rng.normal(i, 4, 11).tolist() for i in range(20)]]
    df = spark.createDataFrame(list(enumerate(arrays)), "i long, a array<double>")
    for r in S.monotone_quantiles(df, "a").collect():
        assert r.monotone == (None if arrays[r.i] is None else pytest.approx(pooled(arrays[r.i]), abs=1e-9))


def test_score_pack_of_perfect_predictions(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 6)], "o double, p double")
    r = S.score_pack(df, [], "o", "p").first()
    assert (r.r, r.nse, r.kge) == pytest.approx((1, 1, 1)) and r.rmse == 0


def test_draws_of_groups(spark):
    df = spark.createDataFrame([(g, i) for g in range(40) for i in range(3)] + [(None, 1)], "g long, i long")
    got = {r.g: r.draws for r in M.bootstrap_draws(df, "g", 30).collect()}
    k = np.array([got[g] for g in range(40)])
    assert k.shape == (40, 30) and (k.sum(0) == 40).all() and 0.25 < (k == 0).mean() < 0.5 and k.max() <= 10
    assert got == {r.g: r.draws for r in M.bootstrap_draws(df.repartition(5), "g", 30).collect()}
    assert M.bootstrap_draws(df.limit(0), "g", 30).count() == 0


def grown(x, y, w, depth):
    """A weighted regression tree by trying every cut of every column; values in, values out."""
    mean = (w * y).sum() / w.sum()
    best = None
    for j in range(x.shape[1]):
        cuts = np.unique(x[:, j])
        for c in (cuts[1:] + cuts[:-1]) / 2:
            left = x[:, j] <= c
            error = sum((w[s] * (y[s] - (w[s] * y[s]).sum() / w[s].sum()) ** 2).sum() for s in (left, ~left))
            if best is None or error < best[0] - 1e-9:
                best = (error, j, c)
    if depth == 0 or best is None or best[0] >= (w * (y - mean) ** 2).sum() - 1e-9:
        return lambda q: np.full(len(q), mean)
    _, j, c = best
    left = x[:, j] <= c
    a, b = grown(x[left], y[left], w[left], depth - 1), grown(x[~left], y[~left], w[~left], depth - 1)
    return lambda q: np.where(q[:, j] <= c, a(q), b(q))


def test_group_ranks_and_quantiles_stay_in_bounds(spark, monkeypatch):
    """Ranks inside groups are spread by their rows; the values of few keys aren't brought together by a shuffle on the key."""
    df = spark.range(1000).selectExpr("id % 50 as g", "cast(id * 7 % 31 as double) as x", "cast(id * id % 29 as double) as y")
    want = {r.g: (r.rho, r.n) for r in A.grouped_spearman(df, ["g"], "x", "y", large=True).collect()}
    monkeypatch.setattr(A, "RANKED_AT_ONCE", 100)
    got = A.grouped_spearman(df, ["g"], "x", "y")
    assert got.rdd.getNumPartitions() == 11
    assert {r.g: (pytest.approx(r.rho), r.n) for r in got.collect()} == want
    q = A.exact_quantiles(df.selectExpr("g % 2 as k", "x"), ["k"], "x", (0.5,))
    assert "BroadcastHashJoin" in q._jdf.queryExecution().executedPlan().toString() and q.count() == 2


def test_rows_with_equal_features_are_fitted_as_one(spark, monkeypatch):
    """Forests and searches see different vectors (per fold and block), not rows; the search's error is that of all rows."""
    df = spark.range(6000).selectExpr("id % 300 as g", "cast(id % 2 as double) as a", "cast(id % 5 as int) as b", "cast(id % 2 * 10 + id % 7 as double) as y")
    fitted, sizes = M.fitted_trees, []
    monkeypatch.setattr(M, "fitted_trees", lambda rows, *a: (sizes.append(rows.count()), fitted(rows, *a))[1])
    M.train_forest(df, ["a", "b"], "y", "g", trees=2, depth=2)
    assert sizes == [10]
    monkeypatch.setattr(M, "BLOCKS", 4)
    found = M.grid_search_forest(df, ["a"], "y", "g", depths=(2,), trees=(3,))
    assert found.avgMetrics == pytest.approx([2.0], rel=0.01)  # the deviation of 0 ... 6
    monkeypatch.setattr(M.CrossValidator, "fit", lambda self, cells: cells)
    cells = M.grid_search_forest(df, ["a"], "y", "g", depths=(2,), trees=(3,)).toPandas()
    assert len(cells) <= 3 * 4 * 2 and cells.weight.sum() == 6000


def test_forest_equals_numpy_trees_on_the_same_draws(spark):
    rng = np.random.default_rng(4)
    n, trees = 160, 12
    x, g = rng.integers(0, 12, (n, 2)).astype(float), rng.integers(0, 15, n)
    y = x[:, 0] * 3 + (x[:, 1] > 5) * 20 + rng.normal(0, 1, n)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, (b, c), d in zip(g, x, y)] + [(3, None, 1.0, 1.0), (99, 1.0, 1.0, None)], "g long, a double, b double, y double")
    models, scores = M.train_forest(df, ["a", "b"], "y", "g", trees, depth=3)
    draws = {r.g: r.draws for r in M.bootstrap_draws(df.where("y is not null and a is not null"), "g", trees).collect()}
    w = np.array([draws[k] for k in g.tolist()])
    fits = [grown(x[w[:, t] > 0], y[w[:, t] > 0], w[w[:, t] > 0, t], 3)(x) for t in range(trees)]
    out = np.array(fits).T
    unseen = np.where(w == 0, out, 0).sum(1) / np.maximum((w == 0).sum(1), 1)
    got = {r.g: r for r in scores.collect()}
    assert set(got) == set(g.tolist())
    for k, r in got.items():
        own = (g == k) & (w == 0).any(1)
        assert (r.n, r.n_scored) == ((g == k).sum(), own.sum())
        assert r.oob == pytest.approx(((unseen - y)[own] ** 2).mean(), rel=1e-6)
        assert (r.r is None) == (own.sum() <= 5) and (r.r is None or r.r == pytest.approx(np.corrcoef(unseen[own], y[own])[0, 1], abs=1e-6))
    table = M.predict_table(models, df.select("a", "b", F.lit("x").alias("label")), ["a", "b"]).collect()
    assert len(table) == n + 1 and sorted(r.prediction for r in table)[:n] == pytest.approx(sorted(np.maximum([*out.mean(1), table[-1].prediction], 0))[:n], abs=1e-6)
    few = M.mean_prediction(models, M.vectors(df, ["a", "b"]), "p", ["y"], counted_as="n", at_once=5).collect()
    assert {r.n for r in few} == {trees} and sorted(r.p for r in few) == pytest.approx(sorted(r.p for r in M.mean_prediction(models, M.vectors(df, ["a", "b"]), "p", ["y"]).collect()))


def test_commented_tsv(spark, tmp_path):
    (tmp_path / "a.rdb").write_text("# x\nagency_cd\tsite_no\tdatetime\t77_00060_00003\n5s\t15s\t20d\t14n\nUS\t01\t2000-01-31\t3.5\nUS\t01\tbad\tIce\n")
    assert rows(X.read_commented_tsv(spark, str(tmp_path), "_00060_00003")) == [("01", dt.date(2000, 1, 31), 3.5), ("01", None, None)]


def test_each_file_goes_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.rdb").write_text("site_no\tdatetime\t77_00060_00003\n01\t2000-01-31\t3.5\n")
    (tmp_path / "b.rdb").write_text("# other order\ndatetime\tx\t9_00060_00003\tsite_no\n20d\t5s\t14n\t15s\n2000-02-01\tA\t4.5\t02\n")
    (tmp_path / "c.rdb").write_text("03\t2000-03-01\t5.5\n")
    (tmp_path / "d.rdb").write_text("site_no\tdatetime\tflow\n04\t2000-04-01\t6.5\n")
    got = sorted(rows(X.read_commented_tsv(spark, str(tmp_path), "_00060_00003")))
    assert got == [("01", dt.date(2000, 1, 31), 3.5), ("02", dt.date(2000, 2, 1), 4.5), ("03", dt.date(2000, 3, 1), 5.5), ("04", dt.date(2000, 4, 1), 6.5)]


def test_planted_station_survives_the_pipeline(spark):
    """A station with one month of known values keeps them from raw values to joined quantiles."""
    raw = spark.createDataFrame([(999999, dt.date(2010, 6, d), 100.0) for d in range(1, 31)] + [(1, dt.date(2010, 6, 1), -9999.0)], "s long, d date, v double")
    q = A.monthly_quantiles(raw.select("s", "d", C.sentinel_to_null("v").alias("v")), "s", "d", "v")
    assert [(r.s, r.QMIN, r.QMAX, r.n_obs) for r in q.collect()] == [(999999, 100.0, 100.0, 30)]


def test_clumps_of_the_whole_grid(spark, tmp_path):
    from tidegrid import plans

    size = np.random.default_rng(4).choice([10, 30], 50 * 40)
    parts = spark.createDataFrame([(k, int(v)) for k, v in enumerate(size, 1)], "p_partkey long, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.row, r.col): (r["class"], r.clump) for r in plans.QUERIES["connected_clumps"](spark, str(tmp_path)).collect()}
    value = {(k // 50, k % 50): int(v > 20) for k, v in enumerate(size, 1)}
    want = {}
    for cell in sorted(value):  # the first cell met of a region is its smallest
        todo = [] if cell in want else [cell]
        name = cell[0] * 1000 + cell[1]
        while todo:
            r, c = at = todo.pop()
            if at not in want:
                want[at] = (value[at], name)
                todo += [(i, j) for i in (r - 1, r, r + 1) for j in (c - 1, c, c + 1) if value.get((i, j)) == value[at]]
    assert got == want
    assert max(r for (r, c), (_, name) in want.items() if name == want[0, 1][1] or name // 1000 < 8) > 8


def walked(down):
    """Each node of a forest (id -> down id or None) with the nodes from it to its outlet."""
    ways = {}
    for i in down:
        way = [i]
        while down[way[-1]] is not None:
            way.append(down[way[-1]])
        ways[i] = way
    return ways


def random_forest(n, seed, trees=3):
    rng = np.random.default_rng(seed)
    names = rng.permutation(n * 3)[:n].tolist()
    return {x: None if k < trees else names[int(rng.integers(max(0, k - 12), k))] for k, x in enumerate(names)}


def test_paths_of_a_long_chain_and_of_random_forests(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 1001)], "id long, down_id long")
    got = N.longest_path_nodes(chain).collect()
    assert sorted((r.place, r.id) for r in got) == [(k, 1000 - k) for k in range(1000)] and {r.outlet for r in got} == {1}
    down = random_forest(200, 7)
    ways = walked(down)
    edges = spark.createDataFrame(list(down.items()), "id long, down_id long")
    heads = set(down) - set(down.values())
    best = {}
    for h in sorted(heads, key=lambda x: (-len(ways[x]), x)):
        best.setdefault(ways[h][-1], h)
    want = sorted((o, k, x) for o, h in best.items() for k, x in enumerate(ways[h]))
    assert sorted(map(tuple, N.longest_path_nodes(edges).collect())) == want
    starts = spark.createDataFrame([(x,) for x in [*list(down)[:5], -1]], "id long")
    assert sorted(map(tuple, N.flow_paths(edges, starts).collect())) == sorted((s, k, x) for s in list(down)[:5] for k, x in enumerate(ways[s]))
    assert N.longest_path_nodes(edges.limit(0)).count() == 0


def test_intervals_and_links_answer_every_nested_membership(spark):
    down = random_forest(150, 11)
    ways = walked(down)
    edges = spark.createDataFrame(list(down.items()), "id long, down_id long")
    label = {r.id: r for r in N.interval_labels(edges).collect()}
    assert sorted(r.first for r in label.values()) == list(range(1, 151)) and all(label[i].outlet == ways[i][-1] for i in down)
    for u in down:
        for v in down:
            assert (v in ways[u]) == (label[v].first <= label[u].first <= label[v].last)
    chosen = sorted(down)[::4]
    links = {r.outlet: r.below for r in N.outlet_links(edges, spark.createDataFrame([(i,) for i in chosen], "id long")).collect()}
    assert links == {i: next((x for x in ways[i][1:] if x in chosen), None) for i in chosen}
    chain = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (1, None)], "id long, down_id long")
    assert rows(N.outlet_links(chain, chain.where("id in (1, 3)"))) in ([(3, 1), (1, None)], [(1, None), (3, 1)])
    assert N.interval_labels(edges.limit(0)).count() == 0


def test_headwater_lengths_and_rises(spark):
    down = random_forest(120, 5)
    ways = walked(down)
    rng = np.random.default_rng(2)
    length, height = {i: float(rng.integers(1, 4)) for i in down}, {i: float(rng.integers(0, 500)) for i in down}
    edges = spark.createDataFrame([(i, d, length[i], height[i]) for i, d in down.items()], "id long, down_id long, l double, z double")
    heads = set(down) - set(down.values())
    for r in N.headwater_distances(edges, "l", "z").collect():
        above = [(sum(length[x] for x in ways[h][: ways[h].index(r.id)]), h) for h in heads if r.id in ways[h]]
        near, far = min(above), max(above, key=lambda x: (x[0], -x[1]))
        assert (r.nearest, r.farthest) == (near[0], far[0]) and (r.nearest_rise, r.farthest_rise) == (height[near[1]] - height[r.id], height[far[1]] - height[r.id])


def test_clumps_of_a_long_winding_region(spark):
    """A snake whose way back to its smallest cell is longer than 200 steps, beside single cells and one without a value."""
    snake = [(r, c) for r in range(61) for c in range(9) if r % 2 == 0 or c == (8 if r % 4 == 1 else 0)]
    cells = [(r, c, 1) for r, c in snake] + [(100, 0, 1), (100, 2, 1), (101, 1, None)]
    got = {(x.row, x.col): tuple(x.clump) for x in N.connected_clumps(spark.createDataFrame(cells, "row long, col long, v int"), "v").collect()}
    assert got == dict.fromkeys(snake, (0, 0)) | {(100, 0): (100, 0), (100, 2): (100, 2), (101, 1): (101, 1)}


def test_clumps_of_large_regions_spread_over_keys(spark, monkeypatch):
    monkeypatch.setattr(N, "CLUMP_ROWS", 7)
    cells = [(r, c, int((r // 3 + c // 4) % 2 == 0)) for r in range(9) for c in range(12)]
    got = {(x.row, x.col): (x.v, tuple(x.clump)) for x in N.connected_clumps(spark.createDataFrame(cells, "row long, col long, v int"), "v").collect()}
    kind, seen = {(r, c): v for r, c, v in cells}, {}
    for start in sorted(kind):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen[x] = start
            todo += [(x[0] + a, x[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if kind.get((x[0] + a, x[1] + b)) == kind[start]]
    assert got == {k: (kind[k], seen[k]) for k in kind}


def test_holes_filled_by_means(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 4.0), (5, 5, None)], "row long, col long, v double")
    assert {(r.row, r.col): r.v for r in N.grow_fill(cells, "v", 1, "mean").collect()} == {(0, 0): 1.0, (0, 1): 2.5, (0, 2): 4.0, (5, 5): None}


def arcs(a, b):
    """Great-circle distances in metres of two lists of (lon, lat)."""
    a, b = np.radians(np.array(a, float).reshape(-1, 2)), np.radians(np.array(b, float).reshape(-1, 2))
    h = np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2
    return 2 * C.EARTH * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


@pytest.mark.parametrize("reach", [50.0, 40_000.0, 900_000.0, 4_500_000.0])
def test_neighbours_on_the_sphere_equal_brute_force(spark, reach):
    rng = np.random.default_rng(int(reach))
    step = np.degrees(reach / C.EARTH)
    corners = [(180.0, 0.0), (-180.0, 45.0), (0.0, 90.0), (77.0, -90.0), (179.999, 89.9), (-12.0, 80.0), (359.0, -60.0), (0.0, 0.0)]
    spots = [(lon + dx / max(np.cos(np.radians(lat)), 0.02), float(np.clip(lat + dy, -90, 90))) for lon, lat in corners for dx, dy in rng.uniform(-2 * step, 2 * step, (12, 2))] + corners
    spots = [(float((x + 180) % 360 - 180), float(y)) for x, y in spots]
    one = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)] + [(-1, None, 0.0)], "id long, lon double, lat double")
    two = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)] + [(-2, 1.0, None)], "other long, lon double, lat double")
    got = sorted((r.id, r.other) for r in P.near_on_sphere(one, two, reach).collect())
    want = sorted(map(tuple, np.argwhere(arcs(spots, spots) <= reach).tolist()))
    assert got == want and len(want) > 2 * len(spots)
    assert "NestedLoop" not in P.near_on_sphere(one, two, reach)._jdf.queryExecution().executedPlan().toString()


def test_snaps_buffers_and_bands_on_the_sphere(spark):
    p = spark.createDataFrame([(1, 179.95, 0.0), (2, 0.0, 0.0), (3, 10.0, 89.99)], "id long, lon double, lat double")
    a = spark.createDataFrame([(7, -179.95, 0.0, 5), (8, 179.94, 0.0, 1), (9, -170.0, 89.99, 1)], "anchor_id long, lon double, lat double, weight int")
    got = {r.id: (r.anchor_id, r.level) for r in P.snap_on_sphere(p, a, 20_000.0, [1, 3], "id").collect()}
    assert got == {1: (7, 2), 2: (None, None), 3: (9, 1)}
    assert [r.id for r in P.outside_buffer_on_sphere(p, a, 20_000.0).collect()] == [2]
    line = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 0.05, 0.2, 0.5, 3.0, 8.0))], "s long, lon double, lat double")
    pairs = {(r.a, r.b): (r.d, r.band) for r in P.pairs_on_sphere(line, "s").collect()}
    spots = [(x, 0.0) for x in (0, 0.05, 0.2, 0.5, 3.0, 8.0)]
    d = arcs(spots, spots)
    assert pairs == {(i, j): (pytest.approx(d[i, j]), int(np.searchsorted(P.BAND_LIMITS, d[i, j], side="right"))) for i in range(6) for j in range(i + 1, 6) if d[i, j] < 500_000}
    assert {b for _, b in pairs.values()} == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        P.SphereBins(6_000_000.0)


def test_points_in_extents_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    low, size = rng.uniform(-50, 50, (60, 2)), rng.choice([0.0, 0.3, 5.0, 40.0, 3000.0], (60, 2))
    tiles = [(i, float(a), float(a + w), float(b), float(b + h)) for i, ((a, b), (w, h)) in enumerate(zip(low, size))]
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-60, 60, (200, 2)))] + [(900, tiles[3][1], tiles[3][3]), (901, tiles[3][2], tiles[3][4]), (902, None, 1.0)]
    extents = spark.createDataFrame([*tiles, (99, None, 1.0, 0.0, 1.0)], "tile long, x0 double, x1 double, y0 double, y1 double")
    points = spark.createDataFrame(spots, "id long, x double, y double")
    found = P.points_in_extents(points, extents, 2.0)
    want = sorted((i, t) for i, x, y in spots if x is not None for t, a, b, c, d in tiles if a <= x < b and c <= y < d)
    assert sorted((r.id, r.tile) for r in found.collect()) == want and len(want) > 300
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert P.points_in_extents(points, extents.limit(0), 2.0).count() == 0


def test_kernels_equal_brute_force_near_and_wide(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(-30, 2_000_000, (12, 2)), [[1000.0, 1000.0], [1000.0, 1000.0], [1500.0, 500.0]]])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy] + [(None, 1.0)], "x double, y double")
    for size, radius in ((1000.0, 30_000.0), (1000.0, 1000.0), (700.0, 300.0)):
        want = {}
        for x, y in xy:
            n = int(radius // size) + 2
            for r in range(int(y // size) - n, int(y // size) + n + 1):
                for c in range(int(x // size) - n, int(x // size) + n + 1):
                    d = (((c + 0.5) * size - x) ** 2 + ((r + 0.5) * size - y) ** 2) / radius**2
                    if d < 1:
                        want[r, c] = want.get((r, c), 0.0) + 10 * (1 - d) ** 2
        got = {(r.row, r.col): r.density for r in S.kernel_density(df, size, radius).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    wide = S.kernel_density(one, 1000.0, 200_000.0).agg(F.count("*").alias("n"), F.sum("density").alias("s")).first()
    assert wide.n == pytest.approx(np.pi * 200**2, rel=1e-3) and wide.s == pytest.approx(10 * np.pi * 200**2 / 3, rel=1e-4)  # the volume under the kernel
    assert S.kernel_density(one.limit(0), 1000.0, 5000.0).count() == 0


def test_matrices_of_many_columns_equal_numpy(spark):
    """Missing values, large offsets, a column without variance and one without values."""
    import pandas as pd

    rng = np.random.default_rng(2)
    n, p = 400, 17
    x = rng.normal(0, 1, (n, 4)) @ rng.normal(0, 1, (4, p)) + rng.normal(0, 0.5, (n, p)) + 10.0 ** rng.integers(0, 9, p)
    x[rng.random((n, p)) < 0.15] = np.nan
    x[:, 3], x[:, 5], x[:, 7] = 7.25, np.nan, np.round(x[:, 7])
    names = [f"c{i:02d}" for i in range(p)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    frame = pd.DataFrame(x, columns=names)
    for found, method in ((A.corr_matrix(df, names), "pearson"), (A.rank_matrix(df, names), "spearman")):
        got = {(r.a, r.b): r.r for r in found.collect()}
        base = frame if method == "pearson" else frame.rank()
        want = base.corr()
        assert len(got) == p * (p - 1) // 2
        for (a, b), r in got.items():
            flat = np.isnan(want.loc[a, b]) or {"c03", "c05"} & {a, b}
            assert (r is None) if flat else r == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)
    few = {(r.a, r.b): r.r for r in A.corr_matrix(df, names[8:12]).collect()}
    assert all(r == pytest.approx(frame.corr().loc[a, b], abs=1e-7) for (a, b), r in few.items())
    assert all(r.n == 0 and r.r is None for r in X2.many_correlations(df.limit(0), names[:3]).collect())


def test_a_hundred_columns_need_two_shuffles_of_rows(spark):
    names = [f"c{i:03d}" for i in range(100)]
    df = spark.range(50).select(*[((F.col("id") * (i + 3) % 41) + F.rand(i)).alias(c) for i, c in enumerate(names)])
    found = X2.many_correlations(df, names)
    assert found.count() == 4950 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_lag_search_equals_numpy_where_targets_are_missing(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    rows_ = []
    for s in range(6):
        for m in sorted(rng.choice(60, 40, replace=False).tolist()):
            v = rng.normal(size=4).round(1).tolist()
            rows_.append((s, m, v[0], None if rng.random() < 0.2 else v[1], v[2], None if rng.random() < 0.3 else v[3]))
    df = spark.createDataFrame(rows_, "s long, m long, x1 double, x2 double, y1 double, y2 double")
    frame = pd.DataFrame(rows_, columns=["s", "m", "x1", "x2", "y1", "y2"]).astype(float)
    got = {(r.variable, r.target, r.lag): (r.rho, r.n) for r in X2.lagged_correlations(df, "s", "m", ["x1", "x2"], ["y1", "y2"], (0, 1, 2)).collect()}
    assert len(got) == 12
    for (x, y, k), (rho, n) in got.items():
        j = frame[["s", "m", y]].merge(frame[["s", "m", x]].assign(m=frame.m + k), on=["s", "m"], suffixes=("", "_x")).dropna()
        assert n == len(j) and rho == pytest.approx(j[[x, y]].corr("spearman").iloc[0, 1], abs=1e-9)
    same = {(r.variable, r.target, r.lag): r.rho for r in X2.lagged_correlations(df, "s", "m", ["x1"], ["x1"], (0, 1)).collect()}
    assert same["x1", "x1", 0] == pytest.approx(1.0)


def test_lag_search_moves_no_single_values(spark, monkeypatch):
    """Ranks of few values are sent to the rows: only the window by station and the merging of sums shuffle. Shuffled ranks give the same, in blocks too."""
    df = spark.range(3000).selectExpr("id % 30 AS s", "id div 30 AS m", "cast(id * 7 % 11 AS double) AS x1", "if(id % 6 = 0, null, cast(id * 5 % 13 AS double)) AS x2", "if(id % 5 = 0, double('nan'), id * 37 % 101) AS y1", "cast(id * id % 23 AS double) AS y2")
    values = lambda found: {(r.variable, r.target, r.lag): (r.n, pytest.approx(r.rho, abs=1e-9)) for r in found.collect()}
    search = lambda: X2.lagged_correlations(df, "s", "m", ["x1", "x2"], ["y1", "y2"], (0, 1))
    found = search()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    want = {k: (n, rho.expected) for k, (n, rho) in values(found).items()}
    assert len(want) == 8
    monkeypatch.setattr(X2, "small_or_shuffled", lambda lookup: lookup)
    assert want == values(search())
    monkeypatch.setattr(X2, "FEW_COLUMNS", 1)
    assert want == values(search())


def test_middle_rows_give_the_median(spark):
    import pandas as pd

    rows_ = [("a", 3.0), ("a", 1.0), ("a", None), ("b", 4.0), ("b", 1.0), ("b", 1.0), ("b", 9.0), ("b", None), ("c", None), (None, 5.0), (None, 6.0), (None, 6.0), ("d", 2.0)]
    df = spark.createDataFrame(rows_, "k string, v double").repartition(3)
    got = {r.k: (r.m, r.n) for r in A.with_middle(df, ["k"], "v", "mid").groupBy("k").agg(F.avg("mid").alias("m"), F.count("*").alias("n")).collect()}
    want = pd.DataFrame(rows_, columns=["k", "v"]).groupby("k", dropna=False).v.agg(["median", "size"])
    assert got == {(None if pd.isna(k) else k): (None if pd.isna(m) else m, n) for k, m, n in want.itertuples()}


def test_ranks_of_few_columns_come_to_their_rows(spark, monkeypatch):
    """No row is shuffled for ranks of few values; ranks of many values come by shuffled joins, with the same results."""
    import pandas as pd

    names = ["a", "b", "c"]
    df = spark.range(2000).selectExpr("cast(id * 7 % 11 AS double) AS a", "if(id % 3 = 0, null, cast(id * 5 % 977 AS double)) AS b", "if(id % 7 = 0, double('nan'), cast(id * id % 89 AS double)) AS c").repartition(3)
    want = pd.DataFrame([tuple(r) for r in df.collect()], columns=names).astype(float).rank().corr()
    near = lambda found: {(r.a, r.b): r.r for r in found.collect()} == {(a, b): pytest.approx(want.loc[a, b], abs=1e-9) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    found = A.rank_matrix(df, names)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert near(found)
    monkeypatch.setattr(X2, "small_or_shuffled", lambda lookup: lookup)
    assert near(A.rank_matrix(df, names))
    assert all(r.r is None for r in A.rank_matrix(df.limit(0), names).collect())


def test_interactions_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 1, (200, 3))
    y = x[:, 0] * x[:, 1] + rng.normal(0, 0.1, 200)
    x[rng.random((200, 3)) < 0.1] = np.nan
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    for r in X2.interactions(df, ["a", "b", "c"], "y").collect():
        p, q = "abc".index(r.a), "abc".index(r.b)
        ok = ~np.isnan(x[:, p] + x[:, q])
        c = lambda v: abs(np.corrcoef(v[ok], y[ok])[0, 1])
        assert r.n == ok.sum() and (r.r_both, r.r_a, r.r_b) == pytest.approx((c(x[:, p] * x[:, q]), c(x[:, p]), c(x[:, q])), abs=1e-9)
        assert r.keep == (r.r_both > 0.5 * max(r.r_a, r.r_b))


def test_two_sided_tail_equals_the_error_function(spark):
    import math

    z = [0.0, 1e-9, -0.5, 1.0, 1.959963984540054, -3.3, 4.9999, 5.0001, 8.0, 20.0, 37.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(C.two_sided("z").alias("p")).collect()]
    for v, p in zip(z, got):
        want = math.erfc(abs(v) / math.sqrt(2))
        assert abs(p - want) <= 1e-9 * max(want, 1e-6) if abs(v) < 5 else p == pytest.approx(want, rel=1e-9)


def test_rank_sum_with_ties_by_hand(spark):
    import math

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 40).tolist(), rng.integers(1, 8, 25).tolist()
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("a", None), (None, 3)], "g string, v long")
    both = np.array(a + b)
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    w = rank[:40].sum() - 40 * 41 / 2
    ties = sum(t**3 - t for t in np.unique(both, return_counts=True)[1])
    std = math.sqrt(40 * 25 / 12 * (66 - ties / (65 * 64)))
    off = w - 500
    r = A.rank_sum(df, "g", "a", "v").first()
    assert (r.w, r.n1, r.n2) == (w, 40, 25) and r.z == pytest.approx(off / std, abs=1e-12)
    assert r.p == pytest.approx(math.erfc(abs(off - math.copysign(0.5, off)) / std / math.sqrt(2)), rel=1e-9)


def test_first_by_hash_equals_a_sort(spark):
    from hashlib import md5

    data = [(i, "hot" if i % 3 else f"t{i % 7}") for i in range(3000)] + [(9000, None), (9001, None)]
    df = spark.createDataFrame(data, "k long, tile string")
    order = lambda i, seed="points": (md5(f"{i}{seed}".encode()).hexdigest(), i)
    got = [r.k for r in J.first_by_hash(df, "k", F.lit(100), rows=50).collect()]
    assert sorted(got) == sorted(sorted((i for i, _ in data), key=order)[:100])
    tiles = {}
    for i, t in data:
        tiles.setdefault(t, []).append(i)
    got = {(r.k, r.tile) for r in J.first_by_hash(df, "k", F.floor(F.col("_n") / 3), ["tile"], rows=20).collect()}
    assert got == {(i, t) for t, ids in tiles.items() for i in sorted(ids, key=order)[: len(ids) // 3]}
    assert J.first_by_hash(df, "k", F.lit(10**9)).count() == len(data) and J.first_by_hash(df, "k", F.lit(0)).count() == 0 and J.first_by_hash(df.limit(0), "k", F.lit(5)).count() == 0


def test_cv_filter_keeps_the_top_ten_where_few_pass(spark):
    cv = spark.createDataFrame([(f"v{i:02d}", i / 100, 1.0) for i in range(12)], "variable string, mad_cv double, std_cv double")
    names = lambda d: sorted(r.variable for r in d.collect())
    assert names(S.cv_filter(cv, 0.05)) == [f"v{i:02d}" for i in range(5, 12)]
    assert names(S.cv_filter(cv, 0.08)) == [f"v{i:02d}" for i in range(2, 12)]
    assert names(S.cv_filter(cv.limit(4), 0.02)) == ["v02", "v03"]
    assert names(S.cv_filter(cv, 0.08, least=1)) == ["v08", "v09", "v10", "v11"]


def test_collinear_variables_of_other_processes_stay(spark):
    r = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("b", "c", 0.1)], "a string, b string, r double")
    strength = {"a": 1.0, "b": 0.5, "c": 2.0}
    assert S.collinearity_prune(r, strength, 0.8) == ["b", "c"]
    assert S.collinearity_prune(r, strength, 0.8, {"a": "x", "b": "x", "c": "y"}) == ["a", "c"]


def test_zones_small_and_large_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(None if g == 3 else int(g), None if v > 95 else float(v)) for g, v in zip(rng.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 100, 500))] + [(9, None)], "g long, v double")
    small = sorted(map(tuple, A.zonal_stats(df, "g", "v", (0.05, 0.5, 0.95)).collect()), key=str)
    monkeypatch.setattr(A, "SMALL_ZONE", 10)
    large = sorted(map(tuple, A.zonal_stats(df, "g", "v", (0.05, 0.5, 0.95)).collect()), key=str)
    assert len(small) == 5 and all(a == pytest.approx(b, nan_ok=True) if None not in a else a == b for a, b in zip(small, large))


def test_clusters_with_a_large_one(spark):
    df = spark.createDataFrame([(c, s, float(c + s), float(v)) for c in (1, 2) for s in range(3) for v in range(1, 5 + s + c)] + [(None, 7, 1.0, 2.0)], "c long, s long, x double, q double")
    got = {r.c: r for r in A.cluster_characteristics(df, "c", "s", "x", "q").collect()}
    for c in (1, 2):
        each = [np.arange(1, 5 + s + c) for s in range(3)]
        every = np.concatenate(each)
        r = got[c]
        assert (r.n_stations, r.n_obs, r.spread) == (3, len(every), 2.0) and r["mean"] == pytest.approx(every.mean())
        assert r.high_low == pytest.approx(np.quantile(every, 0.9) / np.quantile(every, 0.1)) and r.mean_q50 == pytest.approx(np.mean([np.median(v) for v in each]))
    assert got[None].n_stations == 1


def test_state_stays_compact_over_batches_and_repeats(spark, tmp_path):
    """Folders of superseded months go, months are right after each batch, and a repeated batch changes nothing."""
    import os
    import shutil

    from tidegrid.streaming import incremental as I

    source, target, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    schema = "station long, date timestamp, value double"
    seen = []
    for k in range(5):
        part = [(s, dt.datetime(2001, m, 1 + k), float(10 * m + k)) for s in (1, 2) for m in ((1, 2) if k % 2 else (2, 3))] + [(1, None, 5.0)]
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        I.incremental_quantiles(spark, source, schema, target, progress)
        if k == 3:  # the last batch once more, as after a failure before its commit
            for name in (str(k), f".{k}.crc"):
                os.remove(os.path.join(progress, "commits", name))
            shutil.rmtree(os.path.join(target, "index", f"batch={k}"))
            I.incremental_quantiles(spark, source, schema, target, progress)
        want = {}
        for s, d, v in seen:
            if d is not None:
                want.setdefault((s, d.year, d.month), []).append(v)
        got = {(r.station, r.yyyy, r.mm): (r.n_obs, r.QMIN, r.QMAX) for r in I.current_quantiles(spark, target).collect()}
        assert got == {key: (len(v), min(v), max(v)) for key, v in want.items()}
        held = [(b, m) for b in os.listdir(f"{target}/raw") if b.startswith("batch") for m in os.listdir(f"{target}/raw/{b}") if m.startswith("ym")]
        assert len(held) <= 6 and len(os.listdir(f"{target}/index")) <= 2 + 2  # two versions of three months at most
    assert not I._has(spark, f"{target}/fresh/batch=4")
