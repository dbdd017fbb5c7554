"""Every query with SQL against DuckDB on the smallest tables; the values of the others by what must hold of them."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegrid import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) & set(plans.ORACLES)))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    as_text = lambda s: s.astype(str) if s.dtype == object else s
    a = got[cols].sort_values(cols, key=as_text).reset_index(drop=True)
    b = want[cols].sort_values(cols, key=as_text).reset_index(drop=True)
    for c in cols:
        if a[c].dtype.kind in "fiub":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=2e-6, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_strahler_sql_lists_every_order():
    """A network of 2**15 headwaters has nodes of order 16: the SQL must list them too."""
    c = duckdb.connect()
    c.execute("create view customer as select i + 1 as c_custkey, 0.0 as c_acctbal from range(131071) t(i)")
    for name in ("stream_order_strahler", "stream_order_strahler_by_basin"):
        n, top = c.execute(f"select count(*), max(strahler) from ({plans.ORACLES[name]})").fetchall()[0]
        assert (n, top) == (131071, 16)


def run(spark, name):
    return plans.QUERIES[name](spark, SF).toPandas()


WITHOUT_SQL = {"approx_monthly_quantiles", "quantile_transform_normal", "spatial_kmeans", "train_forest", "forest_per_quantile", "grid_search_forest", "predict_table"}


def test_every_query_is_held_to_values():
    assert set(plans.QUERIES) - set(plans.ORACLES) == WITHOUT_SQL


def test_approximate_quantiles_by_rank(spark):
    """Each sketched quantile is a value of its month with a rank near its place."""
    got, orders = run(spark, "approx_monthly_quantiles"), pd.read_parquet(f"{SF}/orders.parquet")
    values = orders.groupby(["o_custkey", orders.o_orderdate.dt.year, orders.o_orderdate.dt.month]).o_totalprice.apply(lambda v: np.sort(v.to_numpy()))
    assert len(got) == len(values)
    for r in got.itertuples():
        v = values[(r.o_custkey, r.yyyy, r.mm)]
        assert r.QMIN == v[0] and r.QMAX == v[-1]
        for p, q in zip(range(1, 10), r[5:14]):
            assert q in v and abs(np.searchsorted(v, q, side="right") - p / 10 * len(v)) <= 1


def test_normal_scores(spark):
    from statistics import NormalDist

    got = run(spark, "quantile_transform_normal").dropna()
    assert got.u.between(0, 1).all()
    want = [NormalDist().inv_cdf(min(1 - 1e-7, max(1e-7, u))) for u in got.u]
    np.testing.assert_allclose(got.z, want, atol=6e-4)


def test_kmeans_is_a_fixed_point(spark):
    """Every point is in the cluster with the nearest centre, and there are as many clusters as asked for."""
    got, c = run(spark, "spatial_kmeans"), pd.read_parquet(f"{SF}/customer.parquet")
    j = got.merge(c, on="c_custkey")
    assert len(j) == len(c) and j.cluster.nunique() == 20
    x = j[["c_acctbal", "c_nationkey"]].to_numpy(float)
    centres = np.array([x[j.cluster == k].mean(0) for k in range(20)])
    own = np.linalg.norm(x - centres[j.cluster], axis=1)
    nearest = np.linalg.norm(x[:, None] - centres[None], axis=2).min(1)
    assert (own <= nearest + 1e-6).mean() > 0.9 and (own**2).sum() < 0.05 * ((x - x.mean(0)) ** 2).sum()


def test_forests(spark):
    """Errors of unseen groups stay near the variance or below it; importances sum up to one; predictions stay among the prices."""
    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    oob = run(spark, "train_forest")
    assert sorted(oob.l_suppkey) == sorted(lines.l_suppkey.unique()) and (oob.n_scored == oob.n).all() and 0 < oob.oob.mean() < 1.3 * lines.l_extendedprice.var()
    assert oob.r.between(-1, 1).all()
    w = run(spark, "forest_per_quantile")
    assert len(w) == 9 and (w.importance >= 0).all() and w.groupby("target").importance.sum().tolist() == pytest.approx([1.0] * 3)
    grid = run(spark, "grid_search_forest")
    assert len(grid) == 8 and set(grid.trees) == {5, 10} and grid.rmse.between(1, 1.2 * lines.l_extendedprice.std()).all()
    p = run(spark, "predict_table")
    assert len(p) == len(lines) and p.prediction.between(0, lines.l_extendedprice.max()).all()
