"""Queries of the aggregation family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import aggregates as A
from tidegrid.operators import cells as L
from tidegrid.operators import tables as J
from tidegrid.plans.registry import Tables, query, r6, rounded

_Q = A.QUANTILES


def _quantile_sql(source: str, station: str, date: str, value: str, least: int = 1) -> str:
    cols = ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {n}" for n, p in zip(_Q, A.PROBS))
    return f"SELECT {station}, year({date})::INT AS yyyy, month({date})::INT AS mm, count(*)::BIGINT AS n_obs, {cols} FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}"


@query(_quantile_sql("orders", "o_custkey", "o_orderdate", "o_totalprice"))
def monthly_quantiles(t: Tables) -> DataFrame:
    return rounded(A.monthly_quantiles(t.orders, "o_custkey", "o_orderdate", "o_totalprice"), *_Q)


@query(_quantile_sql("events", "user_id", "ts", "value", 3))
def monthly_quantiles_min_obs(t: Tables) -> DataFrame:
    return rounded(A.monthly_quantiles(t.events, "user_id", "ts", "value", 3), *_Q)


@query()
def approx_monthly_quantiles(t: Tables) -> DataFrame:
    return A.approx_monthly_quantiles(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY ALL")
def group_sum(t: Tables) -> DataFrame:
    out = A.group_sum(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 2) for c in ("sum_l_quantity", "sum_l_extendedprice")})


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def pairwise_corr(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(C.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY ALL")
def linear_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(C.slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), r6(C.corr(y, x)).alias("r"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n FROM (SELECT {_RANK.format('l_quantity')} AS rx, {_RANK.format('l_extendedprice')} AS ry FROM lineitem)")
def spearman(t: Tables) -> DataFrame:
    return rounded(A.spearman(t.lineitem, "l_quantity", "l_extendedprice"), "rho")


_GRANK = "rank() OVER (PARTITION BY l_suppkey ORDER BY {0}) + (count(*) OVER (PARTITION BY l_suppkey, {0}) - 1) / 2.0"


@query(f"SELECT l_suppkey, round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n FROM (SELECT l_suppkey, {_GRANK.format('l_quantity')} AS rx, {_GRANK.format('l_extendedprice')} AS ry FROM lineitem) GROUP BY ALL")
def spearman_by_group(t: Tables) -> DataFrame:
    return rounded(A.grouped_spearman(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice"), "rho")


_M = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_M) for b in _M[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(t: Tables) -> DataFrame:
    return rounded(A.corr_matrix(t.lineitem, _M), "r")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ln(1 + {a}), ln(1 + {b})), 6) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix_log(t: Tables) -> DataFrame:
    return rounded(A.corr_matrix(t.lineitem.select(*[F.log(1 + F.col(c)).alias(c) for c in _M]), _M), "r")


@query("""WITH c AS (SELECT unnest(range(10))::INT AS decile, unnest(quantile_cont(l_quantity, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS lim FROM lineitem)
SELECT decile, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*)::BIGINT AS n FROM lineitem JOIN c ON l_quantity >= lim GROUP BY decile""")
def corr_above_deciles(t: Tables) -> DataFrame:
    return rounded(A.corr_above_deciles(t.lineitem, "l_quantity", "l_extendedprice"), "r")


@query("""WITH d AS (SELECT l_extendedprice * (1 - l_discount) - l_extendedprice * (1 - l_tax) AS d FROM lineitem)
SELECT round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, round(quantile_cont(d, 0.1), 6) AS d10, round(quantile_cont(d, 0.9), 6) AS d90,
round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(median(abs(d)), 6) AS median_abs FROM d""")
def difference_stats(t: Tables) -> DataFrame:
    two = t.lineitem.select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("b"))
    return rounded(A.difference_stats(two, "a", "b"), "mean_diff", "median_diff", "d10", "d90", "mae", "rmse", "median_abs")


_ERF = "(1 - exp(-x * x) * (SELECT sum(exp((2 * k + 1) * ln(x) - lgamma(k + 1.5))) FROM range(90) t(k)))"


@query(f"""WITH v AS (SELECT o_orderstatus = 'F' AS g, floor(o_totalprice / 1000) AS v FROM orders), r AS (SELECT g, {_RANK.format('v')} AS r, count(*) OVER (PARTITION BY v) AS t FROM v),
s AS (SELECT sum(r) FILTER (g) AS s, count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(t * t - 1)::DOUBLE AS ties, count(*)::DOUBLE AS n FROM r),
d AS (SELECT *, s - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS off, sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS std FROM s), e AS (SELECT *, (abs(off) - 0.5) / std / sqrt(2) AS x FROM d)
SELECT round(s - n1 * (n1 + 1) / 2, 3) AS w, n1::BIGINT AS n1, n2::BIGINT AS n2, round(off / std, 6) AS z, round({_ERF}, 6) AS p FROM e""")
def rank_sum_test(t: Tables) -> DataFrame:
    """Prices in thousands, so that many are tied."""
    found = A.rank_sum(t.orders.select("o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("v")), "o_orderstatus", "F", "v")
    return found.select(F.round("w", 3).alias("w"), "n1", "n2", r6("z").alias("z"), r6("p").alias("p"))


@query("""SELECT c_nationkey, count(c_acctbal)::BIGINT AS n, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std,
round(sum(c_acctbal), 2) AS sum, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(quantile_cont(c_acctbal, 0.95), 6) AS p95 FROM customer GROUP BY ALL""")
def zonal_stats(t: Tables) -> DataFrame:
    out = A.zonal_stats(t.customer, "c_nationkey", "c_acctbal", (0.05, 0.95))
    return rounded(out, "mean", "std", "p05", "p95").withColumn("sum", F.round("sum", 2))


@query("SELECT n_regionkey, round(sum(s_acctbal), 2) AS total, count(*)::BIGINT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def zonal_merge(t: Tables) -> DataFrame:
    tiles = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("total"), F.count("*").alias("n"))
    return L.merged_zones(tiles, t.nation, "n_nationkey", "n_regionkey", ["total", "n"]).withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS area FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def cross_tab_area(t: Tables) -> DataFrame:
    return L.cross_tab_area(t.lineitem.where("l_returnflag <> 'N'"), "l_returnflag", "l_linestatus", "l_quantity").withColumn("area", F.round("area", 2))


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_size > 0 GROUP BY ALL")
def class_histogram(t: Tables) -> DataFrame:
    return L.class_histogram(t.part, "p_brand", F.col("p_size") > 0)


@query("SELECT c_nationkey, count(*) FILTER (c_acctbal < 0)::BIGINT AS n_nodata FROM customer GROUP BY ALL")
def nodata_count(t: Tables) -> DataFrame:
    return L.nodata_count(t.customer, "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).drop("n")


@query("""WITH z AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY ALL), r AS (SELECT min(s_acctbal) AS rlo, max(s_acctbal) AS rhi FROM supplier)
SELECT c_nationkey, lo, hi, lo < rlo AS below, hi > rhi AS above FROM z, r WHERE lo < rlo OR hi > rhi""")
def range_check(t: Tables) -> DataFrame:
    return L.range_check(t.customer, "c_nationkey", "c_acctbal", t.supplier, "s_acctbal")


@query("SELECT (user_id // 10)::BIGINT AS cell, round(median(value), 6) AS med, round(median(value * value), 6) AS med_sq FROM events GROUP BY ALL")
def point_to_grid_median(t: Tables) -> DataFrame:
    v = F.col("value")
    return rounded(L.grid_medians(t.events, F.floor(F.col("user_id") / 10), {"med": v, "med_sq": v * v}).drop("n"), "med", "med_sq")


@query("""SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS min, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.1), 6) AS p10,
round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(stddev_pop(o_totalprice), 6) AS std, count(*)::BIGINT AS nvalid FROM orders GROUP BY ALL""")
def temporal_profile(t: Tables) -> DataFrame:
    return rounded(L.temporal_profile(t.orders, ["o_custkey"], "o_totalprice"), "mean", "median", "p10", "p90", "std")


@query("SELECT o_custkey, month(o_orderdate)::INT AS mm, round(avg(o_totalprice), 6) AS clim FROM orders GROUP BY ALL")
def monthly_climatology(t: Tables) -> DataFrame:
    return rounded(L.climatology(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice").drop("n"), "clim")


@query("SELECT o_custkey, ((dayofyear(o_orderdate) - 1) // 16)::BIGINT AS slot, round(median(o_totalprice), 6) AS composite FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def quality_composite(t: Tables) -> DataFrame:
    return rounded(L.slot_composite(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice", F.col("o_orderstatus") == "O").drop("n"), "composite")


@query("""WITH q AS (SELECT o_custkey AS k, quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi, median(o_totalprice) AS m FROM orders GROUP BY ALL),
i AS (SELECT k, median(o_totalprice) AS t FROM orders JOIN q ON k = o_custkey WHERE o_totalprice > lo AND o_totalprice < hi GROUP BY k)
SELECT q.k AS o_custkey, round(coalesce(t, m), 6) AS composite FROM q LEFT JOIN i ON q.k = i.k""")
def trimmed_composite(t: Tables) -> DataFrame:
    return rounded(A.trimmed_composite(t.orders, ["o_custkey"], "o_totalprice"), "composite")


@query("""WITH y AS (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders), c AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS k FROM orders GROUP BY ALL)
SELECT o_custkey, (k = n)::INT AS permanent FROM c, y""")
def permanent_class(t: Tables) -> DataFrame:
    return L.permanent_class(t.orders, "o_custkey", "o_orderdate").select("o_custkey", "permanent")


def _grid(t: Tables) -> DataFrame:
    """Parts as a grid of 50 columns."""
    return t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), "p_retailprice", "p_size")


_GRID = "(SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice, p_size FROM part)"


@query(f"SELECT (row // 4)::BIGINT AS brow, (col // 4)::BIGINT AS bcol, round(sum(p_retailprice), 4) AS s, round(avg(p_retailprice), 6) AS m, max(p_retailprice) AS x FROM {_GRID} GROUP BY ALL")
def block_aggregate(t: Tables) -> DataFrame:
    g, v, on = _grid(t), "p_retailprice", ["brow", "bcol"]
    parts = [A.block_aggregate(g, 4, v, how).withColumnRenamed(v, n) for how, n in (("sum", "s"), ("mean", "m"), ("max", "x"))]
    return parts[0].join(parts[1], on).join(parts[2], on).select(*on, F.round("s", 4).alias("s"), r6("m").alias("m"), "x")


@query(f"""WITH c AS (SELECT row // 4 AS brow, col // 4 AS bcol, p_size, count(*) AS n FROM {_GRID} GROUP BY ALL)
SELECT brow::BIGINT AS brow, bcol::BIGINT AS bcol, p_size FROM c QUALIFY row_number() OVER (PARTITION BY brow, bcol ORDER BY n DESC, p_size) = 1""")
def block_mode(t: Tables) -> DataFrame:
    return A.block_aggregate(_grid(t), 4, "p_size", "mode")


@query(f"SELECT (row // 5)::BIGINT AS brow, (col // 5)::BIGINT AS bcol, p_size FROM {_GRID} WHERE row % 5 = 2 AND col % 5 = 2")
def block_nearest(t: Tables) -> DataFrame:
    return A.block_aggregate(_grid(t), 5, "p_size", "nearest")


_XY = "SELECT p_size, (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 61 % 500)::DOUBLE AS y FROM part"


@query(f"""WITH p AS ({_XY}), s AS (SELECT DISTINCT x, y FROM p WHERE p_size = 1), n AS (SELECT p.p_size, p.x, p.y, min(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)) AS d FROM (SELECT *, row_number() OVER () AS i FROM p) p, s GROUP BY p.i, p.p_size, p.x, p.y),
b AS (SELECT p_size, CASE WHEN d <= 10 THEN 1 WHEN d <= 20 THEN 2 WHEN d <= 40 THEN 3 END AS band FROM n WHERE d <= 40)
SELECT band::INT AS band, sum(p_size)::BIGINT AS area, coalesce(sum(p_size) FILTER (p_size > 25), 0)::BIGINT AS area_other, round(coalesce(sum(p_size) FILTER (p_size > 25), 0) / sum(p_size), 6) AS share FROM b GROUP BY ALL""")
def buffer_zone_overlap(t: Tables) -> DataFrame:
    """Share of another class in rings around the nearest source."""
    p = t.part.select("p_size", (F.col("p_partkey") * 37 % 500).cast("double").alias("x"), (F.col("p_partkey") * 61 % 500).cast("double").alias("y"))
    out = J.distance_classes(p, p.where("p_size = 1"), (10, 20, 40)).where("band is not null").groupBy("band")
    out = out.agg(F.sum("p_size").alias("area"), F.sum(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)).alias("area_other"))
    return out.withColumn("share", r6(F.col("area_other") / F.col("area")))


_SUMMARY = """SELECT '{0}' AS variable, count({0})::BIGINT AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max,
round((avg({0}*{0}*{0}) - 3*avg({0})*avg({0}*{0}) + 2*avg({0})**3) / pow(var_pop({0}), 1.5), 4) AS skew, round(kurtosis_pop({0}), 4) AS kurtosis,
round(stddev_samp({0}) / avg({0}), 6) AS cv, round(quantile_cont({0}, 0.1), 6) AS q10, round(median({0}), 6) AS median, round(quantile_cont({0}, 0.9), 6) AS q90 FROM lineitem"""


@query(" UNION ALL ".join(_SUMMARY.format(c) for c in _M))
def distribution_summary(t: Tables) -> DataFrame:
    out = A.distribution_summary(t.lineitem, _M)
    return rounded(out, "mean", "std", "cv", "q10", "median", "q90").withColumns({c: F.round(c, 4) for c in ("skew", "kurtosis")})


@query("SELECT month(o_orderdate)::INT AS mm, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def seasonal_stats(t: Tables) -> DataFrame:
    found = L.period_stats(t.orders, F.month("o_orderdate"), "o_totalprice")
    return found.select(F.col("period").alias("mm"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("SELECT year(o_orderdate)::INT AS yyyy, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*)::BIGINT AS n, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders GROUP BY ALL")
def annual_stats(t: Tables) -> DataFrame:
    found = L.period_stats(t.orders, F.year("o_orderdate"), "o_totalprice")
    return found.select(F.col("period").alias("yyyy"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n", r6("cv").alias("cv"))


@query("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) < 6 THEN 'MAM' WHEN month(o_orderdate) < 9 THEN 'JJA' ELSE 'SON' END AS season,
round(avg(o_totalprice), 4) AS mean, count(*)::BIGINT AS n FROM orders GROUP BY ALL""")
def season_of_year(t: Tables) -> DataFrame:
    return L.period_stats(t.orders, C.season("o_orderdate"), "o_totalprice").select(F.col("period").alias("season"), F.round("mean", 4).alias("mean"), "n")


@query("""SELECT o_custkey, c_nationkey, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, count(*)::BIGINT AS n, min(year(o_orderdate))::INT AS first_year,
max(year(o_orderdate))::INT AS last_year, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) > 10""")
def station_summary(t: Tables) -> DataFrame:
    v, y = "o_totalprice", F.year("o_orderdate")
    out = t.orders.groupBy("o_custkey").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count("*").alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year")).where("n > 10")
    out = out.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("cv", C.ratio("std", "mean"))
    return rounded(out, "mean", "std", "cv")


@query("""WITH s AS (SELECT c_nationkey, c_custkey, quantile_cont(o_totalprice, [0.1, 0.5, 0.9]) AS q FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), m AS (SELECT c_nationkey, avg(q[1]) AS a, avg(q[2]) AS b, avg(q[3]) AS c FROM s GROUP BY ALL)
SELECT c_nationkey, count(DISTINCT c_custkey)::BIGINT AS n_stations, count(*)::BIGINT AS n_obs, round(avg(c_acctbal), 6) AS centre, round(max(c_acctbal) - min(c_acctbal), 6) AS spread, round(avg(o_totalprice), 6) AS mean_q,
round(quantile_cont(o_totalprice, 0.9) / quantile_cont(o_totalprice, 0.1), 6) AS q90_q10, round(any_value(a), 6) AS mean_q10, round(any_value(b), 6) AS mean_q50, round(any_value(c), 6) AS mean_q90 FROM orders JOIN customer ON o_custkey = c_custkey JOIN m USING (c_nationkey) GROUP BY ALL""")
def cluster_characteristics(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = A.cluster_characteristics(j, "c_nationkey", "c_custkey", "c_acctbal", "o_totalprice").withColumnsRenamed({"mean": "mean_q", "high_low": "q90_q10"})
    return rounded(out, "centre", "spread", "mean_q", "q90_q10", "mean_q10", "mean_q50", "mean_q90")


@query("""WITH q AS (SELECT o_custkey, year(o_orderdate)::INT AS yyyy, month(o_orderdate)::INT AS mm, min(o_totalprice) AS a, max(o_totalprice) AS b, median(o_totalprice) AS m,
quantile_cont(o_totalprice, 0.1) AS q1, quantile_cont(o_totalprice, 0.9) AS q9 FROM orders GROUP BY ALL)
SELECT o_custkey, yyyy, mm, round(b - a, 6) AS spread, round(q9 - q1, 6) AS inner_spread, round((a + b) / 2, 6) AS midrange, round(b / m, 6) AS max_ratio, round(m / a, 6) AS min_ratio FROM q""")
def quantile_spread(t: Tables) -> DataFrame:
    q = A.monthly_quantiles(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    c = F.col
    return q.select(
        "o_custkey", "yyyy", "mm", r6(c("QMAX") - c("QMIN")).alias("spread"), r6(c("Q90") - c("Q10")).alias("inner_spread"), r6((c("QMIN") + c("QMAX")) / 2).alias("midrange"),
        r6(C.ratio("QMAX", "Q50")).alias("max_ratio"), r6(C.ratio("Q50", "QMIN")).alias("min_ratio"),
    )


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.33) AS a, quantile_cont(o_totalprice, 0.67) AS b FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'mid' ELSE 'high' END AS regime, count(*)::BIGINT AS n, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders, q GROUP BY ALL""")
def flow_regime_stats(t: Tables) -> DataFrame:
    q = A.exact_quantiles(t.orders, [], "o_totalprice", (0.33, 0.67))
    v = F.col("o_totalprice")
    regime = F.when(v <= F.col("q")[0], "low").when(v <= F.col("q")[1], "mid").otherwise("high")
    return t.orders.crossJoin(F.broadcast(q)).groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), r6(C.ratio(F.stddev_samp(v), F.avg(v))).alias("cv"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 1.0/3) AS a, quantile_cont(l_extendedprice, 2.0/3) AS b FROM lineitem)
SELECT (1 + (l_extendedprice > a)::INT + (l_extendedprice > b)::INT)::INT AS zone, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*)::BIGINT AS n FROM lineitem, q GROUP BY ALL""")
def equal_count_zones(t: Tables) -> DataFrame:
    z = A.equal_count_zones(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice")
    return z.groupBy("zone").agg(r6(C.corr("l_quantity", "l_extendedprice")).alias("r"), F.count("*").alias("n"))


@query("""SELECT 'c_acctbal' AS variable, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 6) AS null_pct FROM customer UNION ALL SELECT 'c_mktsegment', round(100.0 * count(*) FILTER (c_mktsegment IS NULL) / count(*), 6) FROM customer""")
def missing_profile(t: Tables) -> DataFrame:
    return rounded(A.missing_profile(t.customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), ["c_acctbal", "c_mktsegment"]), "null_pct")


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS n_stations, count(*)::BIGINT AS n_obs, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year FROM orders")
def coverage_summary(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.agg(F.countDistinct("o_custkey").alias("n_stations"), F.count("*").alias("n_obs"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


_MEANS = "SELECT l_suppkey, " + ", ".join(f"avg({c}) AS {c}" for c in _M) + " FROM lineitem GROUP BY ALL"


@query(f"""WITH g AS ({_MEANS}), l AS (UNPIVOT g ON {", ".join(_M)} INTO NAME variable VALUE v), m AS (SELECT variable, median(v) AS m, avg(v) AS a, stddev_samp(v) AS s FROM l GROUP BY ALL)
SELECT l.variable, round(median(abs(v - m)) / abs(any_value(m)), 6) AS mad_cv, round(any_value(s) / abs(any_value(a)), 6) AS std_cv FROM l JOIN m USING (variable) GROUP BY ALL""")
def robust_cv(t: Tables) -> DataFrame:
    return rounded(A.robust_cv(t.lineitem, "l_suppkey", _M), "mad_cv", "std_cv")


@query("SELECT l_suppkey, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _M) + " FROM lineitem GROUP BY ALL")
def group_mean_collapse(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(*[r6(F.avg(c)).alias(c) for c in _M])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_first(t: Tables) -> DataFrame:
    return A.dedup_first(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")
