"""Queries of the time-series family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import series as S
from tidegrid.operators.aggregates import corr_matrix
from tidegrid.plans.registry import Tables, query, r6, rounded

_M = "SELECT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m, round(sum(o_totalprice), 2) AS q FROM orders GROUP BY ALL"


def _monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", C.months("o_orderdate").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("q"))


@query(f"WITH s AS ({_M}) SELECT a.o_custkey, a.m, a.q, b.q AS q1, c.q AS q2, d.q AS q3 FROM s a LEFT JOIN s b ON b.o_custkey = a.o_custkey AND b.m = a.m - 1 LEFT JOIN s c ON c.o_custkey = a.o_custkey AND c.m = a.m - 2 LEFT JOIN s d ON d.o_custkey = a.o_custkey AND d.m = a.m - 3")
def calendar_lags(t: Tables) -> DataFrame:
    return S.calendar_lags(_monthly(t), "o_custkey", "m", "q")


@query("SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS lag1, lag(o_totalprice, 3) OVER w AS lag3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def row_lags(t: Tables) -> DataFrame:
    out = S.row_lags(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", (1, 3))
    return out.select("o_orderkey", F.col("o_totalprice_lag1").alias("lag1"), F.col("o_totalprice_lag3").alias("lag3"))


@query(f"SELECT o_custkey, m, q FROM ({_M}) WHERE q > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY m) > 3")
def relay_filter(t: Tables) -> DataFrame:
    return S.relay_filter(_monthly(t), "o_custkey", "m", "q", 3)


_LAGS = range(1, 13)
_AUTO = f"""WITH p AS (SELECT o_custkey, o_totalprice AS a, {', '.join(f'lag(o_totalprice, {k}) OVER w AS b{k}' for k in _LAGS)} FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS ({' UNION ALL '.join(f'SELECT o_custkey, {k} AS lag, a, b{k} AS b FROM p' for k in _LAGS)}),
c AS (SELECT o_custkey, lag, corr(a, b) AS r, count(*)::BIGINT AS n FROM l WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"""


def _autocorr(t: Tables) -> DataFrame:
    return S.lag_autocorr(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", _LAGS, 5)


@query(_AUTO + " SELECT o_custkey, lag, round(r, 6) AS r, n FROM c")
def lag_autocorr(t: Tables) -> DataFrame:
    return rounded(_autocorr(t), "r")


@query(_AUTO + " SELECT lag, round(avg(r), 6) AS mean_r, count(r)::BIGINT AS n_stations FROM c GROUP BY ALL")
def lag_autocorr_mean(t: Tables) -> DataFrame:
    return rounded(S.mean_autocorr(_autocorr(t)), "mean_r")


_GR = "rank() OVER (PARTITION BY lag ORDER BY {0}) + (count(*) OVER (PARTITION BY lag, {0}) - 1) / 2.0"


@query(f"""WITH s AS (SELECT l_suppkey AS k, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS m, round(sum(l_quantity), 2) AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY ALL),
l AS (SELECT lag, a.y, b.x FROM s a, (SELECT unnest([0, 1, 2, 3])::INT AS lag) JOIN s b ON b.k = a.k AND b.m = a.m - lag),
r AS (SELECT lag, {_GR.format('x')} AS rx, {_GR.format('y')} AS ry FROM l), c AS (SELECT lag, corr(rx, ry) AS rho, count(*)::BIGINT AS n FROM r GROUP BY ALL HAVING count(*) > 50)
SELECT lag, round(rho, 6) AS rho, n, row_number() OVER (ORDER BY abs(rho) DESC, lag) = 1 AS best FROM c""")
def best_lag_spearman(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), C.months("l_shipdate").alias("m")).agg(F.round(F.sum("l_quantity"), 2).alias("x"), F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return rounded(S.best_lag(s, "k", "m", "x", "y"), "rho")


@query("""WITH g AS (SELECT o_custkey, o_orderdate::DATE AS d, o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) AS g FROM orders)
SELECT o_custkey, count(*)::BIGINT AS n_obs, max(g)::INT AS max_gap, round(avg(g), 6) AS mean_gap, count(*) FILTER (g > 90)::BIGINT AS n_large, round((max(d) - min(d)) / 365.25, 6)::DOUBLE AS span_years FROM g GROUP BY ALL""")
def gap_analysis(t: Tables) -> DataFrame:
    return rounded(S.gap_analysis(t.orders, "o_custkey", "o_orderdate"), "mean_gap", "span_years")


@query(f"""WITH g AS (SELECT o_custkey, m, m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m) - 1 AS g FROM ({_M}))
SELECT o_custkey, count(*)::BIGINT AS n_months, coalesce(sum(g), 0)::BIGINT AS missing, count(*) FILTER (g > 3)::BIGINT AS n_large, coalesce(max(g), 0) = 0 AS contiguous FROM g GROUP BY ALL""")
def month_contiguity(t: Tables) -> DataFrame:
    return S.month_contiguity(_monthly(t), "o_custkey", "m")


@query(f"""WITH r AS (SELECT o_custkey, m, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS run FROM ({_M})),
u AS (SELECT o_custkey, run, min(m) AS a, max(m) AS b, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT o_custkey, count(*) AS n_runs, min(a) AS f, max(b) AS l, sum(n) AS s FROM u GROUP BY ALL),
w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, a) = 1), p AS (SELECT *, (n_runs - 1) / (l - f + 1) AS p FROM k)
SELECT p.o_custkey, w.a::INT AS run_start, w.b::INT AS run_end, w.n::BIGINT AS run_months, n_runs::BIGINT AS n_runs, (l - f + 1)::INT AS span_months, round(100.0 * s / (l - f + 1), 6)::DOUBLE AS pct_complete,
round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 6)::DOUBLE AS break_entropy FROM p JOIN w USING (o_custkey)""")
def longest_run(t: Tables) -> DataFrame:
    return rounded(S.longest_run(_monthly(t), "o_custkey", "m"), "pct_complete", "break_entropy")


@query(f"SELECT o_custkey, m, array_to_string([printf('%.2f', x) FOR x IN h], ',') AS history FROM (SELECT o_custkey, m, list(q) OVER (PARTITION BY o_custkey ORDER BY m ROWS 5 PRECEDING) AS h FROM ({_M})) WHERE len(h) = 6")
def sliding_sequences(t: Tables) -> DataFrame:
    out = S.sliding_sequences(_monthly(t), "o_custkey", "m", "q", 6)
    return out.select("o_custkey", "m", F.array_join(F.transform("history", lambda x: F.format_string("%.2f", x)), ",").alias("history"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def ffill_code(t: Tables) -> DataFrame:
    marked = t.events.withColumn("code", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return S.fill_forward(marked, "user_id", ["ts", "event_id"], "code", "filled").select("event_id", "filled")


@query("SELECT o_custkey, yyyy::INT AS yyyy, mm::INT AS mm, q FROM (SELECT o_custkey, year(o_orderdate) AS yyyy, round(sum(o_totalprice), 2) AS q FROM orders GROUP BY ALL), (SELECT unnest(range(1, 13)) AS mm)")
def expand_months(t: Tables) -> DataFrame:
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("q"))
    return S.expand_months(yearly, "y").select("o_custkey", "yyyy", "mm", "q")


@query("SELECT CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1996 THEN 'train' WHEN year(o_orderdate) >= 1997 THEN 'test' ELSE 'none' END AS part, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL")
def time_split(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    part = F.when(y.between(1992, 1996), "train").when(y >= 1997, "test").otherwise("none")
    return t.orders.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query(f"SELECT o_custkey, count(DISTINCT m)::BIGINT AS present, (max(m) - min(m) + 1)::INT AS expected, (max(m) - min(m) + 1 - count(DISTINCT m))::BIGINT AS missing FROM ({_M}) GROUP BY ALL")
def tile_completeness(t: Tables) -> DataFrame:
    return S.tile_completeness(_monthly(t), "o_custkey", "m")


@query("""WITH r AS (SELECT 'l_quantity' AS b, corr(l_extendedprice, l_quantity) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem),
c AS (SELECT b, r, row_number() OVER (ORDER BY abs(r) DESC, b) AS place, sum(abs(r)) OVER (ORDER BY abs(r) DESC, b) / sum(abs(r)) OVER () AS cum, abs(r) / sum(abs(r)) OVER () AS own FROM r)
SELECT b AS variable, round(r, 6) AS r, place::INT AS place, round(cum, 6) AS cum_share, cum - own < 0.8 AS needed FROM c WHERE place <= 30""")
def pooled_rank_features(t: Tables) -> DataFrame:
    cols = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    r = corr_matrix(t.lineitem, cols).where(F.col("a") == cols[0]).select(F.col("b").alias("variable"), "r")
    return S.pooled_rank(r, "variable", "r").select("variable", r6("r").alias("r"), "place", r6("cum_share").alias("cum_share"), "needed")


@query(f"""WITH g AS (SELECT o_custkey, m, m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m) - 1 AS g FROM ({_M})), c AS (SELECT o_custkey, count(*) AS n, coalesce(max(g), 0) AS x FROM g GROUP BY ALL)
SELECT o_custkey, CASE WHEN n >= 5 AND x <= 12 THEN 'train' ELSE 'test' END AS part FROM c""")
def contiguity_split(t: Tables) -> DataFrame:
    w = S.month_contiguity(_monthly(t), "o_custkey", "m", 12)
    return w.select("o_custkey", F.when((F.col("n_months") >= 5) & (F.col("n_large") == 0), "train").otherwise("test").alias("part"))
