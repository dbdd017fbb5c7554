"""Queries of the screening, scoring and model families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import aggregates as A
from tidegrid.operators import matrix as X
from tidegrid.operators import models as M
from tidegrid.operators import scores as S
from tidegrid.operators import series as T
from tidegrid.plans.registry import Tables, query, r6, rounded

_V = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MEANS = "SELECT l_suppkey, " + ", ".join(f"avg({c}) AS {c}" for c in _V) + " FROM lineitem GROUP BY ALL"


def _station_means(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _V])


def _names(t: Tables, names: list[str]) -> DataFrame:
    return t.spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place int, variable string")


_ABOVE = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_RANKED = f"SELECT {', '.join(f'{_ABOVE.format(c)} AS {c}' for c in _V)} FROM ({_MEANS})"


@query(f"""WITH r AS ({_RANKED}), k AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS qe, abs(corr(l_quantity, l_discount)) AS qd, abs(corr(l_quantity, l_tax)) AS qt, abs(corr(l_extendedprice, l_discount)) AS ed, abs(corr(l_extendedprice, l_tax)) AS et, abs(corr(l_discount, l_tax)) AS dt FROM r),
a AS (SELECT *, qe <= 0.3 AS e FROM k), b AS (SELECT *, qd <= 0.3 AND (NOT e OR ed <= 0.3) AS d FROM a), c AS (SELECT *, qt <= 0.3 AND (NOT e OR et <= 0.3) AND (NOT d OR dt <= 0.3) AS t FROM b),
n AS (SELECT 1 AS o, 'l_quantity' AS variable FROM c UNION ALL SELECT 2, 'l_extendedprice' FROM c WHERE e UNION ALL SELECT 3, 'l_discount' FROM c WHERE d UNION ALL SELECT 4, 'l_tax' FROM c WHERE t)
SELECT row_number() OVER (ORDER BY o)::INT AS place, variable FROM n""")
def decorrelate(t: Tables) -> DataFrame:
    """Spearman on station means; the greedy loop runs over a matrix of columns."""
    return _names(t, S.decorrelate(A.rank_matrix(_station_means(t), _V), _V, 0.3))


@query(f"WITH r AS (SELECT {', '.join(f'{_ABOVE.format(c)} AS {c}' for c in _V)} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for i, a in enumerate(_V) for b in _V[i + 1 :]))
def corr_matrix_spearman(t: Tables) -> DataFrame:
    return rounded(A.rank_matrix(t.lineitem, _V), "r")


_X, _Y = ("l_quantity", "l_discount", "l_tax"), ("qmin", "q50", "qmax")
_LAGGED = f"""WITH s AS (SELECT l_suppkey AS k, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS m, {', '.join(f'round(sum({x}), 4) AS {x}' for x in _X)}, min(l_extendedprice) AS qmin, round(median(l_extendedprice), 6) AS q50, max(l_extendedprice) AS qmax FROM lineitem GROUP BY ALL),
l AS (SELECT lag, variable, target, x, y FROM (SELECT lag, {', '.join(f'b.{x}' for x in _X)}, {', '.join(f'a.{y}' for y in _Y)} FROM s a, (SELECT unnest([0, 1, 2, 3])::INT AS lag) JOIN s b ON b.k = a.k AND b.m = a.m - lag) UNPIVOT (x FOR variable IN ({', '.join(_X)})) UNPIVOT (y FOR target IN ({', '.join(_Y)}))),
r AS (SELECT variable, target, lag, rank() OVER (PARTITION BY variable, target, lag ORDER BY x) + (count(*) OVER (PARTITION BY variable, target, lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY variable, target, lag ORDER BY y) + (count(*) OVER (PARTITION BY variable, target, lag, y) - 1) / 2.0 AS ry FROM l),
c AS (SELECT variable, target, lag, corr(rx, ry) AS rho, count(*)::BIGINT AS n FROM r GROUP BY ALL HAVING count(*) > 50),
z AS (SELECT *, row_number() OVER (PARTITION BY variable, target ORDER BY abs(rho) DESC, lag) = 1 AS best FROM c)"""


def _best_lags(t: Tables) -> DataFrame:
    p = "l_extendedprice"
    rows = A.with_middle(t.lineitem.select(F.col("l_suppkey").alias("k"), C.months("l_shipdate").alias("m"), *_X, p), ["k", "m"], p, "middle")
    s = rows.groupBy("k", "m").agg(*[F.round(F.sum(x), 4).alias(x) for x in _X], F.min(p).alias("qmin"), r6(F.avg("middle")).alias("q50"), F.max(p).alias("qmax"))
    return T.best_lags(s, "k", "m", _X, _Y)


@query(_LAGGED + " SELECT variable, target, lag, round(rho, 6) AS rho, n, best FROM z")
def best_lag_matrix(t: Tables) -> DataFrame:
    """Every variable with every quantile."""
    return rounded(_best_lags(t), "rho")


@query(_LAGGED + """, m AS (SELECT variable, avg(abs(rho)) AS rho FROM z WHERE best GROUP BY ALL), k AS (SELECT *, rho >= 0.5 AS good, row_number() OVER (ORDER BY rho DESC, variable) AS place FROM m)
SELECT variable, round(rho, 6) AS rho FROM k WHERE good OR (NOT EXISTS (SELECT 1 FROM k WHERE good) AND place <= 5)""")
def relevance_filter(t: Tables) -> DataFrame:
    """By the mean of the best lags' absolute rho over the quantiles."""
    return rounded(T.relevance(_best_lags(t)), "rho")


_SR = "rank() OVER (PARTITION BY variable, target ORDER BY {0}) + (count(*) OVER (PARTITION BY variable, target, {0}) - 1) / 2.0"


@query(f"""WITH s AS (SELECT l_suppkey, min(l_extendedprice) AS qmin, median(l_extendedprice) AS q50, max(l_extendedprice) AS qmax, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY ALL),
u AS (SELECT * FROM s UNPIVOT (x FOR variable IN ({', '.join(_X)})) UNPIVOT (y FOR target IN ({', '.join(_Y)}))),
r AS (SELECT variable, target, {_SR.format('x')} AS rx, {_SR.format('y')} AS ry FROM u), c AS (SELECT variable, target, corr(rx, ry) AS rho, count(*)::BIGINT AS n FROM r GROUP BY ALL)
SELECT variable, target, round(rho, 6) AS rho, n, (max(abs(rho)) OVER (PARTITION BY variable)) >= 0.1 AS keep FROM c""")
def spatial_corr_filter(t: Tables) -> DataFrame:
    """Station means against each station's least, middle and greatest value; a variable stays if one rho reaches 0.1."""
    p = "l_extendedprice"
    s = t.lineitem.groupBy("l_suppkey").agg(F.min(p).alias("qmin"), F.percentile(p, F.lit(0.5)).alias("q50"), F.max(p).alias("qmax"), *[F.avg(c).alias(c) for c in _X])
    rows = A.long_form(A.long_form(s, [*_Y, "l_suppkey"], _X, value="x"), ["variable", "x", "l_suppkey"], _Y, name="target", value="y")
    rho = A.grouped_spearman(rows, ["variable", "target"], "x", "y", large=True)
    top = rho.groupBy("variable").agg((F.max(F.abs("rho")) >= 0.1).alias("keep"))
    return rounded(rho.join(top, "variable").select("variable", "target", "rho", "n", "keep"), "rho")


_TWELVE = {f"v{i:02d}": f"(l_quantity + {i * i * 3}) * (1 + {i} * l_tax)" for i in range(12)}
_CV = f"""WITH g AS (SELECT l_suppkey, {", ".join(f"avg({e}) AS {n}" for n, e in _TWELVE.items())} FROM lineitem GROUP BY ALL), l AS (UNPIVOT g ON {", ".join(_TWELVE)} INTO NAME variable VALUE v),
k AS (SELECT variable, mad(v) / abs(median(v)) AS mad_cv FROM l GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY mad_cv DESC, variable) AS place, count(*) FILTER (mad_cv >= {{0}}) OVER () AS good FROM k)
SELECT variable, round(mad_cv, 6) AS mad_cv FROM p WHERE CASE WHEN good < 5 THEN place <= 10 ELSE mad_cv >= {{0}} END"""


def _cv(t: Tables) -> DataFrame:
    return A.robust_cv(t.lineitem.select("l_suppkey", *[F.expr(e).alias(n) for n, e in _TWELVE.items()]), "l_suppkey", list(_TWELVE))


@query(_CV.format(0.0039))
def cv_filter(t: Tables) -> DataFrame:
    """Variables that vary enough between stations."""
    return rounded(S.cv_filter(_cv(t), 0.0039).select("variable", "mad_cv"), "mad_cv")


@query(_CV.format(0.9))
def cv_filter_top(t: Tables) -> DataFrame:
    """Where too few vary enough: the ten that vary most, of twelve."""
    return rounded(S.cv_filter(_cv(t), 0.9).select("variable", "mad_cv"), "mad_cv")


@query(f"""WITH m AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, stddev_samp(l_quantity) / avg(l_quantity) AS q, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS e FROM lineitem)
SELECT variable FROM (SELECT 'l_quantity' AS variable, r <= 0.5 OR q >= e AS ok FROM m UNION ALL SELECT 'l_extendedprice', r <= 0.5 OR e > q FROM m UNION ALL SELECT 'l_discount', true FROM m UNION ALL SELECT 'l_tax', true FROM m) WHERE ok""")
def collinearity_prune(t: Tables) -> DataFrame:
    cv = t.lineitem.agg(*[C.ratio(F.stddev_samp(c), F.avg(c)).alias(c) for c in _V]).first().asDict()
    return _names(t, S.collinearity_prune(A.corr_matrix(t.lineitem, _V), cv, 0.5)).select("variable")


_PROCESS = {"l_quantity": "size", "net": "size", "l_extendedprice": "price", "gross": "price", "l_tax": "rate", "l_discount": "rate"}
_SIX = "SELECT l_quantity, l_quantity * (1 - l_discount) AS net, l_extendedprice, l_extendedprice * (1 + l_tax) AS gross, l_tax, l_discount FROM lineitem"
_BEFORE = {"l_quantity": "net", "l_extendedprice": "gross", "l_tax": "l_discount"}


@query(f"WITH x AS ({_SIX}), m AS (SELECT " + ", ".join(f"abs(corr({a}, {b})) > 0.5 AS {a}_hit, stddev_samp({a}) / avg({a}) < stddev_samp({b}) / avg({b}) AS {a}_weak" for a, b in _BEFORE.items()) + " FROM x) " + " UNION ALL ".join(f"SELECT '{a}' AS variable FROM m WHERE NOT {a}_hit OR NOT {a}_weak UNION ALL SELECT '{b}' FROM m WHERE NOT {a}_hit OR {a}_weak" for a, b in _BEFORE.items()))
def collinearity_prune_by_process(t: Tables) -> DataFrame:
    """Only pairs of one process are compared: of quantity and net quantity one goes, and price and gross stay apart from them."""
    x = t.lineitem.select("l_quantity", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"), "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"), "l_tax", "l_discount")
    cv = x.agg(*[C.ratio(F.stddev_samp(c), F.avg(c)).alias(c) for c in x.columns]).first().asDict()
    return _names(t, S.collinearity_prune(A.corr_matrix(x, x.columns), cv, 0.5, _PROCESS)).select("variable")


_T = [f"t{i}" for i in range(11)]
_ELEVEN = f"SELECT {', '.join(f'avg({x}) AS {x}' for x in _X)}, {', '.join(f'quantile_cont(l_extendedprice, {p}) AS {n}' for p, n in zip(A.PROBS, _T))} FROM lineitem GROUP BY l_suppkey"


@query(f"WITH s AS ({_ELEVEN}), r AS (SELECT {', '.join(f'{_ABOVE.format(c)} AS {c}' for c in [*_X, *_T])} FROM s), k AS (" + " UNION ALL ".join(f"SELECT '{x}' AS variable, greatest({', '.join(f'abs(corr({x}, {y}))' for y in _T)}) AS top FROM r" for x in _X) + ") SELECT variable, round(top, 6) AS top FROM k WHERE top < 0.85")
def max_abs_rho_screen(t: Tables) -> DataFrame:
    """Station means by their greatest absolute rho with any of the eleven quantiles of the station's prices."""
    q = F.percentile("l_extendedprice", F.array(*map(F.lit, A.PROBS)))
    s = t.lineitem.groupBy("l_suppkey").agg(q.alias("q"), *[F.avg(x).alias(x) for x in _X]).select(*_X, *[F.col("q")[i].alias(n) for i, n in enumerate(_T)])
    return rounded(S.max_abs_rho(s, _X, _T).where("top < 0.85"), "top")


@query("""WITH q AS (SELECT quantile_cont(value, [i / 20.0 FOR i IN range(21)]) AS k FROM events WHERE event_id % 3 <> 0), p AS (SELECT event_id, value AS v, k, len([x FOR x IN k IF x <= value]) AS i FROM events, q)
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL WHEN i = 0 THEN 0 WHEN i >= 21 THEN 1 ELSE (i - 1 + (v - k[i]) / (k[i + 1] - k[i])) / 20.0 END, 6)::DOUBLE AS u FROM p""")
def quantile_transform(t: Tables) -> DataFrame:
    return rounded(S.empirical_quantile(t.events.select("event_id", "value"), F.col("event_id") % 3 != 0, "value", 20).select("event_id", "u"), "u")


@query()
def quantile_transform_normal(t: Tables) -> DataFrame:
    return S.empirical_quantile(t.events.select("event_id", "value"), F.col("event_id") % 3 != 0, "value").select("event_id", "u", r6(S.normal_score("u")).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS zq, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS zt FROM lineitem")
def standardize(t: Tables) -> DataFrame:
    z = S.standardize(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return z.select("l_orderkey", "l_linenumber", r6("l_quantity_z").alias("zq"), r6("l_tax_z").alias("zt"))


def _predicted(t: Tables) -> DataFrame:
    """Observed prices against a formula."""
    return t.lineitem.select("l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * 1400 + F.col("l_tax") * 1000).alias("p"))


_PRED = "SELECT l_suppkey, l_returnflag, l_extendedprice AS o, l_quantity * 1400 + l_tax * 1000 AS p FROM lineitem"


@query(f"""SELECT l_returnflag, count(*)::BIGINT AS n, round(corr(o, p), 6) AS r, round(avg(abs(p - o)), 4) AS mae, round(sqrt(avg((p - o) ** 2)), 4) AS rmse, round(corr(o, p) ** 2, 6) AS r2, round(1 - avg((p - o) ** 2) / var_pop(o), 6) AS nse,
round(1 - sqrt((corr(o, p) - 1) ** 2 + (stddev_pop(p) / stddev_pop(o) - 1) ** 2 + (avg(p) / avg(o) - 1) ** 2), 6) AS kge, round(avg(p) - avg(o), 4) AS bias FROM ({_PRED}) GROUP BY ALL""")
def score_pack(t: Tables) -> DataFrame:
    s = S.score_pack(_predicted(t), ["l_returnflag"], "o", "p")
    return rounded(s, "r", "r2", "nse", "kge").withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "bias")})


_QP = {"Q10": 1300, "Q50": 1400, "Q90": 1550}
_QSCORE = """SELECT '{0}' AS quantile, count(*)::BIGINT AS n, round(corr(o, p), 6) AS r, round((SELECT corr(ro, rp) FROM (SELECT rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS ro, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM x{0})), 6) AS rho,
round(avg(abs(p - o)), 4) AS mae, round(1 - avg((p - o) ** 2) / var_pop(o), 6) AS nse FROM x{0}"""


@query("WITH " + ", ".join(f"x{q} AS (SELECT l_extendedprice * {k / 1400} AS o, l_quantity * {k} + l_tax * 1000 AS p FROM lineitem)" for q, k in _QP.items()) + ", s AS (" + " UNION ALL ".join(_QSCORE.format(q) for q in _QP) + ") SELECT * FROM s UNION ALL SELECT 'mean', sum(n)::BIGINT, round(avg(r), 6), round(avg(rho), 6), round(avg(mae), 4), round(avg(nse), 6) FROM s")
def quantile_scores(t: Tables) -> DataFrame:
    """Scores of each quantile's predictions, Spearman's rho among them, and their means over the quantiles."""
    cols = {f"o{q}": F.col("l_extendedprice") * (k / 1400) for q, k in _QP.items()} | {f"p{q}": F.col("l_quantity") * k + F.col("l_tax") * 1000 for q, k in _QP.items()}
    found = S.quantile_scores(t.lineitem.select(*[c.alias(n) for n, c in cols.items()]), {q: (f"o{q}", f"p{q}") for q in _QP})
    found = rounded(found.where("quantile <> 'mean'"), "r", "rho", "nse").withColumn("mae", F.round("mae", 4)).select("quantile", "n", "r", "rho", "mae", "nse")
    mean = found.agg(F.sum("n").alias("n"), r6(F.avg("r")).alias("r"), r6(F.avg("rho")).alias("rho"), F.round(F.avg("mae"), 4).alias("mae"), r6(F.avg("nse")).alias("nse")).withColumn("quantile", F.lit("mean"))
    return found.unionByName(mean)


@query(f"SELECT l_suppkey, round(1 - avg((p - o) ** 2) / nullif(var_pop(o), 0), 6) AS r2 FROM ({_PRED}) GROUP BY ALL")
def group_r2(t: Tables) -> DataFrame:
    return rounded(S.group_r2(_predicted(t), ["l_suppkey"], "o", "p"), "r2")


@query("""WITH q AS (SELECT l_suppkey, 1 - avg((l_quantity * 1400 - l_extendedprice) ** 2) / var_pop(l_extendedprice) AS a, 1 - avg((l_quantity * 1500 - l_extendedprice) ** 2) / var_pop(l_extendedprice) AS b, 1 - avg((l_quantity * 1600 - l_extendedprice) ** 2) / var_pop(l_extendedprice) AS c FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(least(a, b, c), 6) AS lo, round(greatest(a, b, c), 6) AS hi, round((a + b + c) / 3, 6) AS mean, round(a + b + c - least(a, b, c) - greatest(a, b, c), 6) AS median FROM q""")
def group_r2_over_quantiles(t: Tables) -> DataFrame:
    o = F.col("l_extendedprice")
    each = t.lineitem.groupBy("l_suppkey").agg(*[(1 - C.ratio(F.avg((F.col("l_quantity") * k - o) ** 2), F.var_pop(o))).alias(n) for n, k in (("a", 1400), ("b", 1500), ("c", 1600))])
    return each.select("l_suppkey", r6(F.least("a", "b", "c")).alias("lo"), r6(F.greatest("a", "b", "c")).alias("hi"), r6((F.col("a") + F.col("b") + F.col("c")) / 3).alias("mean"), r6(C.row_median(["a", "b", "c"])).alias("median"))


@query(f"WITH g AS (SELECT l_suppkey, avg(o) AS o, avg(p) AS p FROM ({_PRED}) GROUP BY ALL) SELECT count(*)::BIGINT AS n, round(corr(o, p), 6) AS r, round(sqrt(avg((p - o) ** 2)), 4) AS rmse FROM g")
def group_aggregated_oob(t: Tables) -> DataFrame:
    g = _predicted(t).groupBy("l_suppkey").agg(F.avg("o").alias("o"), F.avg("p").alias("p"))
    return S.score_pack(g, [], "o", "p").select("n", r6("r").alias("r"), F.round("rmse", 4).alias("rmse"))


@query("""SELECT l_orderkey, l_linenumber, ((l_quantity > l_suppkey % 50)::INT + (l_suppkey % 50 > l_tax * 400)::INT)::INT AS before, 0 AS after,
round(l_quantity + l_suppkey % 50 + l_tax * 400, 4)::DOUBLE AS total FROM lineitem""")
def monotone_quantiles(t: Tables) -> DataFrame:
    """The fit keeps a row's sum and has no falls."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity"), (F.col("l_suppkey") % 50).cast("double"), F.col("l_tax") * 400).alias("a"))
    fit = S.monotone_quantiles(rows, "a")
    total = F.aggregate("monotone", F.lit(0.0), lambda s, x: s + x)
    return fit.select("l_orderkey", "l_linenumber", S.violations("a").alias("before"), S.violations(F.transform("monotone", lambda x: F.round(x, 9))).alias("after"), F.round(total, 4).alias("total"))


@query("SELECT c_custkey, greatest(c_acctbal, 0) AS v FROM customer")
def nonneg_clip(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("v"))


@query("""WITH c AS (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount, corr(l_tax, l_extendedprice) AS l_tax FROM lineitem GROUP BY ALL HAVING count(*) >= 3),
u AS (UNPIVOT c ON l_quantity, l_discount, l_tax INTO NAME predictor VALUE r) SELECT l_suppkey, predictor, round(r, 6) AS r FROM u QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(abs(r), 9) DESC, predictor) = 1""")
def station_best_predictor(t: Tables) -> DataFrame:
    return rounded(S.station_best_predictor(t.lineitem, "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), "r")


_IPAIRS = [(a, b) for i, a in enumerate(_X) for b in _X[i + 1 :]]


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, abs(corr({a} * {b}, l_extendedprice)) AS r_both, abs(corr({a}, l_extendedprice)) AS r_a, abs(corr({b}, l_extendedprice)) AS r_b FROM lineitem" for a, b in _IPAIRS) + ") SELECT a, b, n, round(r_both, 6) AS r_both, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b, r_both > 0.5 * greatest(r_a, r_b) AS keep FROM m")
def interaction_corr(t: Tables) -> DataFrame:
    """Products of all pairs of predictors against the target."""
    return rounded(X.interactions(t.lineitem, _X, "l_extendedprice"), "r_both", "r_a", "r_b")


_WIDE = {f"w{i:02d}": f"CASE WHEN l_orderkey % {i + 5} > 0 THEN l_quantity * {i} + l_extendedprice / {1000 + 37 * i} + l_tax * {i * i} END" for i in range(16)}


@query("WITH w AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM w" for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1 :]))
def corr_matrix_wide(t: Tables) -> DataFrame:
    """120 pairs with missing values, by blocked cross products."""
    return rounded(A.corr_matrix(t.lineitem.select(*[F.expr(e).alias(n) for n, e in _WIDE.items()]), list(_WIDE)), "r")


@query("""WITH p AS (SELECT (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 61 % 500)::DOUBLE AS y FROM part), o AS (SELECT unnest(range(-3, 4)) AS k), c AS (SELECT x, y, (floor(y / 10) + a.k)::BIGINT AS row, (floor(x / 10) + b.k)::BIGINT AS col FROM p, o a, o b),
d AS (SELECT row, col, (((col + 0.5) * 10 - x) ** 2 + ((row + 0.5) * 10 - y) ** 2) / 625 AS d FROM c) SELECT row, col, round(sum((1 - d) ** 2) * 10, 6) AS density FROM d WHERE d < 1 GROUP BY ALL""")
def kernel_density(t: Tables) -> DataFrame:
    p = t.part.select((F.col("p_partkey") * 37 % 500).cast("double").alias("x"), (F.col("p_partkey") * 61 % 500).cast("double").alias("y"))
    return rounded(S.kernel_density(p, 10.0, 25.0), "density")


@query("""WITH p AS (SELECT (s_suppkey * 37 % 500)::DOUBLE AS x, (s_suppkey * 61 % 500)::DOUBLE AS y FROM supplier), o AS (SELECT unnest(range(-31, 32)) AS k), c AS (SELECT x, y, (floor(y / 5) + a.k)::BIGINT AS row, (floor(x / 5) + b.k)::BIGINT AS col FROM p, o a, o b),
d AS (SELECT row, col, (((col + 0.5) * 5 - x) ** 2 + ((row + 0.5) * 5 - y) ** 2) / 22500 AS d FROM c) SELECT row, col, round(sum((1 - d) ** 2) * 10, 6) AS density FROM d WHERE d < 1 GROUP BY ALL""")
def kernel_density_wide(t: Tables) -> DataFrame:
    """A radius of thirty cells."""
    p = t.supplier.select((F.col("s_suppkey") * 37 % 500).cast("double").alias("x"), (F.col("s_suppkey") * 61 % 500).cast("double").alias("y"))
    return rounded(S.kernel_density(p, 5.0, 150.0), "density")


@query()
def spatial_kmeans(t: Tables) -> DataFrame:
    return M.spatial_kmeans(t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("y")), ["c_acctbal", "y"], 20).select("c_custkey", "cluster")


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("""WITH g AS (SELECT DISTINCT l_suppkey FROM lineitem) SELECT count(*)::BIGINT AS groups, t.tree::INT AS tree, count(*)::DOUBLE AS draws, true AS some_left_out FROM g, range(20) t(tree) GROUP BY ALL""")
def bootstrap_draws(t: Tables) -> DataFrame:
    """As many draws per tree as there are groups, some of which are not drawn."""
    each = M.bootstrap_draws(t.lineitem, "l_suppkey", 20).select("l_suppkey", F.posexplode("draws").alias("tree", "k"))
    return each.groupBy("tree").agg(F.count("*").alias("groups"), F.sum("k").alias("draws"), F.bool_or(F.col("k") == 0).alias("some_left_out"))


@query()
def train_forest(t: Tables) -> DataFrame:
    """Out-of-bag errors of every supplier; whole suppliers are drawn per tree."""
    return M.train_forest(t.lineitem, _FEATURES, "l_extendedprice", "l_suppkey", trees=20, depth=5)[1]


@query()
def forest_per_quantile(t: Tables) -> DataFrame:
    """Importances of the forests of three quantiles of each station's prices."""
    q = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = t.lineitem.groupBy("l_suppkey", C.months("l_shipdate").alias("m")).agg(q.alias("q"), *[F.avg(c).alias(c) for c in _FEATURES])
    s = s.select("l_suppkey", *_FEATURES, *[F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))])
    return M.forest_per_target(s, _FEATURES, ["q10", "q50", "q90"], "l_suppkey", trees=5)[1]


@query()
def grid_search_forest(t: Tables) -> DataFrame:
    found = M.grid_search_forest(t.lineitem, _FEATURES, "l_extendedprice", "l_suppkey", trees=(5, 10), subsets=(1, 3))
    f = found.getEstimator()
    rows = [(int(m[f.maxDepth]), int(m[f.numTrees]), int(m[f.featureSubsetStrategy]), float(v)) for m, v in zip(found.getEstimatorParamMaps(), found.avgMetrics)]
    return t.spark.createDataFrame(rows, "depth int, trees int, n_features int, rmse double")


@query()
def predict_table(t: Tables) -> DataFrame:
    models, _ = M.train_forest(t.lineitem, _FEATURES, "l_extendedprice", "l_suppkey", trees=5)
    return M.predict_table(models, t.lineitem, _FEATURES).select("l_orderkey", "l_linenumber", "prediction")
