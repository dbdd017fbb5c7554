"""Queries of the cleaning and cell-algebra families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import cells as L
from tidegrid.operators import scores as S
from tidegrid.plans.registry import Tables, query, r6, rounded

_MISSING = "(CASE WHEN event_id % 7 = 0 THEN -9999 WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END)"


def _raw(t: Tables) -> DataFrame:
    """Events with sentinels and NaN put in by rule."""
    v = F.when(F.col("event_id") % 7 == 0, -9999.0).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return t.events.select("event_id", "user_id", v.alias("v"))


@query(f"SELECT event_id, CASE WHEN v = -9999 OR isnan(v) THEN NULL ELSE v END AS clean FROM (SELECT event_id, {_MISSING} AS v FROM events)")
def sentinel_to_null(t: Tables) -> DataFrame:
    return _raw(t).select("event_id", C.sentinel_to_null("v").alias("clean"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity % 10 = 0 OR l_tax = 0)")
def drop_sentinel_rows(t: Tables) -> DataFrame:
    marked = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_quantity") % 10 == 0, -9999.0).otherwise(F.col("l_quantity")).alias("a"), F.when(F.col("l_tax") == 0, -9.0).otherwise(F.col("l_tax")).alias("b"))
    return marked.where(~C.has_sentinel(["a", "b"])).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH c AS (SELECT event_id, CASE WHEN v = -9999 OR isnan(v) THEN NULL ELSE v END AS v FROM (SELECT event_id, {_MISSING} AS v FROM events))
SELECT event_id, round(coalesce(v, (SELECT median(v) FROM c)), 6) AS v FROM c""")
def fill_median(t: Tables) -> DataFrame:
    return rounded(S.fill_median(_raw(t).select("event_id", C.sentinel_to_null("v").alias("v")), ["v"]), "v")


@query("""SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN l_extendedprice * 0.028316846592 WHEN 'R' THEN l_extendedprice * l_quantity ELSE l_extendedprice END, 4) AS q FROM lineitem""")
def unit_convert(t: Tables) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "CFS").when(F.col("l_returnflag") == "R", "PER_AREA").otherwise("CMS")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.to_cubic_metres("l_extendedprice", unit, "l_quantity"), 4).alias("q"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN c_custkey / 10.0 ELSE c_acctbal END::DOUBLE AS lon FROM customer")
def manual_correction(t: Tables) -> DataFrame:
    fixes = t.customer.where("c_custkey % 100 = 7").select("c_custkey", (F.col("c_custkey") / 10.0).alias("c_acctbal"))
    return L.corrected(t.customer, fixes, "c_custkey", "c_acctbal").select("c_custkey", F.col("c_acctbal").alias("lon"))


@query("SELECT p_partkey, length(split_part(p_retailprice::VARCHAR, '.', 2))::INT AS n_decimals FROM part")
def coordinate_precision(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.decimals(F.col("p_retailprice").cast("string")).alias("n_decimals"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15")
def bbox_filter(t: Tables) -> DataFrame:
    return t.customer.where(C.in_box("c_acctbal", "c_nationkey", 0, 5000, 5, 15)).select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal / 100 BETWEEN -60 AND 85")
def lat_clip(t: Tables) -> DataFrame:
    return t.supplier.where(C.in_latitudes(F.col("s_acctbal") / 100)).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, round(CASE WHEN c_nationkey < 12 AND c_acctbal / 50 - 180 < -169 THEN c_acctbal / 50 - 180 + 360 ELSE c_acctbal / 50 - 180 END, 6) AS lon FROM customer")
def dateline_shift(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", r6(C.shift_dateline(F.col("c_acctbal") / 50 - 180, F.col("c_nationkey") < 12)).alias("lon"))


@query("""SELECT rule, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q FROM (
SELECT 'base' AS rule, l_quantity FROM lineitem WHERE l_discount > 0.02 AND l_tax > 0.01 AND l_quantity BETWEEN 5 AND 45 AND l_returnflag = 'N' UNION ALL
SELECT 'any_discount', l_quantity FROM lineitem WHERE l_tax > 0.01 AND l_quantity BETWEEN 5 AND 45 AND l_returnflag = 'N' UNION ALL
SELECT 'any_quantity', l_quantity FROM lineitem WHERE l_discount > 0.02 AND l_tax > 0.01 AND l_returnflag = 'N' UNION ALL
SELECT 'any_flag', l_quantity FROM lineitem WHERE l_discount > 0.02 AND l_tax > 0.01 AND l_quantity BETWEEN 5 AND 45) GROUP BY ALL""")
def qc_flags_filter(t: Tables) -> DataFrame:
    """All rule variants in one pass over the rows."""
    conditions = {"tax": F.col("l_tax") > 0.01, "discount": F.col("l_discount") > 0.02, "quantity": F.col("l_quantity").between(5, 45), "flag": F.col("l_returnflag") == "N"}
    rows = L.by_rules(t.lineitem.select("l_quantity", "l_tax", "l_discount", "l_returnflag"), L.relaxed_rules(conditions, base=["tax"]))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


_SIX = "l_quantity, l_discount * 100, l_tax * 100, l_extendedprice / 1000, l_linenumber, l_suppkey % 50"


@query(f"SELECT l_orderkey, l_linenumber, round(((l_quantity + l_discount * 100 + l_tax * 100 + l_extendedprice / 1000 + l_linenumber + l_suppkey % 50) - greatest({_SIX}) - least({_SIX})) / 4, 8) AS m FROM lineitem")
def trimmed_mean_of_k(t: Tables) -> DataFrame:
    six = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000, F.col("l_linenumber"), F.col("l_suppkey") % 50]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.trimmed_mean(six), 8).alias("m"))


@query("""SELECT variable, count(*)::BIGINT AS n, round(sum(value), 2) AS s FROM (UNPIVOT (SELECT l_quantity, l_discount * 100 AS d100, l_tax * 100 AS t100 FROM lineitem) ON l_quantity, d100, t100 INTO NAME variable VALUE value)
WHERE value > 0 AND value < 30 GROUP BY ALL""")
def range_keep_percentile(t: Tables) -> DataFrame:
    three = t.lineitem.select("l_quantity", (F.col("l_discount") * 100).alias("d100"), (F.col("l_tax") * 100).alias("t100"))
    return L.range_keep(three, three.columns, 0, 30).groupBy("variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS lx, round(ln(l_quantity), 6) AS ly, round(abs(l_extendedprice - l_quantity), 6) AS d FROM lineitem WHERE l_extendedprice > 1000 AND l_quantity > 10")
def log_positive_pairs(t: Tables) -> DataFrame:
    kept = L.log_positive_pairs(t.lineitem, "l_extendedprice", "l_quantity", 1000, 10)
    return kept.select("l_orderkey", "l_linenumber", r6("log_a").alias("lx"), r6("log_b").alias("ly"), r6("diff").alias("d"))


@query("SELECT p_partkey, (p_size = 1)::INT AS c1, (p_size IN (2, 3))::INT AS c2_3, (p_size = 50)::INT AS c50 FROM part")
def class_binarize(t: Tables) -> DataFrame:
    flags = C.class_flags("p_size", {"c1": [1], "c2_3": [2, 3], "c50": [50]})
    return t.part.select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 1200 AND 1600 THEN 1 ELSE 0 END AS inside FROM part")
def threshold_mask(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.inside("p_retailprice", 1200, 1600).alias("inside"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' OR p_size < 10 OR o_totalprice > 300000 THEN NULL ELSE l_quantity END AS v
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def apply_masks(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    masked = L.apply_masks(j, "l_quantity", [F.col("o_orderstatus") == "F", F.col("p_size") < 10, F.col("o_totalprice") > 300000])
    return masked.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN r IS NULL THEN 'missing' WHEN r > 1.2 THEN 'larger' WHEN r < 0.8 THEN 'smaller' ELSE 'similar' END AS kind
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / p_retailprice AS r FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def ratio_class(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", C.ratio_class(F.col("l_extendedprice") / F.col("l_quantity"), "p_retailprice").alias("kind"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - 150000) <= 0.1 * 150000")
def pct_difference_band(t: Tables) -> DataFrame:
    return t.orders.where(C.within_share("o_totalprice", F.lit(150000.0))).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, round((a + 2 * b) / 3, 6) AS v FROM (SELECT p_partkey, p_retailprice AS a FROM part) JOIN (SELECT l_partkey, avg(l_quantity) AS b FROM lineitem GROUP BY ALL) ON p_partkey = l_partkey")
def cell_expr(t: Tables) -> DataFrame:
    """Layers joined on the cell, then a user's formula as SQL text; NULL propagates."""
    a = t.part.select("p_partkey", F.col("p_retailprice").alias("value"))
    b = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("value"))
    return rounded(L.cell_expr({"a": a, "b": b}, ["p_partkey"], "(a + 2 * b) / 3", "v"), "v")


@query("SELECT l_partkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS v FROM lineitem GROUP BY ALL")
def depth_weighted_mean(t: Tables) -> DataFrame:
    return L.weighted_mean(t.lineitem, ["l_partkey"], "l_extendedprice", "l_quantity").select("l_partkey", r6("mean").alias("v"))


@query("SELECT p_partkey, round(least(1, greatest(0, (p_retailprice - 1000) / 500)), 6) AS v FROM part")
def minmax_normalize_clip(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r6(C.minmax("p_retailprice", F.lit(1000.0), F.lit(1500.0))).alias("v"))


@query("SELECT l_suppkey, round(ln(1 + stddev_pop(l_quantity) / (avg(l_quantity) / 50 + 0.05)), 6) AS v FROM lineitem GROUP BY ALL")
def instability_index(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(r6(C.instability(F.avg("l_quantity") / 50, F.stddev_pop("l_quantity"))).alias("v"))


@query("""SELECT p_partkey, round(ln(p_retailprice / (tan(radians(p_size)) + 0.01)) * 1e8, 0) AS cti, round(p_retailprice * (tan(radians(p_size)) + 0.01) * 1e3, 3) AS spi,
floor(1.4 * pow(p_retailprice / 22.13, 0.4) * pow(sin(radians(p_size)) / 0.0896, 1.3) * 1e3)::BIGINT AS sti FROM part""")
def terrain_indices(t: Tables) -> DataFrame:
    a, s = "p_retailprice", "p_size"
    return t.part.select("p_partkey", F.round(C.topographic_wetness(a, s), 0).alias("cti"), F.round(C.stream_power(a, s), 3).alias("spi"), C.sediment_transport(a, s).cast("long").alias("sti"))


@query("SELECT p_partkey, round((p_retailprice - p_size * 30) / nullif(p_retailprice + p_size * 30, 0) * 1e6, 4) AS v FROM part")
def normalized_difference(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(C.normalized_difference("p_retailprice", F.col("p_size") * 30), 4).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity + 10, 4) AS v FROM lineitem")
def area_weight(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.area_weighted("l_extendedprice", "l_quantity", 10), 4).alias("v"))


@query("""WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS volume, sum(l_quantity) AS area FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(ln(volume / area * l_quantity), 6) AS v FROM lineitem JOIN s ON k = l_orderkey""")
def volume_share(t: Tables) -> DataFrame:
    shares = L.volume_share(t.lineitem, "l_orderkey", "l_extendedprice", "l_quantity")
    return shares.select("l_orderkey", "l_linenumber", r6("log_share").alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(floor(l_tax * 100), 0), 6) AS norm, round(l_extendedprice / nullif(floor(l_tax * 100), 0) * floor(l_tax * 100), 4) AS back FROM lineitem")
def area_normalize(t: Tables) -> DataFrame:
    acc = F.floor(F.col("l_tax") * 100)
    n = C.per_area("l_extendedprice", acc)
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(n).alias("norm"), F.round(n * acc, 4).alias("back"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + l_discount, 6) AS ppt_sum, round((l_quantity + l_tax + l_discount) / 3, 6) AS ppt_avg FROM lineitem")
def sum_avg_lags(t: Tables) -> DataFrame:
    total, mean = C.sum_and_mean(["l_quantity", "l_tax", "l_discount"])
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(total).alias("ppt_sum"), r6(mean).alias("ppt_avg"))


@query("""SELECT c_custkey, floor((c_acctbal + 1000) / 250)::BIGINT AS col, floor(c_nationkey / 2.5)::BIGINT AS row,
(floor((c_acctbal + 1000) / 250) + 1 + floor(c_nationkey / 2.5) * 44)::BIGINT AS cell FROM customer""")
def grid_snap(t: Tables) -> DataFrame:
    col, row = C.cell_row("c_acctbal", -1000, 250), C.cell_row("c_nationkey", 0, 2.5)
    return t.customer.select("c_custkey", col.alias("col"), row.alias("row"), C.cell_id(col, row, 44).alias("cell"))


_LONLAT = "(c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 170 - 85)::DOUBLE AS lat"


@query(f"""SELECT c_custkey, floor(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)))::BIGINT AS metres FROM (
SELECT c_custkey, pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2) AS a FROM (SELECT c_custkey, {_LONLAT} FROM customer))""")
def haversine(t: Tables) -> DataFrame:
    lon, lat = (F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double")
    return t.customer.select("c_custkey", C.haversine(lon, lat, F.lit(20.0), F.lit(10.0)).alias("metres"))


@query(f"SELECT c_custkey, round(radians(lon) * 6378137, 4) AS x, round(radians(lat) * 6378137, 4) AS y FROM (SELECT c_custkey, {_LONLAT} FROM customer)")
def plate_carree(t: Tables) -> DataFrame:
    x, y = C.plate_carree((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double"))
    return t.customer.select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
