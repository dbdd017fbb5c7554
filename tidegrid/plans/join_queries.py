"""Queries of the join family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators import cells as L
from tidegrid.operators import space as P
from tidegrid.operators import tables as J
from tidegrid.plans.registry import Tables, query, r6, rounded


@query("SELECT o_orderkey, o_totalprice, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join_key(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_nationkey")


_MONTHLY_O = "SELECT o_custkey AS k, year(o_orderdate)::INT AS yyyy, month(o_orderdate)::INT AS mm, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL"
_MONTHLY_E = "SELECT user_id AS k, year(ts)::INT AS yyyy, month(ts)::INT AS mm, round(sum(value), 6) AS v FROM events GROUP BY ALL"


def _monthly(df: DataFrame, key: str, date: str) -> list:
    return [F.col(key).alias("k"), F.year(date).alias("yyyy"), F.month(date).alias("mm")]


@query(f"SELECT mm, k, count(*)::BIGINT AS n, round(sum(total), 2) AS total, round(sum(v), 4) AS v FROM (SELECT k, mm, total FROM ({_MONTHLY_O})) JOIN (SELECT k, mm, v FROM ({_MONTHLY_E})) USING (k, mm) GROUP BY ALL")
def composite_key_join(t: Tables) -> DataFrame:
    a = t.orders.groupBy(*_monthly(t.orders, "o_custkey", "o_orderdate")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).select("k", "mm", "total")
    b = t.events.groupBy(*_monthly(t.events, "user_id", "ts")).agg(r6(F.sum("value")).alias("v")).select("k", "mm", "v")
    return L.keyed_join(a, b, ["k", "mm"]).groupBy("k", "mm").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.round(F.sum("v"), 4).alias("v"))


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_extendedprice FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 10) a
JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_tax > 0.02) b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def multi_key_merge(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x, y = t.lineitem.where("l_quantity > 10").select(*keys, "l_quantity"), t.lineitem.where("l_tax > 0.02").select(*keys, "l_extendedprice")
    return L.keyed_join(x, y, keys).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, coalesce(total, -1) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def matched_else_default(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return J.matched_else_default(t.customer.select("c_custkey"), by, ["c_custkey"], {"n": 0, "total": -1.0})


@query("""WITH a AS (SELECT c_custkey AS id, (c_acctbal)::VARCHAR AS lon, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS area FROM customer),
b AS (SELECT c_custkey AS id, (round(c_acctbal, 1))::VARCHAR AS lon, abs(c_acctbal) AS area, c_nationkey::DOUBLE AS altitude FROM customer WHERE c_custkey % 2 = 0)
SELECT a.id, CASE WHEN b.lon IS NOT NULL AND length(split_part(b.lon, '.', 2)) > length(split_part(a.lon, '.', 2)) THEN b.lon ELSE a.lon END AS lon,
round(coalesce(a.area, b.area * 2.58999), 6) AS area, b.altitude AS altitude FROM a LEFT JOIN b ON a.id = b.id""")
def catalogue_reconcile(t: Tables) -> DataFrame:
    c = t.customer
    none = F.lit(None).cast("double").alias("altitude")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("string").alias("lon"), F.lit("0.0").alias("lat"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("area"), none)
    b = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 1).cast("string").alias("lon"), F.lit("0.0").alias("lat"), F.abs("c_acctbal").alias("area"), F.col("c_nationkey").cast("double").alias("altitude"))
    return J.reconcile(a, b, "id", C.SQUARE_MILE).select("id", "lon", r6("area").alias("area"), "altitude")


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::BIGINT AS matched, count(*) FILTER (b IS NULL)::BIGINT AS only_a, count(*) FILTER (a IS NULL)::BIGINT AS only_b
FROM (SELECT o_orderkey AS a FROM orders WHERE o_orderkey % 5 <> 0) FULL JOIN (SELECT o_orderkey AS b FROM orders WHERE o_orderkey % 7 <> 0) ON a = b""")
def align_check(t: Tables) -> DataFrame:
    return J.align_check(t.orders.where("o_orderkey % 5 <> 0"), t.orders.where("o_orderkey % 7 <> 0"), ["o_orderkey"])


_CELLS = "SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice AS v, p_size AS s FROM part"
_POINTS = "SELECT event_id, (user_id % 60)::BIGINT AS row, (event_id % 50)::BIGINT AS col FROM events"


def _cells(t: Tables) -> DataFrame:
    return t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))


def _points(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.col("user_id") % 60).alias("row"), (F.col("event_id") % 50).alias("col"))


@query(f"SELECT event_id, row, col, v FROM ({_POINTS}) LEFT JOIN ({_CELLS}) USING (row, col)")
def sample_at_points(t: Tables) -> DataFrame:
    return J.sample_at_points(_points(t), _cells(t), "v").select("event_id", "row", "col", "v")


@query(f"SELECT event_id, max(v) AS max_v FROM ({_POINTS}) p LEFT JOIN ({_CELLS}) c ON abs(p.row - c.row) <= 1 AND abs(p.col - c.col) <= 1 GROUP BY ALL")
def neighborhood_sample(t: Tables) -> DataFrame:
    return J.neighbourhood_max(_points(t), _cells(t), "v", 1, "event_id").select("event_id", "max_v")


@query("""WITH g AS (SELECT user_id // 5 AS row, day(ts) AS col, event_type, avg(value) AS m FROM events GROUP BY ALL)
SELECT a.row::BIGINT AS row, a.col::INT AS col, round(a.m, 6) AS a, round(b.m, 6) AS b FROM g a JOIN g b USING (row, col) WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type = (SELECT max(event_type) FROM events) AND a.m > 0""")
def overlap_pairs(t: Tables) -> DataFrame:
    kinds = t.events.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))
    e = t.events.crossJoin(F.broadcast(kinds))  # one row
    grid = lambda which, n: e.where(F.col("event_type") == F.col(which)).groupBy(F.floor(F.col("user_id") / 5).alias("row"), F.day("ts").alias("col")).agg(F.avg("value").alias(n))
    return J.overlap(grid("first", "a").where("a > 0"), grid("last", "b")).select("row", "col", r6("a").alias("a"), r6("b").alias("b"))


@query("SELECT floor(p_retailprice / 200)::BIGINT AS tile, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def point_in_tile(t: Tables) -> DataFrame:
    return t.part.groupBy(C.cell_row("p_retailprice", 0, 200).alias("tile")).agg(F.count("*").alias("n"))


_SNAP_P = "SELECT c_custkey AS id, c_acctbal / 10 AS x, c_nationkey * 40.0 AS y FROM customer"
_SNAP_A = "SELECT s_suppkey AS anchor_id, s_acctbal / 10 AS ax, s_nationkey * 40.0 AS ay, s_suppkey % 6 AS weight FROM supplier"


@query(f"""WITH j AS (SELECT id, anchor_id, sqrt((x - ax) ** 2 + (y - ay) ** 2) AS d, (weight >= 1)::INT + (weight >= 3)::INT + (weight >= 5)::INT AS level FROM ({_SNAP_P}), ({_SNAP_A}) WHERE sqrt((x - ax) ** 2 + (y - ay) ** 2) <= 60),
b AS (SELECT * FROM j WHERE level > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC, d, anchor_id) = 1)
SELECT p.id AS id, anchor_id, round(d, 6) AS distance, level::INT AS level FROM ({_SNAP_P}) p LEFT JOIN b ON p.id = b.id""")
def nearest_snap(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 40.0).alias("y"))
    a = t.supplier.select(F.col("s_suppkey").alias("anchor_id"), (F.col("s_acctbal") / 10).alias("ax"), (F.col("s_nationkey") * 40.0).alias("ay"), (F.col("s_suppkey") % 6).alias("weight"))
    return J.nearest_snap(p, a, 60.0, [1, 3, 5], "id").select("id", "anchor_id", r6("distance").alias("distance"), "level")


@query(f"SELECT p.id AS id FROM ({_SNAP_P}) p WHERE NOT EXISTS (SELECT 1 FROM ({_SNAP_A}) a WHERE (x - ax) ** 2 + (y - ay) ** 2 <= 900)")
def presence_buffer_exclude(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 40.0).alias("y"))
    a = t.supplier.select((F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 40.0).alias("y"))
    return J.outside_buffer(p, a, 30.0).select("id")


@query("SELECT p_partkey, code::BIGINT AS code FROM part JOIN (SELECT p_brand, p_size, min(p_partkey) AS code FROM part GROUP BY ALL) USING (p_brand, p_size)")
def lookup_reclass(t: Tables) -> DataFrame:
    lookup = t.part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("code"))
    return J.reclass(t.part.select("p_partkey", "p_brand", "p_size"), lookup, ["p_brand", "p_size"], "code").select("p_partkey", "code")


_SERIES = "SELECT l_suppkey AS s, year(l_shipdate) * 12 + month(l_shipdate) AS m, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL"


@query(f"""WITH pos AS (SELECT s_suppkey AS s, (s_suppkey * 37 % 100)::DOUBLE AS x, (s_suppkey * 61 % 100)::DOUBLE AS y FROM supplier), ser AS ({_SERIES}),
pairs AS (SELECT a.s AS a, b.s AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pos a JOIN pos b ON a.s < b.s),
c AS (SELECT a, b, floor(d / 5)::BIGINT AS band, corr(x.v, y.v) AS r FROM pairs JOIN ser x ON x.s = a JOIN ser y ON y.s = b AND y.m = x.m GROUP BY ALL HAVING count(*) >= 3)
SELECT band, count(*)::BIGINT AS n_pairs, round(avg(r), 6) AS mean_r FROM c GROUP BY ALL""")
def distance_band_pairs(t: Tables) -> DataFrame:
    """All pairs of stations, whatever their distance."""
    pos = t.supplier.select(F.col("s_suppkey").alias("s"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("x"), (F.col("s_suppkey") * 61 % 100).cast("double").alias("y"))
    series = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), C.months("l_shipdate").alias("m")).agg(F.avg("l_extendedprice").alias("v"))
    return J.band_correlations(pos, series, "s", "m", "v", None, 5.0).select("band", "n_pairs", r6("mean_r").alias("mean_r"))


# on the sphere: positions all over it, poles and date line among them
_GLOBE_P = "SELECT c_custkey AS id, (c_custkey * 37 % 3601) / 10 - 180 AS lon, (c_custkey * 61 % 1801) / 10 - 90 AS lat FROM customer"
_GLOBE_A = "SELECT p_partkey AS anchor_id, (p_partkey * 7919 % 3601) / 10 - 180 AS lon, (p_partkey * 613 % 1801) / 10 - 90 AS lat, p_size % 6 AS weight FROM part"


def _arc(a: str, b: str) -> str:
    h = f"(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)"
    return f"(2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _globe(df: DataFrame, key: str, name: str, a: int, b: int, *more: object) -> DataFrame:
    return df.select(F.col(key).alias(name), ((F.col(key) * a % 3601) / 10 - 180).alias("lon"), ((F.col(key) * b % 1801) / 10 - 90).alias("lat"), *more)


@query(f"""WITH p AS ({_GLOBE_P}), a AS ({_GLOBE_A}), j AS (SELECT id, anchor_id, {_arc("p", "a")} AS d, (weight >= 1)::INT + (weight >= 3)::INT + (weight >= 5)::INT AS level FROM p, a WHERE {_arc("p", "a")} <= 400000),
b AS (SELECT * FROM j WHERE level > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC, d, anchor_id) = 1)
SELECT p.id AS id, anchor_id, round(d, 3) AS distance, level::INT AS level FROM p LEFT JOIN b ON p.id = b.id""")
def nearest_snap_sphere(t: Tables) -> DataFrame:
    """Snapping by great-circle distance, over the date line and the poles."""
    p, a = _globe(t.customer, "c_custkey", "id", 37, 61), _globe(t.part, "p_partkey", "anchor_id", 7919, 613, (F.col("p_size") % 6).alias("weight"))
    return P.snap_on_sphere(p, a, 400_000.0, [1, 3, 5], "id").select("id", "anchor_id", F.round("distance", 3).alias("distance"), "level")


@query(f"WITH p AS ({_GLOBE_P}), a AS ({_GLOBE_A}) SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_arc('p', 'a')} <= 250000)")
def presence_buffer_exclude_sphere(t: Tables) -> DataFrame:
    p, a = _globe(t.customer, "c_custkey", "id", 37, 61), _globe(t.part, "p_partkey", "anchor_id", 7919, 613)
    return P.outside_buffer_on_sphere(p, a, 250_000.0).select("id")


_DATELINE = "SELECT s_suppkey AS s, CASE WHEN s_suppkey * 7 % 40 < 20 THEN 178 + (s_suppkey * 7 % 40) / 10 ELSE -182 + (s_suppkey * 7 % 40) / 10 END AS lon, (s_suppkey * 13 % 37) / 10 + 60 AS lat FROM supplier"
_LIMITS = ((0, 10), (10, 25), (25, 50), (50, 100), (100, 500))


@query(f"""WITH pos AS ({_DATELINE}), ser AS ({_SERIES}), pairs AS (SELECT a.s AS a, b.s AS b, {_arc("a", "b")} AS d FROM pos a JOIN pos b ON a.s < b.s),
lim AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}000.0::DOUBLE, {b}000.0::DOUBLE)" for i, (a, b) in enumerate(_LIMITS))}) v(band, low, high)),
c AS (SELECT a, b, band, low, high, corr(x.v, y.v) AS r FROM pairs JOIN lim ON d >= low AND d < high JOIN ser x ON x.s = a JOIN ser y ON y.s = b AND y.m = x.m GROUP BY ALL HAVING count(*) >= 3)
SELECT band::BIGINT AS band, low, high, count(*)::BIGINT AS n_pairs, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r FROM c GROUP BY ALL""")
def distance_band_pairs_sphere(t: Tables) -> DataFrame:
    """The bands 0-10-25-50-100-500 km by great-circle distance, at high latitudes across the date line."""
    k = F.col("s_suppkey") * 7 % 40
    pos = t.supplier.select(F.col("s_suppkey").alias("s"), F.when(k < 20, 178 + k / 10).otherwise(-182 + k / 10).alias("lon"), ((F.col("s_suppkey") * 13 % 37) / 10 + 60).alias("lat"))
    series = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), C.months("l_shipdate").alias("m")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(P.band_correlations_on_sphere(pos, series, "s", "m", "v"), "mean_r", "std_r")


_TILES = "SELECT s_suppkey AS tile, (s_suppkey * 97 % 900)::DOUBLE AS x0, (s_suppkey * 97 % 900 + s_suppkey * 13 % 7 * 40)::DOUBLE AS x1, (s_suppkey * 31 % 900)::DOUBLE AS y0, (s_suppkey * 31 % 900 + 25 * (1 + s_suppkey % 9))::DOUBLE AS y1 FROM supplier"


@query(f"""WITH t AS ({_TILES}), p AS (SELECT (p_partkey * 7919 % 1000)::DOUBLE AS x, (p_partkey * 104729 % 1000)::DOUBLE AS y FROM part)
SELECT t.tile, count(x)::BIGINT AS n, round(sum(x + y), 2) AS total FROM t LEFT JOIN p ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""")
def point_in_tile_extents(t: Tables) -> DataFrame:
    """Irregular extents that overlap, nest or are empty, each with its points."""
    k = F.col("s_suppkey")
    tiles = t.supplier.select(k.alias("tile"), (k * 97 % 900).cast("double").alias("x0"), (k * 97 % 900 + k * 13 % 7 * 40).cast("double").alias("x1"), (k * 31 % 900).cast("double").alias("y0"), (k * 31 % 900 + 25 * (1 + k % 9)).cast("double").alias("y1"))
    points = t.part.select((F.col("p_partkey") * 7919 % 1000).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 1000).cast("double").alias("y"))
    found = P.sums_in_extents(points, tiles, 50.0, F.col("x") + F.col("y")).withColumn("total", F.round("total", 2))
    return tiles.select("tile").join(found, "tile", "left").select("tile", F.coalesce("n", F.lit(0)).alias("n"), "total")
