"""Queries of the id, sampling, set and reshape families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import cells as L
from tidegrid.operators import space as P
from tidegrid.operators import tables as J
from tidegrid.plans.registry import Tables, query


@query("SELECT l_suppkey, l_partkey, q FROM (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) = 1")
def top1_per_group(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return L.top_per_group(by, ["l_suppkey"], "q", ["l_partkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def sort_by_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice").orderBy("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderstatus, dense_rank() OVER (ORDER BY o_custkey, o_orderstatus)::BIGINT AS dense_id FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def dense_global_id(t: Tables) -> DataFrame:
    return J.dense_ids(t.orders, ["o_custkey", "o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_quantity, l_tax)::BIGINT AS coord_id FROM lineitem")
def coordinate_unique_id(t: Tables) -> DataFrame:
    return t.lineitem.join(J.dense_ids(t.lineitem, ["l_quantity", "l_tax"], "coord_id"), ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "coord_id")


@query("SELECT o_orderkey, ((dense_rank() OVER (ORDER BY o_custkey) - 1) % 5)::BIGINT AS fold FROM orders")
def group_kfold(t: Tables) -> DataFrame:
    return J.group_kfold(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "fold")


@query("""WITH g AS (SELECT c_custkey, c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || 'split'), c_custkey) <= ceil(count(*) OVER (PARTITION BY c_nationkey) * 0.2)) AS held_out, n > 10 AS trainable FROM g""")
def stratified_group_split(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    groups = t.customer.select("c_custkey", "c_nationkey").join(n, "c_custkey")
    return J.stratified_holdout(groups, "c_custkey", "c_nationkey").select("c_custkey", "c_nationkey", "held_out", (F.col("n") > 10).alias("trainable"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) % 10 = 0")
def systematic_sample(t: Tables) -> DataFrame:
    return J.systematic(t.lineitem, ["l_orderkey", "l_linenumber"], 10, ["l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, year(l_shipdate)::INT AS yyyy, count(*)::BIGINT AS n FROM lineitem WHERE substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || 'sample'), 1, 7) < '3333333' GROUP BY ALL")
def bernoulli_sample(t: Tables) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return J.hash_sample(t.lineitem, key, 0.2).groupBy("l_suppkey", F.year("l_shipdate").alias("yyyy")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_type AS tile, count(*) FILTER (value > 1) AS n_presence FROM events GROUP BY ALL), a AS (SELECT sum(n_presence) AS s, count(*) AS k FROM p),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || 'points'), event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value <= 1)
SELECT event_id, event_type FROM r, a WHERE i <= least(floor(n / 16), floor(2 * s / k)) ORDER BY md5(event_id::VARCHAR || 'points2'), event_id LIMIT 50""")
def capped_random_points(t: Tables) -> DataFrame:
    presence = t.events.groupBy(F.col("event_type").alias("tile")).agg(F.sum((F.col("value") > 1).cast("long")).alias("n_presence"))
    return J.capped_points(t.events.where("value <= 1").select("event_id", "event_type"), "event_type", "event_id", presence, 50)


_XY = "SELECT p_partkey AS k, (p_partkey * 7919 % 1000)::DOUBLE AS x, (p_partkey * 104729 % 1000)::DOUBLE AS y, md5(p_partkey::VARCHAR || 'thin') AS h FROM part"


def _thinning_sql(rounds: int = 16) -> str:
    """Round by round as the operator goes, in cells of 28 for a spacing of 40."""
    near = "(g.x - f.x) ** 2 + (g.y - f.y) ** 2 < 1600"
    parts = [f"l1 AS MATERIALIZED (SELECT * FROM ({_XY}))"]
    for k in range(1, rounds + 1):
        parts.append(f"f{k} AS MATERIALIZED (SELECT * FROM l{k} QUALIFY row_number() OVER (PARTITION BY floor(x / 28), floor(y / 28) ORDER BY h, k) = 1)")
        parts.append(f"s{k} AS MATERIALIZED (SELECT * FROM f{k} f WHERE NOT EXISTS (SELECT 1 FROM f{k} g WHERE {near} AND (g.h < f.h OR (g.h = f.h AND g.k < f.k))))")
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} f WHERE NOT EXISTS (SELECT 1 FROM s{k} g WHERE {near}))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT k, x, y FROM s{k}" for k in range(1, rounds + 1)) + f" UNION ALL SELECT -1, NULL, NULL FROM l{rounds + 1}"


@query(_thinning_sql())
def thinned_points(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 1000).cast("double").alias("y"))
    return P.maximal_thinning(p, "k", 40.0)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT 'c' AS source, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def union_all_tiles(t: Tables) -> DataFrame:
    return t.customer.select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")).unionByName(t.supplier.select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")))


@query("""WITH u AS (SELECT c_custkey AS k, 0 AS i, c_acctbal AS v FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 1, max(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT o_custkey, 2, max(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1""")
def first_valid_mosaic(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    layer = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return J.first_valid([base, layer("F"), layer("P")], ["k"], "v")


@query("""SELECT l_orderkey, l_linenumber, strftime(CASE c WHEN 'l_quantity' THEN DATE '1958-01-01' WHEN 'l_discount' THEN DATE '1958-02-01' ELSE DATE '1958-03-01' END, '%Y-%m') AS month, v AS value
FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME c VALUE v)""")
def wide_to_long_months(t: Tables) -> DataFrame:
    out = J.wide_to_long_months(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "1958-01-01")
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


@query("""SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p,
greatest(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2)) AS top FROM orders GROUP BY ALL""")
def long_to_wide(t: Tables) -> DataFrame:
    wide = L.long_to_wide(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    two = [F.round(c, 2) for c in ("F", "O", "P")]
    return wide.select("o_custkey", *[c.alias(n) for c, n in zip(two, "fop")], F.greatest(*two).alias("top"))


@query("SELECT c_custkey AS id, c_acctbal AS v, 1 AS presence FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, -9999.0::DOUBLE, 0 FROM supplier")
def presence_absence_table(t: Tables) -> DataFrame:
    there = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return L.presence_absence(there, t.supplier.select(F.col("s_suppkey").alias("id")), ["id", "v"], {"v": -9999.0})


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def label_encode(t: Tables) -> DataFrame:
    return J.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")
