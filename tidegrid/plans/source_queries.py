"""Queries of the source and sink family: text derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators.aggregates import monthly_quantiles, overlap_counts
from tidegrid.plans.registry import Tables, query, r6, rounded
from tidegrid.session import shared_dir
from tidegrid.sources import text as X
from tidegrid.streaming import incremental


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_custkey::VARCHAR AS station_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS q FROM orders")
def read_commented_tsv(t: Tables) -> DataFrame:
    head = ["# daily values", "#", "agency_cd\tsite_no\tdatetime\t01_00060_00003\t01_00060_00003_cd", "5s\t15s\t20d\t14n\t10s"]
    value = F.when(F.col("o_orderkey") % 9 == 0, "Ice").otherwise(F.col("o_totalprice").cast("string"))
    body = t.orders.select(F.concat_ws("\t", F.lit("AG"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd"), value, F.lit("A")).alias("value"))
    path = _place(t, "tsv")
    body.unionByName(t.spark.createDataFrame([(x,) for x in head], "value string")).write.text(path)
    return X.read_commented_tsv(t.spark, path, "_00060_00003").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("SELECT c_custkey::VARCHAR AS no, c_acctbal AS area FROM customer")
def read_space_table(t: Tables) -> DataFrame:
    path = _place(t, "space")
    t.customer.select(F.concat_ws("  ", "c_custkey", "c_nationkey", "c_acctbal").alias("value")).unionByName(t.spark.createDataFrame([("no nation area",)], "value string")).write.text(path)
    return X.read_space_table(t.spark, path, ["no", "nation", "area"]).select("no", F.col("area").cast("double").alias("area"))


@query("SELECT c_mktsegment AS river, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def read_metadata_header(t: Tables) -> DataFrame:
    """A file per segment, each with its preamble; the body gets its file's river back."""
    path = _place(t, "meta")
    body = t.customer.select("c_mktsegment", F.col("c_acctbal").cast("string").alias("value"))
    heads = t.customer.select("c_mktsegment").distinct().select("c_mktsegment", F.concat(F.lit("# river: "), "c_mktsegment").alias("value"))
    body.unionByName(heads).repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    rows = X.read_metadata_header(t.spark, path, ["river"])
    return rows.groupBy("river").agg(F.count("*").alias("n"), F.round(F.sum(F.col("line").cast("double")), 2).alias("total"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def read_json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_acctbal AS lat, s_nationkey::DOUBLE AS lon FROM supplier")
def read_json_features(t: Tables) -> DataFrame:
    f = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("s_name").alias("name")).alias("properties"), F.struct(F.array(F.col("s_nationkey").cast("double"), "s_acctbal").alias("coordinates")).alias("geometry"))
    page = t.supplier.groupBy((F.col("s_suppkey") % 7).alias("page")).agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("json"))
    return X.read_json_features(page, "json")


@query("SELECT len(string_split(trim(p_name), ' '))::INT AS n_tokens, count(*)::BIGINT AS n_rows FROM part GROUP BY ALL")
def token_width_profile(t: Tables) -> DataFrame:
    return X.token_width_profile(t.part, "p_name")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def write_partitioned(t: Tables) -> DataFrame:
    path = _place(t, "parts")
    X.write_partitioned(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"], 4)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT printf('%d %.3f %.3f', c_custkey, c_acctbal, c_acctbal / 7) AS line FROM customer")
def write_fixed_precision(t: Tables) -> DataFrame:
    path = _place(t, "fixed")
    X.write_fixed_precision(t.customer.select("c_custkey", "c_acctbal", (F.col("c_acctbal") / 7).alias("w")), path, ["c_custkey"], ["c_acctbal", "w"], 3)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


_INC = """SELECT user_id AS station, year(ts)::INT AS yyyy, month(ts)::INT AS mm, count(value)::BIGINT AS n_obs, round(median(value), 6) AS q50, round(max(value), 6) AS qmax FROM events WHERE value IS NOT NULL GROUP BY ALL"""


@query(_INC)
def incremental_quantiles(t: Tables) -> DataFrame:
    """Two arrivals of files: the second brings only the months it touches up to date."""
    source, target, checkpoint = _place(t, "arrivals"), _place(t, "state"), _place(t, "progress")
    rows = t.events.select(F.col("user_id").alias("station"), F.col("ts").alias("date"), "value")
    for part in (0, 1):
        t.events.select(F.col("user_id").alias("station"), F.col("ts").alias("date"), "value", (F.col("event_id") % 2).alias("p")).where(F.col("p") == part).drop("p").write.mode("append").parquet(source)
        incremental.incremental_quantiles(t.spark, source, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), target, checkpoint)
    return incremental.current_quantiles(t.spark, target).select("station", "yyyy", "mm", "n_obs", r6("Q50").alias("q50"), r6("QMAX").alias("qmax"))


@query("""WITH c AS (SELECT o_custkey AS k, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m, median(o_totalprice) * 0.028316846592 AS q FROM orders GROUP BY ALL), e AS (SELECT user_id AS k, (year(ts) * 12 + month(ts))::INT AS m, median(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
j AS (SELECT c.k, c.m % 12 AS mm, q, v FROM c JOIN e ON c.k = e.k AND c.m % 12 = e.m % 12) SELECT c_nationkey, count(*)::BIGINT AS n, round(corr(q, v), 6) AS r, round(avg(q), 4) AS mean_q FROM j JOIN customer ON c_custkey = k GROUP BY ALL HAVING count(*) > 2""")
def workload_series_comparison(t: Tables) -> DataFrame:
    """Daily values to monthly quantiles, joined with the catalogue and a second source, then scored."""
    a = monthly_quantiles(t.orders.select("o_custkey", "o_orderdate", C.to_cubic_metres("o_totalprice", F.lit("CFS")).alias("q")), "o_custkey", "o_orderdate", "q")
    b = monthly_quantiles(t.events, "user_id", "ts", "value")
    key = lambda d, k: [F.col(k).alias("k"), ((F.col("yyyy") * 12 + F.col("mm")) % 12).alias("m")]
    j = a.select(*key(a, "o_custkey"), F.col("Q50").alias("q")).join(b.select(*key(b, "user_id"), F.col("Q50").alias("v")), ["k", "m"])
    out = j.join(t.customer.select(F.col("c_custkey").alias("k"), "c_nationkey"), "k").groupBy("c_nationkey").agg(F.count("*").alias("n"), C.corr("q", "v").alias("r"), F.round(F.avg("q"), 4).alias("mean_q"))
    return rounded(out.where("n > 2"), "r")


@query("""WITH s AS (SELECT event_id, user_id, event_type, value FROM events WHERE value > 0.1 AND event_id % 13 <> 0), g AS (SELECT user_id // 4 AS cell, median(value) FILTER (event_type = 'click') AS a, median(value) FILTER (event_type <> 'click') AS b FROM s GROUP BY ALL)
SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS r, round(regr_slope(b, a), 6) AS slope FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def workload_shots_agreement(t: Tables) -> DataFrame:
    """Shots through quality rules to cells, two sensors' medians per cell, then their agreement."""
    good = t.events.where("value > 0.1 and event_id % 13 <> 0")
    return overlap_counts(good, F.floor(F.col("user_id") / 4), F.col("event_type") == "click", "value")
