"""Queries of the network family: customers as a forest, each draining to half its number; oracles walk recursively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import network as N
from tidegrid.plans.registry import Tables, query, r6, rounded

_E = "SELECT c_custkey AS id, CASE WHEN c_custkey > 3 THEN c_custkey // 2 END AS down_id, abs(c_acctbal) AS weight, (1 + c_custkey % 9)::DOUBLE AS length, (c_custkey * 13 % 997)::DOUBLE AS elev FROM customer"
_WALK = f"WITH RECURSIVE e AS ({_E}), w AS (SELECT id, id AS pos, down_id AS nxt, 0 AS hops, 0.0::DOUBLE AS len FROM e UNION ALL SELECT w.id, e.id, e.down_id, hops + 1, len + f.length FROM w JOIN e ON e.id = w.nxt JOIN e f ON f.id = w.pos)"


def _edges(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("id"), F.when(k > 3, F.floor(k / 2)).alias("down_id"), F.abs("c_acctbal").alias("weight"), (1 + k % 9).cast("double").alias("length"), (k * 13 % 997).cast("double").alias("elev")
    )


@query(_WALK + " SELECT w.pos AS id, round(sum(e.weight), 4) AS acc FROM w JOIN e ON e.id = w.id GROUP BY ALL")
def upstream_accumulate(t: Tables) -> DataFrame:
    return N.upstream_accumulate(_edges(t), "weight").select("id", F.round("acc", 4).alias("acc"))


@query(_WALK + " SELECT id, pos AS outlet FROM w WHERE nxt IS NULL")
def outlet_label(t: Tables) -> DataFrame:
    return N.outlets(_edges(t)).select("id", "outlet")


@query(_WALK + " SELECT w.id, hops::BIGINT AS hops, round(len, 6) AS length, round(a.elev - b.elev, 6) AS drop FROM w JOIN e a ON a.id = w.id JOIN e b ON b.id = w.pos WHERE nxt IS NULL")
def distance_to_outlet(t: Tables) -> DataFrame:
    e = _edges(t)
    out = N.outlets(e, ["length"])
    j = out.join(e.select("id", F.col("elev").alias("a")), "id").join(e.select(F.col("id").alias("outlet"), F.col("elev").alias("b")), "outlet")
    return j.select("id", "hops", r6("length").alias("length"), r6(F.col("a") - F.col("b")).alias("drop"))


@query(_WALK + " SELECT pos AS id, min(hops)::BIGINT AS nearest, max(hops)::BIGINT AS farthest FROM w WHERE id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL) GROUP BY ALL")
def nearest_farthest_headwater(t: Tables) -> DataFrame:
    return N.headwater_distances(_edges(t))


@query(_WALK + " SELECT pos AS outlet, id AS head, hops::BIGINT AS hops FROM w WHERE nxt IS NULL AND id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY hops DESC, id) = 1")
def longest_flow_path(t: Tables) -> DataFrame:
    return N.longest_paths(_edges(t))


_HEADS = "id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL)"


@query(_WALK + f""", h AS (SELECT w.pos AS id, w.id AS head, len, a.elev - b.elev AS rise FROM w JOIN e a ON a.id = w.id JOIN e b ON b.id = w.pos WHERE w.{_HEADS})
SELECT id, round(min(len), 6) AS nearest, round(max(len), 6) AS farthest, round(arg_min(rise, len * 1000000 + head), 6) AS nearest_rise, round(arg_max(rise, len * 1000000 - head), 6) AS farthest_rise FROM h GROUP BY id""")
def headwater_lengths(t: Tables) -> DataFrame:
    """Lengths up to the nearest and farthest headwater, and how much higher they lie."""
    return rounded(N.headwater_distances(_edges(t), "length", "elev"), "nearest", "farthest", "nearest_rise", "farthest_rise")


@query(_WALK + f""", b AS (SELECT pos AS outlet, id AS head FROM w WHERE nxt IS NULL AND {_HEADS} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY hops DESC, id) = 1)
SELECT outlet, hops::BIGINT AS place, pos AS id FROM b JOIN w ON w.id = b.head""")
def longest_flow_path_nodes(t: Tables) -> DataFrame:
    """The path itself, from its headwater down."""
    return N.longest_path_nodes(_edges(t))


@query(f"""WITH RECURSIVE e AS ({_E}), p AS (SELECT id, id AS outlet, [id] AS way FROM e WHERE down_id IS NULL UNION ALL SELECT e.id, outlet, list_append(way, e.id) FROM p JOIN e ON e.down_id = p.id)
SELECT a.id, a.outlet, any_value(a.k) AS first, any_value(a.k) + count(*) - 1 AS last FROM (SELECT *, row_number() OVER (ORDER BY way) AS k FROM p) a JOIN (SELECT id, unnest(way) AS above FROM p) b ON b.above = a.id GROUP BY ALL""")
def catchment_intervals(t: Tables) -> DataFrame:
    """Numbers by which a range test answers whether a node drains to another."""
    return N.interval_labels(_edges(t))


@query(_WALK + " SELECT pos AS id, count(*)::BIGINT AS shreve FROM w WHERE id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL) GROUP BY ALL")
def stream_order_shreve(t: Tables) -> DataFrame:
    return N.shreve_order(_edges(t))


@query(_WALK + " SELECT pos AS id, count(*)::BIGINT AS shreve, (max(hops) + 1)::BIGINT AS topo FROM w WHERE id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL) GROUP BY ALL")
def stream_order(t: Tables) -> DataFrame:
    """Shreve's order and the topological one (steps from the farthest headwater, from 1); Strahler's is below."""
    e = _edges(t)
    topo = N.headwater_distances(e).select("id", (F.col("farthest") + 1).alias("topo"))
    return N.shreve_order(e).join(topo, "id")


def _strahler_sql(rounds: int = 40) -> str:
    """Headwaters cut off round by round: every round leaves at most half of them, so these are enough for 2**39 headwaters."""
    parts = [_WALK.replace("w AS (", "w AS MATERIALIZED (", 1), "r1 AS (SELECT id FROM e)"]
    for k in range(1, rounds + 1):
        parts.append(f"h{k} AS (SELECT id FROM r{k} WHERE id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL AND id IN (SELECT id FROM r{k})))")
        parts.append(f"c{k} AS MATERIALIZED (SELECT pos AS id, count(*) AS n FROM w WHERE id IN (SELECT id FROM h{k}) AND pos IN (SELECT id FROM r{k}) GROUP BY ALL)")
        parts.append(f"r{k + 1} AS (SELECT id FROM c{k} WHERE n > 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id, {k}::INT AS strahler FROM c{k} WHERE n = 1" for k in range(1, rounds + 1))


@query(_strahler_sql())
def stream_order_strahler(t: Tables) -> DataFrame:
    return N.strahler_order(_edges(t))


@query(_strahler_sql())
def stream_order_strahler_by_basin(t: Tables) -> DataFrame:
    e = _edges(t)
    return N.strahler_by_basin(e.join(N.outlets(e).select("id", F.col("outlet").alias("basin")), "id"))


@query(_WALK + " SELECT pos AS outlet, count(*)::BIGINT AS n, round(sum(e.weight), 4) AS area FROM w JOIN e ON e.id = w.id WHERE pos IN (SELECT id FROM e WHERE down_id IS NULL) GROUP BY ALL")
def catchment_of_outlets(t: Tables) -> DataFrame:
    """Of every outlet of the network."""
    e = _edges(t)
    return N.catchments(e, e.where("down_id is null"), "weight").withColumn("area", F.round("area", 4))


@query(_WALK + " SELECT id, pos AS outlet FROM w WHERE pos IN (SELECT id FROM e WHERE down_id IS NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops) = 1")
def catchment_members(t: Tables) -> DataFrame:
    e = _edges(t)
    return N.members(e, e.where("down_id is null"))


_CONFLUENCES = "SELECT down_id FROM e WHERE down_id IS NOT NULL GROUP BY down_id HAVING count(*) > 1"


def _confluences(e: DataFrame) -> DataFrame:
    """Nodes that two or more others drain to."""
    return e.where("down_id is not null").groupBy(F.col("down_id").alias("id")).count().where("count > 1").select("id")


@query(_WALK + f" SELECT pos AS outlet, count(*)::BIGINT AS n, round(sum(e.weight), 4) AS area FROM w JOIN e ON e.id = w.id WHERE pos IN ({_CONFLUENCES}) GROUP BY ALL")
def catchment_of_confluences(t: Tables) -> DataFrame:
    """As above, of every confluence of the network."""
    e = _edges(t)
    return N.catchments(e, _confluences(e), "weight").withColumn("area", F.round("area", 4))


@query(_WALK + f" SELECT id, pos AS outlet FROM w WHERE pos IN ({_CONFLUENCES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops) = 1")
def catchment_members_of_confluences(t: Tables) -> DataFrame:
    e = _edges(t)
    return N.members(e, _confluences(e))


@query(_WALK + f""", c AS ({_CONFLUENCES}), n AS (SELECT id AS outlet, pos AS below FROM w WHERE id IN (FROM c) AND pos IN (FROM c) AND hops > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops) = 1)
SELECT down_id AS outlet, below FROM c LEFT JOIN n ON n.outlet = c.down_id""")
def catchment_links_of_confluences(t: Tables) -> DataFrame:
    """Each confluence with the next one below it: what nests in what."""
    e = _edges(t)
    return N.outlet_links(e, _confluences(e))


@query(_WALK + f" SELECT pos AS outlet, count(*)::BIGINT AS n_nested FROM w WHERE pos IN ({_CONFLUENCES}) AND id IN ({_CONFLUENCES}) AND hops > 0 GROUP BY ALL")
def catchment_nesting_of_confluences(t: Tables) -> DataFrame:
    """How many confluences lie above each: every node on the links below a confluence counts it once."""
    e = _edges(t)
    links = N.outlet_links(e, _confluences(e)).select(F.col("outlet").alias("id"), F.col("below").alias("down_id"))
    n = N.upstream_accumulate(links.withColumn("one", F.lit(1)), "one")
    return n.where("acc > 1").select(F.col("id").alias("outlet"), (F.col("acc") - 1).cast("long").alias("n_nested"))


@query(f"WITH e AS ({_E}) SELECT a.id, round((a.elev - b.elev) / a.length * 1e6, 4) AS gradient FROM e a JOIN e b ON a.down_id = b.id")
def segment_gradient(t: Tables) -> DataFrame:
    return N.segment_gradient(_edges(t), "elev", "length").withColumn("gradient", F.round("gradient", 4))


@query(f"WITH e AS ({_E}), h AS (SELECT id FROM e WHERE id NOT IN (SELECT down_id FROM e WHERE down_id IS NOT NULL) ORDER BY md5(id::VARCHAR || 'heads'), id LIMIT 100) SELECT id, 900000 + row_number() OVER (ORDER BY id) AS new_id FROM h")
def headwaters_sample(t: Tables) -> DataFrame:
    """A sampling operator: 100 headwaters in hash order, with new numbers."""
    from tidegrid.operators.tables import dense_ids, first_by_hash

    picked = first_by_hash(N.headwaters(_edges(t)).select("id"), "id", F.lit(100), seed="heads")
    return dense_ids(picked, ["id"], "_n").select("id", (F.col("_n") + 900000).alias("new_id"))


_G = "SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, (p_size > 20)::INT AS class FROM part"


# labelled by runs of equal cells in a row, which are few enough to be walked recursively
_CLUMPS = f"""WITH RECURSIVE g AS ({_G}), i AS (SELECT *, col - row_number() OVER (PARTITION BY row, class ORDER BY col) AS k FROM g),
u AS MATERIALIZED (SELECT *, row * 1000 + a AS id FROM (SELECT row, class, k, min(col) AS a, max(col) AS b FROM i GROUP BY ALL)),
n AS MATERIALIZED (SELECT x.id AS p, y.id AS q FROM u x JOIN u y ON abs(x.row - y.row) = 1 AND x.class = y.class AND x.a <= y.b + 1 AND y.a <= x.b + 1),
r AS (SELECT id, id AS root FROM u UNION SELECT n.p, r.root FROM r JOIN n ON n.q = r.id), m AS (SELECT id, min(root) AS clump FROM r GROUP BY ALL)
SELECT i.row::BIGINT AS row, i.col::BIGINT AS col, i.class, m.clump::BIGINT AS clump FROM i JOIN u USING (row, class, k) JOIN m USING (id)"""


@query(_CLUMPS)
def connected_clumps(t: Tables) -> DataFrame:
    """Regions of the whole grid, by class alone."""
    g = t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), (F.col("p_size") > 20).cast("int").alias("class"))
    return N.connected_clumps(g, "class").select("row", "col", "class", (F.col("clump.row") * 1000 + F.col("clump.col")).alias("clump"))


@query("""WITH g AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS v FROM part),
f AS (SELECT a.row, a.col, b.v FROM g a JOIN g b ON b.v IS NOT NULL AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 WHERE a.v IS NULL QUALIFY row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col) = 1)
SELECT g.row::BIGINT AS row, g.col::BIGINT AS col, coalesce(g.v, f.v) AS v FROM g LEFT JOIN f USING (row, col)""")
def grow_fill(t: Tables) -> DataFrame:
    g = t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("v"))
    return N.grow_fill(g, "v", 2)


@query("""WITH g AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS v FROM part),
f AS (SELECT a.row, a.col, avg(b.v) AS v FROM g a JOIN g b ON b.v IS NOT NULL AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 WHERE a.v IS NULL GROUP BY ALL)
SELECT g.row::BIGINT AS row, g.col::BIGINT AS col, round(coalesce(g.v, f.v), 6) AS v FROM g LEFT JOIN f USING (row, col)""")
def grow_fill_mean(t: Tables) -> DataFrame:
    g = t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("v"))
    return rounded(N.grow_fill(g, "v", 2, "mean"), "v")
