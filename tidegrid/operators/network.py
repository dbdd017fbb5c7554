"""Drainage networks as edge tables (id, down_id, ...): pointer doubling instead of raster walks.

Every doubling round is written to the shared folder, so the lineage stays short and lost executors cost a task only.
A forest of depth d needs about log2(d) rounds; a cycle is found when the rounds exceed ``MOST_ROUNDS``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.running import running_sums
from tidegrid.session import written

MOST_ROUNDS = 40
#: Cells of one region that may meet in one key of a join.
CLUMP_ROWS = 65_536


def _rounds(state: DataFrame, step) -> DataFrame:
    """Apply ``step`` until no node has a jump left."""
    for _ in range(MOST_ROUNDS):
        state = written(state, "network")
        if state.where("jump is not null").isEmpty():
            return state
        state = step(state)
    raise ValueError("the network has a cycle")


def upstream_accumulate(edges: DataFrame, weight: str) -> DataFrame:
    """(id, acc): the weight of a node and of all that drains to it."""

    def step(s: DataFrame) -> DataFrame:
        gain = s.where("jump is not null").groupBy("jump").agg(F.sum("acc").alias("gain")).withColumnRenamed("jump", "id")
        ahead = s.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        return s.join(ahead, "jump", "left").join(gain, "id", "left").select("id", F.col("next").alias("jump"), (F.col("acc") + F.coalesce("gain", F.lit(0.0))).alias("acc"))

    start = edges.select("id", F.col("down_id").alias("jump"), F.col(weight).cast("double").alias("acc"))
    return _rounds(start, step).select("id", "acc")


def outlets(edges: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """(id, outlet, hops, <sum>...): the last node downstream, the edges to it, and sums of columns over the nodes passed before it."""

    def step(s: DataFrame) -> DataFrame:
        ahead = s.select(F.col("id").alias("jump"), F.col("jump").alias("_j"), F.col("outlet").alias("_o"), F.col("hops").alias("_h"), *[F.col(c).alias(f"_{c}") for c in sums])
        j = s.join(ahead, "jump", "left")
        return j.select("id", F.col("_j").alias("jump"), F.coalesce("_o", "outlet").alias("outlet"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in sums])

    moving = F.col("down_id").isNotNull()
    start = edges.select("id", F.col("down_id").alias("jump"), F.coalesce("down_id", "id").alias("outlet"), moving.cast("long").alias("hops"), *[F.when(moving, F.col(c).cast("double")).otherwise(0.0).alias(c) for c in sums])
    return _rounds(start, step).drop("jump")


def members(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, outlet): each node with the first chosen outlet at or below it; nodes with none are left out.

    The forest is cut below the chosen nodes, so each node is listed once however the catchments nest.
    """
    picked = chosen.select("id").distinct().withColumn("_cut", F.lit(True))
    cut = edges.select("id", "down_id").join(picked, "id", "left").select("id", F.when(F.col("_cut").isNull(), F.col("down_id")).alias("down_id"))
    return outlets(cut).join(picked.select(F.col("id").alias("outlet")), "outlet", "left_semi").select("id", "outlet")


def outlet_links(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(outlet, below): each chosen outlet with the next one strictly below it, or NULL.

    With ``members``, this answers every nested membership: a node is in the catchment of its outlet and of all that follow it.
    """
    picked = chosen.select("id").distinct().join(edges.select("id", "down_id"), "id").select(F.col("id").alias("outlet"), "down_id")
    return picked.join(members(edges, chosen).select(F.col("id").alias("down_id"), F.col("outlet").alias("below")), "down_id", "left").select("outlet", "below")


def interval_labels(edges: DataFrame) -> DataFrame:
    """(id, outlet, first, last): numbers from 1, so that node u drains to (or is) v exactly if v.first <= u.first <= v.last.

    A tour of each tree from its outlet upwards, branches by id and trees by outlet. A node's number is that of the next node
    downstream, one, and the sizes of the branches before its own: sums along the way down, by pointer doubling.
    """
    size = upstream_accumulate(edges.select("id", "down_id", F.lit(1).alias("_one")), "_one").select("id", F.col("acc").cast("long").alias("size"))
    sized = written(edges.select("id", "down_id").join(size, "id"), "sized")
    branches = running_sums(sized.where("down_id is not null"), "down_id", ["id"], ["size"], ["id"])
    branches = branches.select("id", "down_id", (F.col("size_upto") - F.col("size") + 1).alias("skip"))
    trees = running_sums(sized.where("down_id is null").select("id", "size", F.lit(0).alias("_all")), "_all", ["id"], ["size"], ["id"])
    trees = trees.select(F.col("id").alias("outlet"), (F.col("size_upto") - F.col("size")).alias("base"))
    roots = sized.where("down_id is null").select("id", "down_id", F.lit(0).cast("long").alias("skip"))
    way = outlets(branches.unionByName(roots), ["skip"])  # whole numbers in doubles: exact up to 2**53 nodes
    found = way.join(trees, "outlet").join(size, "id")
    first = F.col("base") + F.col("skip").cast("long") + 1
    return found.select("id", "outlet", first.alias("first"), (first + F.col("size") - 1).alias("last"))


def catchments(edges: DataFrame, chosen: DataFrame, weight: str) -> DataFrame:
    """(outlet, n, area) per chosen outlet: nested catchments each count what drains to them.

    Accumulation gives the areas in log(depth) rounds without listing members.
    """
    area = upstream_accumulate(edges, weight).withColumnRenamed("acc", "area")
    size = upstream_accumulate(edges.withColumn("_one", F.lit(1)), "_one").withColumnRenamed("acc", "n")
    return chosen.select(F.col("id").alias("outlet")).join(area.join(size, "id").withColumnRenamed("id", "outlet"), "outlet").select("outlet", F.col("n").cast("long").alias("n"), "area")


def headwaters(edges: DataFrame) -> DataFrame:
    """Nodes that nothing drains to."""
    into = edges.where("down_id is not null").select(F.col("down_id").alias("id")).distinct()
    return edges.join(into, "id", "left_anti")


def headwater_distances(edges: DataFrame, length: str | None = None, elevation: str | None = None) -> DataFrame:
    """(id, nearest, farthest): the way up to the nearest and the farthest headwater, by doubling over heads only.

    In edges, or as sums of ``length`` (of the edge below a node). With ``elevation``, also nearest_rise and farthest_rise: how much
    higher those headwaters lie. Ties go to the smaller headwater. Distances from headwaters are handed down: each round a node
    tells the node 2^k below what its own span has seen.
    """
    zero = F.lit(0).cast("long") if length is None else F.lit(0.0)
    step_len = F.lit(1).cast("long") if length is None else F.col(length).cast("double")
    height = F.lit(0.0) if elevation is None else F.col(elevation).cast("double")
    heads = headwaters(edges).select("id", F.struct(zero.alias("d"), F.col("id").alias("head"), height.alias("z")).alias("lo"), F.struct(zero.alias("d"), (-F.col("id")).alias("head"), height.alias("z")).alias("hi"))
    longer = lambda c, by: F.struct((F.col(c)["d"] + by).alias("d"), F.col(c)["head"].alias("head"), F.col(c)["z"].alias("z"))

    def step(s: DataFrame) -> DataFrame:
        told = s.where("jump is not null and hi is not null").groupBy("jump").agg(F.min(longer("lo", F.col("step"))).alias("tlo"), F.max(longer("hi", F.col("step"))).alias("thi")).withColumnRenamed("jump", "id")
        ahead = s.select(F.col("id").alias("jump"), F.col("jump").alias("_j"), F.col("step").alias("_s"))
        j = s.join(ahead, "jump", "left").join(told, "id", "left")
        return j.select("id", F.col("_j").alias("jump"), (F.col("step") + F.coalesce("_s", zero)).alias("step"), F.least("lo", "tlo").alias("lo"), F.greatest("hi", "thi").alias("hi"))

    start = edges.select("id", F.col("down_id").alias("jump"), step_len.alias("step")).join(heads, "id", "left")
    found = _rounds(start, step).select("id", F.col("lo.d").alias("nearest"), F.col("hi.d").alias("farthest"), (F.col("lo.z")).alias("_lz"), F.col("hi.z").alias("_hz"))
    if elevation is None:
        return found.drop("_lz", "_hz")
    own = F.col(elevation).cast("double")
    return found.join(edges.select("id", own.alias("_z")), "id").select("id", "nearest", "farthest", (F.col("_lz") - F.col("_z")).alias("nearest_rise"), (F.col("_hz") - F.col("_z")).alias("farthest_rise"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """(outlet, head, hops): per outlet the headwater with most edges to it (ties to the smaller id)."""
    far = outlets(edges).join(headwaters(edges).select("id"), "id", "left_semi")
    best = far.groupBy("outlet").agg(F.min_by(F.struct("id", "hops"), F.struct(-F.col("hops"), "id")).alias("s"))
    return best.select("outlet", F.col("s.id").alias("head"), F.col("s.hops").alias("hops"))


def jump_tables(edges: DataFrame) -> list[DataFrame]:
    """Tables (id, jump): table k leads 2**k nodes downstream; nodes with fewer below them are left out."""
    table = written(edges.where("down_id is not null").select("id", F.col("down_id").alias("jump")), "jumps")
    tables = []
    while not table.isEmpty():
        if len(tables) == MOST_ROUNDS:
            raise ValueError("the network has a cycle")
        tables.append(table)
        table = written(table.join(table.select(F.col("id").alias("jump"), F.col("jump").alias("_j")), "jump").select("id", F.col("_j").alias("jump")), "jumps")
    return tables


def flow_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, place, id): all nodes from each start (column id) down to its outlet, the start at place 0.

    From the longest jump to the shortest, every node found marks the one that far below it: log2(depth) rounds, each of which
    at most doubles the rows, up to the paths themselves.
    """
    found = written(starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("place"), "id").join(edges.select("id"), "id", "left_semi"), "paths")
    tables = jump_tables(edges)
    for k in range(len(tables) - 1, -1, -1):
        ahead = found.join(tables[k], "id").select("start", (F.col("place") + (1 << k)).alias("place"), F.col("jump").alias("id"))
        found = written(found.select("start", "place", "id").unionByName(ahead), "paths")
    return found.select("start", "place", "id")


def longest_path_nodes(edges: DataFrame) -> DataFrame:
    """(outlet, place, id): the nodes of each outlet's longest path, its headwater at place 0."""
    best = written(longest_paths(edges), "longest")
    paths = flow_paths(edges, best.select(F.col("head").alias("id")))
    return paths.join(best.select(F.col("head").alias("start"), "outlet"), "start").select("outlet", "place", "id")


def shreve_order(edges: DataFrame) -> DataFrame:
    """(id, shreve): headwaters at or above a node."""
    heads = headwaters(edges).select("id", F.lit(1.0).alias("is_head"))
    marked = edges.join(heads, "id", "left").withColumn("is_head", F.coalesce("is_head", F.lit(0.0)))
    return upstream_accumulate(marked, "is_head").select("id", F.col("acc").cast("long").alias("shreve"))


def strahler_order(edges: DataFrame) -> DataFrame:
    """(id, strahler): nodes above which there is one headwater have order 1; with these cut off, the same again gives order 2.

    Every round leaves at most half of the headwaters, and each takes log2(depth) steps: a long river without branches is one
    round, and the widest network has about log2(nodes) of them.
    """
    rest, done, order = edges.select("id", "down_id"), [], 1
    while True:
        counted = written(shreve_order(rest).join(rest, "id"), "strahler")
        done.append(counted.where("shreve <= 1").select("id", F.lit(order).alias("strahler")))
        rest = counted.where("shreve > 1").select("id", "down_id")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        order += 1


def strahler_by_basin(edges: DataFrame, basin: str = "basin", most: int = 100_000) -> DataFrame:
    """(id, strahler) by a vectorized helper per basin of at most ``most`` nodes; the nodes of larger ones go through ``strahler_order``."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        down = dict(zip(part["id"].tolist(), (None if pd.isna(x) else int(x) for x in part["down_id"])))
        waiting = {i: 0 for i in down}
        for d in down.values():
            if d in waiting:
                waiting[d] += 1
        seen: dict[int, list[int]] = {}
        order, ready = {}, [i for i, n in waiting.items() if n == 0]
        while ready:
            i = ready.pop()
            above = seen.get(i, [])
            m = max(above, default=1)
            order[i] = m + (above.count(m) > 1)
            d = down[i]
            if d in waiting:
                seen.setdefault(d, []).append(order[i])
                waiting[d] -= 1
                if waiting[d] == 0:
                    ready.append(d)
        if len(order) != len(part):
            raise ValueError("the network has a cycle")
        return pd.DataFrame({"id": list(order), "strahler": list(order.values())})

    large = edges.groupBy(F.col(basin).alias("_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    within = F.col(basin).eqNullSafe(F.col("_b"))
    small = edges.join(large, within, "left_anti").select("id", "down_id", basin).groupBy(basin).applyInPandas(solve, "id long, strahler int")
    rest = written(edges.join(large, within, "left_semi").select("id", "down_id"), "large-basins")
    return small if rest.isEmpty() else small.unionByName(strahler_order(rest))


def segment_gradient(edges: DataFrame, elevation: str, length: str) -> DataFrame:
    """(id, gradient): drop to the next node downstream over the length, in millionths."""
    below = edges.select(F.col("id").alias("down_id"), F.col(elevation).alias("_e"))
    return edges.join(below, "down_id").select("id", ((F.col(elevation) - F.col("_e")) / F.nullif(F.col(length).cast("double"), F.lit(0.0)) * 1e6).alias("gradient"))


def connected_clumps(cells: DataFrame, value: str) -> DataFrame:
    """(row, col, value, clump): regions of 8-connected cells of equal value, named by their smallest cell.

    Contraction: each round every region hooks onto its smallest neighbour, if that is smaller or if none hooks onto the region
    (the neighbour has then hooked onto a smaller one still, so there are no cycles and ends are smallest); hooks are
    followed by pointer doubling to their ends, the regions of the next round. Every region with neighbours hooks or is hooked
    onto, so a round leaves at most half of them, however long and winding they are.
    """
    node = F.struct("row", "col")
    near = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    grid = cells.select("row", "col", value)
    shifted = grid.select(F.col("row").alias("r0"), F.col("col").alias("c0"), value, F.explode(near).alias("d")).select("r0", "c0", value, (F.col("r0") + F.col("d.dr")).alias("row"), (F.col("c0") + F.col("d.dc")).alias("col"))
    pairs = shifted.join(grid, ["row", "col", value]).select(F.struct(F.col("r0").alias("row"), F.col("c0").alias("col")).alias("u"), node.alias("v"))
    edges, ends = written(pairs.where("u != v"), "clump-edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v"))
        least = written(least, "clump-hooks")
        hooked = least.where("v < id").select(F.col("v").alias("id")).distinct().withColumn("_hooked", F.lit(True))
        hooks = least.join(hooked, "id", "left").select("id", F.when((F.col("v") < F.col("id")) | F.col("_hooked").isNull(), F.col("v")).alias("down_id"))
        ends.append(outlets(hooks).select("id", F.col("outlet").alias("end")))
        of = lambda c: ends[-1].select(F.col("id").alias(c), F.col("end").alias(f"_{c}"))
        edges = edges.join(of("u"), "u").select(F.col("_u").alias("u"), "v").where("u != v").join(of("v"), "v").select("u", F.col("_v").alias("v")).where("u != v")
        edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "clump-edges")
    labels = None
    for found in reversed(ends):  # the ends of the last round are clumps; those of each round before are looked up in the rounds after
        labels = found.select("id", F.col("end").alias("label")) if labels is None else _relabelled(found, labels)
    if labels is None:
        return grid.select("row", "col", value, node.alias("clump"))
    named = labels.select("id.row", "id.col", "label")
    return grid.join(named, ["row", "col"], "left").select("row", "col", value, F.coalesce("label", node).alias("clump"))


def _relabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of (id, end): the label of the end, or the end itself if it has none. Ends of very many rows are looked up in a broadcast."""
    large = found.groupBy("end").agg(F.count("*").alias("_n")).where(F.col("_n") > CLUMP_ROWS).select("end")
    large = written(large.join(labels.withColumnRenamed("id", "end"), "end", "left"), "clumps")  # a row per CLUMP_ROWS cells at most
    rest = found.join(F.broadcast(large), "end", "left_anti").join(labels.withColumnRenamed("id", "end"), "end", "left")
    every = found.join(F.broadcast(large), "end").unionByName(rest)
    return written(every.select("id", F.coalesce("label", "end").alias("label")), "clumps")


def grow_fill(cells: DataFrame, value: str, reach: int, how: str = "nearest") -> DataFrame:
    """Missing values filled by the nearest valid cell within ``reach`` (ties by row, then column), or by the mean of all of them; others stay NULL."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    holes = cells.where(F.col(value).isNull()).select(F.col("row").alias("r0"), F.col("col").alias("c0"))
    around = holes.select("r0", "c0", F.explode(F.transform(steps, lambda k: F.col("r0") + k)).alias("row")).select("r0", "c0", "row", F.explode(F.transform(steps, lambda k: F.col("c0") + k)).alias("col"))
    d = F.pow(F.col("row") - F.col("r0"), 2) + F.pow(F.col("col") - F.col("c0"), 2)
    near = around.join(cells.where(F.col(value).isNotNull()), ["row", "col"]).where(d <= reach * reach)
    fill = {"nearest": F.min_by(value, F.struct(d, "row", "col")), "mean": F.avg(value)}[how]
    best = near.groupBy("r0", "c0").agg(fill.alias("_fill")).select(F.col("r0").alias("row"), F.col("c0").alias("col"), "_fill")
    return cells.join(best, ["row", "col"], "left").select("row", "col", F.coalesce(value, "_fill").alias(value))
