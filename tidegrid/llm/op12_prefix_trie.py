"""A trie of conversation prefixes by ROLLUP over positional columns of turn ids.

1. Turns are numbered in each conversation, and a turn becomes its id: a digest of role and text with the text's bytes.
2. A prefix is named by sums of four 32-bit hashes of its (position, turn id), 128 bits in all: running sums give every prefix's name
   at once, however long a conversation is, and a name follows from that of a shorter prefix and the turn ids between.
3. A conversation's turns lie in blocks of ``BLOCK`` columns; a block is keyed by the name of the node where the one before ended.
   ``GROUP BY key, ROLLUP(t1 ... t8)`` makes all prefixes of all blocks together, and grouping_id tells their depths.
4. A node's first member, the smallest, stands for it. The nodes that a conversation stands for are those from some depth on, so
   what has to be summed over a subtree is a sum over a node's members, and a second ROLLUP makes it: with Q(c) the text bytes of c
   above the depth from which c stands for its nodes (all of c's, if it stands for none), the repeated bytes in a subtree are the
   members' Q, without the first member's, less (members - 1) times the bytes above the node. No walk up the tree is needed.
5. Ids of the conversations that end at a node are joined in numeric order in chunks of 256 consecutive ids; chunks are hashed in
   order as a stream, so a node where a third of all conversations end needs no more memory than any other.

Sums and counts are combined before they are shuffled; texts are shuffled once, to be numbered.

Defined results: turns of one number go by role, then text; a null turn comes first, a null role or text is empty; rows with a null
conversation are left out; repeated rows are turns of their own; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.running import running_sums
from tidegrid.session import written

#: Positional columns of a block, and turns of a conversation that one key of a join holds at most.
BLOCK, SLICE = 8, 1 << 16
HASHES = ("a", "b", "c", "d")


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, id): turns in order from 1; ``id`` is a digest of role and text, a colon and the text's UTF-8 bytes."""
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), empty) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"))
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32)
    rows = rows.withColumn("id", F.concat(digest, F.lit(":"), F.octet_length("text").cast("string")))
    return running_sums(rows, "conv_id", [F.col("turn").asc_nulls_first(), "role", "text"], ["one"], ["id"]).select("conv_id", F.col("one_upto").alias("pos"), "id")


def rebuilt_turns(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, id): each conversation c again as the first h turns of conversation c - c % ``family``, then its own after its first h.

    h is the crc32 of c's decimal digits modulo ``most``. A row of position 0 without an id stands for the conversation itself,
    which may have no turn left.
    """
    turns = written(numbered_turns(conversations), "turns")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "id")  # at most 2 * family - 1 conversations share one
    lent = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "id")
    size = heads.groupBy("base").agg(F.max("pos").alias("_n"))
    shifted = convs.join(size, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("_n", F.lit(0))) - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SLICE))).alias("s"))
    own = turns.withColumn("s", F.floor(F.col("pos") / SLICE)).join(shifted, ["conv_id", "s"]).where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"))
    return lent.unionByName(own).unionByName(none)


def _part(turn: Column, name: str) -> Column:
    return F.coalesce(turn[name], F.lit(0))


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, ka ... kd, kbytes, t1 ... t8): names and text bytes of the prefix before a block, and the block's turns.

    A turn is a struct of four 32-bit hashes of its position and id, and its text's bytes.
    """
    digest = F.md5(F.concat_ws(":", "pos", "id"))
    there = F.col("id").isNotNull()
    parts = [F.when(there, F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")).otherwise(0).alias(n) for k, n in enumerate(HASHES)]
    each = turns.select("conv_id", "pos", there.alias("there"), *parts, F.coalesce(F.substring_index("id", ":", -1).cast("long"), F.lit(0)).alias("bytes"))
    run = running_sums(each, "conv_id", ["pos"], [*HASHES, "bytes"], ["pos", "there"])
    place = F.greatest(F.col("pos") - 1, F.lit(0))
    run = run.withColumns({"block": F.floor(place / BLOCK), "i": place % BLOCK})
    start = [F.min(F.col(f"{n}_upto") - F.col(n)).alias(f"k{n}") for n in (*HASHES, "bytes")]  # sums never fall along a conversation
    return run.groupBy("conv_id", "block").agg(*start, *[F.max(F.when(F.col("there") & (F.col("i") == i), F.struct(*HASHES, "bytes"))).alias(f"t{i + 1}") for i in range(BLOCK)])


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """(depth, bytes_above, a ... d, pa ... pd, <sums>): a row per node; ``a ... d`` name it and ``pa ... pd`` its parent."""
    t = [f"t{i + 1}" for i in range(BLOCK)]
    keys = "block, ka, kb, kc, kd, kbytes"
    rolled = blocks.sparkSession.sql(f"SELECT {keys}, {', '.join(t)}, grouping_id() AS _g, {sums} FROM {{blocks}} GROUP BY {keys}, ROLLUP({', '.join(t)})", blocks=blocks)
    rolled = rolled.withColumn("_level", F.lit(BLOCK) - F.bit_count("_g"))  # each column rolled away is a bit
    rolled = rolled.withColumn("_last", F.when(F.col("_level") > 0, F.element_at(F.array(*t), F.greatest(F.col("_level"), F.lit(1)))))
    # a column that is NULL in the data is no turn; the empty prefix of a later block is the last node of the one before
    rolled = rolled.where("_last IS NOT NULL OR (_level = 0 AND block = 0)")
    names = [sum((_part(F.col(c), n) for c in t), F.col(f"k{n}")) for n in (*HASHES, "bytes")]
    above = [c - _part(F.col("_last"), n) for c, n in zip(names, (*HASHES, "bytes"))]
    kept = [c for c in rolled.columns if c not in {*keys.split(", "), *t, "_g", "_level", "_last"}]
    return rolled.select((F.col("block") * BLOCK + F.col("_level")).alias("depth"), *[c.alias(n) for c, n in zip(names, HASHES)], *[c.alias(f"p{n}") for c, n in zip(above, HASHES)], above[-1].alias("bytes_above"), *kept)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(a ... d, ends_sha256) of the nodes where conversations end: their ids in numeric order, joined by commas."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*HASHES, F.shiftright("conv_id", 8).alias("chunk")).agg(joined.alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by node and chunk; a node may go on in the next batch."""
        node, state, out = None, None, []
        for b in batches:
            for *key, ids in zip(*[b[n].tolist() for n in HASHES], b["ids"].tolist()):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*HASHES, "ends_sha256"]).astype(dict.fromkeys(HASHES, "int64"))
            out = []
        last = [] if node is None else [(*node, state.hexdigest())]
        yield pd.DataFrame(last, columns=[*HASHES, "ends_sha256"]).astype(dict.fromkeys(HASHES, "int64"))

    shape = ", ".join(f"{n} long" for n in HASHES) + ", ends_sha256 string"
    return chunks.repartition(*HASHES).sortWithinPartitions(*HASHES, "chunk").select(*HASHES, "ids").mapInPandas(hashed, shape)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the trie of ``turns``.

    ``turns``: (conv_id, pos, id) as ``rebuilt_turns`` gives them, with a row of position 0 per conversation.
    """
    blocks = written(_blocks(turns), "blocks")
    nodes = written(_rolled(blocks, "min(conv_id) AS conv_id"), "nodes")
    children = nodes.where("depth > 0").groupBy(*[F.col(f"p{n}").alias(n) for n in HASHES]).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, list(HASHES), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # what each conversation stands for, and where it ends
    stands = nodes.groupBy("conv_id").agg(F.min_by("bytes_above", "depth").alias("q"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    t = [F.col(f"t{i + 1}") for i in range(BLOCK)]
    tops = [sum((_part(c, n) for c in t), F.col(f"k{n}")).alias(n) for n in (*HASHES, "bytes")]
    ends = blocks.select("conv_id", "block", *tops).withColumnRenamed("bytes", "total").groupBy("conv_id").agg(F.max_by(F.struct("total", *HASHES), "block").alias("e")).select("conv_id", "e.*")
    convs = written(ends.join(stands, "conv_id", "left").select("conv_id", *HASHES, F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "convs")
    weighed = blocks.join(convs.select("conv_id", "q", "leaf"), "conv_id")
    sums = _rolled(weighed, "count(*) AS n_convs, sum(q) - min_by(q, conv_id) AS q_others, sum(leaf) AS n_leaves")
    sums = sums.select(*HASHES, "n_convs", "n_leaves", (F.col("q_others") - (F.col("n_convs") - 1) * F.col("bytes_above")).alias("saved_tokens"))
    parents = nodes.select(*[F.col(n).alias(f"p{n}") for n in HASHES], F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(sums, list(HASHES)).join(_end_hashes(convs.select("conv_id", *HASHES)), list(HASHES), "left")
    # a node has one parent, a parent any number of children: the join is last, so that AQE may split it
    known = known.withColumns({f"p{n}": F.when(F.col("depth") > 0, F.col(f"p{n}")) for n in HASHES})  # the root has none
    found = known.join(parents.hint("merge"), [f"p{n}" for n in HASHES], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle_sql(family: int = 5, most: int = 9) -> str:
    """The same for DuckDB, over the view ``conversations``: prefixes as lists, subtrees by comparing their beginnings."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT conv_id, conv_id - conv_id % {family} AS base, unnest(range(1, length(conv_id::VARCHAR) + 1)) AS i, ord((conv_id::VARCHAR)[i]) AS byte FROM (SELECT DISTINCT conv_id FROM turns)),
crcs AS (SELECT conv_id, base, list_reduce(list_prepend(4294967295::BIGINT, list(byte::BIGINT ORDER BY i)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: {step})) AS crc FROM digits GROUP BY ALL),
convs AS (SELECT conv_id, base, xor(crc, 4294967295) % {most} AS h FROM crcs),
rebuilt AS (SELECT c.conv_id, 0 AS part, t.pos, t.turn FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.turn FROM convs c JOIN turns t USING (conv_id) WHERE t.pos > c.h),
lists AS (SELECT conv_id, coalesce(l, []) AS l FROM convs LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, pos) AS l FROM rebuilt GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, d AS depth, md5(l[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(l[1:d - 1]::VARCHAR) END AS parent, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS bytes, d = len(l) AS ends FROM lists, LATERAL (SELECT unnest(range(len(l) + 1)) AS d)),
nodes AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
every AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
under AS (SELECT DISTINCT top.node AS top, below.node AS below FROM prefixes top JOIN prefixes below ON top.conv_id = below.conv_id AND below.depth >= top.depth),
sums AS (SELECT top AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM under JOIN every ON every.node = under.below GROUP BY top)
SELECT e.conv_id, e.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256 FROM every e JOIN sums s USING (node) LEFT JOIN every p ON p.node = e.parent
"""
