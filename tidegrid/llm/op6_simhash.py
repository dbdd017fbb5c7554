"""SimHash near-duplicates, found with BK-trees.

1. Each text gets a 64-bit fingerprint of its word shingles (numpy, in the task that read it).
2. Equal fingerprints fold into one row first, so a third of all rows being copies costs one row per task.
3. Two fingerprints within ``radius`` bits share at least one of ``radius + 1`` slices of the 64 bits, whole. Fingerprints
   are dealt to shards by (slice number, slice value): every pair within the radius meets in a shard. A shard with more
   than ``SPLIT`` fingerprints is dealt again by the slices of its other bits, where the same holds, and so on.
4. Each shard builds a BK-tree (children keyed by the integer Hamming distance to their parent); each fingerprint looks
   for partners by following only edges within the radius. Shards hold a bounded number of fingerprints and are shipped
   to the task that searches them; none is sent to all executors, as their number grows with the data.
5. A shard reports a spanning forest of its links (one row per linked fingerprint), never all pairs, and connected
   components are found by distributed min-label hooking and pointer jumping. Edges are written to the shared folder
   each round, so lost executors cost a task and not the run.

Defined results: null and wordless texts have fingerprint zero, and link like any other; a null id is left out, since a
component is named by an id; repeated ids give one row each, with the component of that row's own text; an empty table gives an empty table; further input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import written

SEED = 42
#: Fingerprints of a shard beyond which it is dealt again by its other bits, and bits that can't tell many fingerprints apart.
SPLIT, FEW_BITS = 2_000, 11


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower: A-Z only
    if not words:
        return 0
    k, digest = words_per_shingle, xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([digest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[k - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words_per_shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, fp long")


class BKTree:
    """A tree over 64-bit codes as flat arrays; node 0 is the root. ``child[i]`` maps a distance to a node."""

    def __init__(self, codes: list[int]):
        self.codes, self.child = codes, [{} for _ in codes]
        for i in range(1, len(codes)):
            at = 0
            while (nxt := self.child[at].get(d := (codes[at] ^ codes[i]).bit_count())) is not None:
                at = nxt
            self.child[at][d] = i

    def within(self, code: int, radius: int) -> list[int]:
        """Nodes at ``radius`` or fewer bits; only edges of d - radius to d + radius are followed."""
        found, todo = [], [0] if self.codes else []
        codes, child = self.codes, self.child
        while todo:
            at = todo.pop()
            d = (codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            edges = child[at]
            if len(edges) <= 2 * radius + 1:
                todo += [n for e, n in edges.items() if d - radius <= e <= d + radius]
            else:
                todo += [edges[e] for e in range(max(1, d - radius), d + radius + 1) if e in edges]
        return found


def shard_links(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(code, smallest code of its group in this shard) for each code of ``codes`` that has a partner other than itself."""
    order = np.unique(codes)
    values = order.view(np.uint64).tolist()
    tree = BKTree(values)
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(order[i]), int(order[r])) for i in range(len(values)) if (r := find(i)) != i]


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, key, rest, width): each row once for every slice of the ``width`` bits of ``rest``, which then lose that slice."""
    parts = radius + 1
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"))
    each = each.withColumns({"a": F.expr(f"int(i * width div {parts})"), "b": F.expr(f"int((i + 1) * width div {parts})")})
    slice_ = F.expr("shiftrightunsigned(rest, a) & (shiftleft(1L, b - a) - 1)")
    high = F.expr("IF(b >= 64, 0L, shiftleft(shiftrightunsigned(rest, b), a))")
    low = F.expr("rest & (shiftleft(1L, a) - 1)")
    return each.select("fp", F.xxhash64("key", "i", slice_).alias("key"), low.bitwiseOR(high).alias("rest"), F.expr("width - (b - a)").alias("width"))


def shards(distinct: DataFrame, radius: int) -> DataFrame:
    """(key, fp): each fingerprint in the shards in which its partners within ``radius`` bits can be.

    Shards of more than ``SPLIT`` fingerprints are dealt again by what is left of their bits, until none is or so few bits
    are left that a shard can't hold many: some five times at most, however dense the fingerprints.
    """
    rows = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).alias("width"))
    done = []
    while True:
        dealt = _dealt(rows, radius)
        large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("key", F.lit(True).alias("large"))
        placed = written(dealt.join(large, "key", "left").withColumn("large", F.coalesce("large", F.lit(False)) & (F.col("width") > FEW_BITS)), "shards")
        done.append(placed.where(~F.col("large")).select("key", "fp"))
        rows = placed.where("large").drop("large")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each shard, a > b as unsigned codes are ordered by their signed form."""
    if radius < 1:  # distinct fingerprints have no links
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    placed = shards(distinct, radius)
    lone = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pairs = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by key; a key's codes may go on in the next batch."""
        key, codes, out = None, [], []

        def flush() -> None:
            if len(codes) > 1:
                out.extend(shard_links(np.array(codes, dtype=np.int64), radius))

        for b in batches:
            for k, fp in zip(b["key"].tolist(), b["fp"].tolist()):
                if k != key:
                    flush()
                    key, codes = k, []
                codes.append(fp)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            out = []
        flush()
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    met = placed.join(lone, "key", "left_semi")
    return met.repartition("key").sortWithinPartitions("key").mapInPandas(search, pairs).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node (signed order) that each node of ``edges`` reaches.

    Large-star and small-star steps in turn; each keeps the number of edges within that of the input's.
    """
    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"), "links")
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    last = None
    for _ in range(rounds):
        # large star: larger neighbours of u, and not u's smaller ones, go to the least of u and its neighbours
        near = both(now)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the least of them
        down = large.where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        now = written(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
    raise RuntimeError("components didn't settle")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row with an id."""
    marked = written(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = written(components(links(distinct.select("fp"), radius)), "roots")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id (of several, the first one read).

    Rows are judged, not ids: a row whose id also stands on another text stays if its own group has no smaller id. Rows with
    a null id stay.
    """
    row, fp = (name + "_" * max(map(len, docs.columns)) for name in ("row", "fp"))  # longer than any of the table's names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            found = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, fp])

    shape = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    held = written(docs.mapInArrow(run, shape).select(F.monotonically_increasing_id().alias(row), "*"), "fingerprinted")
    marked = held.where(F.col(id_col).isNotNull()).select(F.col(fp).alias("fp"), F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("first"))
    distinct = written(marked.groupBy("fp").agg(F.min("first").alias("first")), "distinct")
    roots = written(components(links(distinct.select("fp"), radius)), "roots")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stays = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    # merged at every size: what stays grows with the documents, so it is never sent to all executors
    kept = held.where(F.col(id_col).isNotNull()).join(stays.hint("merge"), row, "left_semi")
    return kept.unionByName(held.where(F.col(id_col).isNull())).select(*docs.columns)
