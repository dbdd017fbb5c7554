"""Approximate nearest neighbours by multi-index hashing.

Vectors are scaled to unit length and turned into binary codes by learned rotations: each rotation is fitted by iterative
quantisation (rotate, take signs, rotate to the signs again) on a bounded sample, and several rotations give a longer code.
A code is split into m substrings of up to 64 bits, each with its own index. With probing radii r_1 .. r_m such that the sum
of all r_j + 1 is R + 1, two codes within Hamming distance R are within r_j in at least one substring (pigeonhole), so
probing every index entry within that distance of the query's substring meets every code within R. Those are then reranked
by their exact cosine in double precision, summed without rounding errors, so that equal vectors score alike.

The radius is learned too: the distance that holds ``COVER`` of the sample's true neighbours, which lie farther apart than
the whole table's. Long substrings prune more than short ones where it is wide, as it is for vectors without structure.

In Spark: every row is indexed. Rows are dealt evenly to shards by a hash of their id, so copies of one vector spread over
all shards. The stated query set meets each shard in blocks of bounded size; a shard returns at most k rows per query, and
only those are merged. Nothing is collected but the bounded sample.

Defined results: null vectors, zero vectors and vectors with null or non-finite components or of another length than most
take no part, neither as queries nor as candidates; equal scores rank by smaller vec_id; repeated ids each count as a
candidate row, but are searched as one query, by the least of their vectors (compared component by component), and a query
never returns rows of its own id; fewer candidates than k give fewer rows, and a query left with too few candidates within
the radius looks through all rows; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import written

#: Rows that rotations and radius are fitted on; share of true neighbours that the radius must hold; rotations.
SAMPLE, COVER, ROTATIONS = 4_096, 0.95, 3
#: Fewest and most rows that a shard is planned for, shards aimed at in between, and queries in a block.
LEAST_ROWS, MOST_ROWS, SHARDS, BLOCK_QUERIES = 1_024, 65_536, 96, 16_384
#: Bits of a substring (the last one may have fewer, and a rotation has a multiple of ``_STEP``), and the widest radius whose entries are enumerated.
_SUB, _STEP, _ENUMERATED = 64, 16, 2
_MASKS = [np.array([sum(1 << b for b in bits) for w in range(r + 1) for bits in itertools.combinations(range(_SUB), w)], dtype=np.uint64) for r in range(_ENUMERATED + 1)]


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: the same directions, exactly, and squares that neither vanish nor overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


@dataclass
class Codes:
    """Mean, rotations (side by side) and the learned radius."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def substrings(self) -> int:
        return -(-self.turn.shape[1] // _SUB)

    def radii(self, radius: int) -> list[int]:
        """Probing radii of the substrings: their sum, with one more for each, is ``radius`` + 1, shared out by bits."""
        bits, m = self.turn.shape[1], self.substrings
        upto = [(radius + 1) * min(bits, _SUB * j) // bits for j in range(m + 1)]
        return [b - a - 1 for a, b in zip(upto, upto[1:])]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Substrings of each row's code, as numbers."""
        bits = np.zeros((len(unit), self.substrings * _SUB), dtype=bool)
        bits[:, : self.turn.shape[1]] = (unit - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(unit), self.substrings)

    @classmethod
    def fit(cls, unit: np.ndarray, k: int, rotations: int = ROTATIONS, rounds: int = 25, seed: int = 3) -> Codes:
        """Iterative quantisation from ``rotations`` random starts; the radius covers the sample's k nearest."""
        n, d = unit.shape
        rng, mean = np.random.default_rng(seed), unit.mean(axis=0)
        x = unit - mean
        width = max(_STEP, -(-d // _STEP) * _STEP)
        turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((max(d, width), width)))[0][:d]
            for _ in range(rounds if d == width else 0):  # square rotations only; otherwise random directions stay
                u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            turns.append(r)
        codes = cls(mean, np.concatenate(turns, axis=1), 0)
        own = codes.encode(unit)
        picked = rng.permutation(n)[: min(n, 512)]
        near = unit[picked] @ unit.T
        near[np.arange(len(picked)), picked] = -np.inf
        k = min(k, n - 1)
        if k > 0:
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            far = np.bitwise_count(own[top] ^ own[picked][:, None, :]).sum(axis=2)
            codes.radius = int(np.ceil(np.quantile(far, COVER)))
        return codes


class SubstringIndex:
    """One substring of all codes of a shard: distinct values and the rows of each."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.distinct, first = np.unique(values[self.order], return_index=True)
        self.first = np.append(first, len(values))

    def rows(self, value: np.uint64, radius: int) -> np.ndarray:
        """Rows whose substring is within ``radius`` bits of ``value``: enumerated values, or the distinct ones looked through, whichever is fewer."""
        if radius < 0:
            return self.order[:0]
        if radius <= _ENUMERATED and len(_MASKS[radius]) < len(self.distinct):
            near = _MASKS[radius] ^ value
            at = np.minimum(np.searchsorted(self.distinct, near), len(self.distinct) - 1)
            at = at[self.distinct[at] == near]
        else:
            at = np.flatnonzero(np.bitwise_count(self.distinct ^ value) <= radius)
        sizes = self.first[at + 1] - self.first[at]
        starts = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return self.order[starts + np.arange(int(sizes.sum()))]


class Shard:
    """The indexed rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, scaled(vectors), codes
        self.unit = unit_rows(self.vectors)
        self.code = codes.encode(self.unit)
        self.indexes = [SubstringIndex(self.code[:, j]) for j in range(codes.substrings)]

    def visited(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that some substring's index holds within its probing radius."""
        seen = np.zeros(len(self.ids), dtype=bool)
        for value, index, r in zip(code, self.indexes, self.codes.radii(radius)):
            seen[index.rows(value, r)] = True
        return np.flatnonzero(seen)

    def candidates(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``."""
        rows = self.visited(code, radius)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> list[tuple[int, float]]:
        """``vector``: scaled. The last few are told apart by sums without rounding errors, which don't depend on a row's place."""
        rows = self.candidates(code, radius)
        rows = rows[self.ids[rows] != query_id]
        if not len(rows):
            return []
        rough = self.unit[rows] @ (vector / math.sqrt(vector @ vector))
        if len(rows) > k:
            rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
        size = math.sqrt(math.fsum((vector * vector).tolist()))
        score = [math.fsum((v * vector).tolist()) / (math.sqrt(math.fsum((v * v).tolist())) * size) for v in self.vectors[rows]]
        return sorted(((int(i), s) for i, s in zip(self.ids[rows], score)), key=lambda x: (-x[1], x[0]))[:k]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a finite vector that isn't zero."""
    v = F.col(vector_col).cast("array<double>")
    plain = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.where(finite & F.exists("v", lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where ``is_query`` (over ``vec_id``) holds."""
    rows = usable(vectors, id_col, vector_col)
    shape = "query_id long, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.where(F.size("v") == sizes.d), "vectors")
    share = min(1.0, 1.1 * SAMPLE / sizes.n)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(spread < share).orderBy("vec_id").limit(SAMPLE).toPandas()
    if sample.empty:
        sample = rows.limit(1).toPandas()
    codes = Codes.fit(unit_rows(scaled(np.array(sample["v"].tolist(), dtype=np.float64))), k)
    if radius is not None:
        codes.radius = radius
    sent = vectors.sparkSession.sparkContext.broadcast(codes)
    n_shards = -(-sizes.n // min(MOST_ROWS, max(LEAST_ROWS, sizes.n // SHARDS)))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = -(-queries.count() // BLOCK_QUERIES) or 1

    dealt = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards)).cast("int").alias("shard"), "vec_id", "v")
    dealt = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "v")
    asked = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks)).cast("int").alias("block"), "vec_id", "v")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "block", "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame, radius_of=None) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            c = sent.value
            shard = Shard(left["vec_id"].to_numpy(np.int64), np.array(left["v"].tolist(), dtype=np.float64), c)
            q = scaled(np.array(right["v"].tolist(), dtype=np.float64))
            own = c.encode(unit_rows(q))
            reach = c.radius if radius_of is None else radius_of
            for query_id, v, code in zip(right["vec_id"].tolist(), q, own):
                out += [(query_id, i, s) for i, s in shard.nearest(query_id, v, code, reach, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def run(a: DataFrame, radius_of: int | None) -> DataFrame:
        return dealt.groupBy("shard", "block").cogroup(a.groupBy("shard", "block")).applyInPandas(lambda x, y: search(x, y, radius_of), shape)

    first = written(ranked(run(asked, None)), "nearest")
    if sizes.n <= 1:
        return first
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, sizes.n - 1))
    short = asked.join(full, asked.vec_id == full.query_id, "left_anti")
    if short.isEmpty():
        return first
    # queries with too few rows within the radius: the same index with the whole code as radius
    again = ranked(run(short, codes.turn.shape[1]))
    return first.join(full.select("query_id"), "query_id", "left_semi").unionByName(again)
