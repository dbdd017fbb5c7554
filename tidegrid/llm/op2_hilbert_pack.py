"""Packing along a space-filling curve.

A document's token ids are counted in hashed buckets; the unit vector of these counts is projected to three dimensions
with fixed random directions, and the Hilbert key of the three coordinates orders the documents: neighbours on the curve have
like words. Documents are range-sorted by that key (ties by id) and laid end to end along the curve; the line is cut every
``length`` tokens. Only the very last sequence is shorter, and it is cut at powers of two, which need no padding.

In Spark: texts are tokenized once, in the tasks that read them, and written with their keys to the shared folder. Only
(row, key, id, tokens) is range-sorted and summed up along the curve: one row per document, no texts, with a partition's
offset from one row per partition. Positions meet the ids again by a join on the row's number, which spreads evenly however
alike the documents are.

Defined results: a null or empty text is the end id alone; a null id sorts first and is kept; repeated rows are packed each;
an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.word_tokens import default_path, encoder
from tidegrid.session import written

#: Buckets of the hashed vectors, dimensions, bits per dimension.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 10


def projection(seed: int = 7) -> np.ndarray:
    """Fixed random directions of the hashed buckets."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Grid cell of a document: its projected unit vector, mapped to 0..2**BITS-1 by the normal distribution."""
    counts = np.bincount(ids.astype(np.int64) * 0x9E3779B1 >> 7 & (BUCKETS - 1), minlength=BUCKETS).astype(np.float64)
    size = np.sqrt((counts**2).sum())
    z = counts @ directions / size if size else np.zeros(DIMENSIONS)
    share = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution function
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of grid cells along the Hilbert curve (Skilling's transpose form, over all rows at once)."""
    x = np.array(cells, dtype=np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the sequences after the last full one: powers of two, longest first."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str, end_id: int) -> DataFrame:
    """(row, doc_id, key, n, ids) of every row; ``ids`` as little-endian unsigned 16-bit numbers, or 32-bit if one is larger."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, directions = encoder(vocabulary_path), projection()
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            each = [np.concatenate((x, end)) for x in enc.batch(b["text"].tolist())]
            cells = np.array([coordinates(x, directions) for x in each]).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "key": hilbert_key(cells),
                "n": [len(x) for x in each],
                "ids": [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in each],
            })

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = plain.mapInPandas(run, "doc_id long, key long, n long, ids binary")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "tokens")


def positions(tokens: DataFrame) -> DataFrame:
    """(row, at, total): where each row's tokens begin on the line along the curve."""
    line = tokens.select("key", "doc_id", "row", "n").repartitionByRange("key", "doc_id", "row")
    placed = written(line.select(F.spark_partition_id().alias("part"), "*"), "curve")
    parts = placed.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part").select("row", (F.col("before") + F.col("inside")).alias("at"), F.lit(total).alias("total"))


def pack_along_curve(docs: DataFrame, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    tokens = tokenized(docs, id_col, text_col, vocabulary_path or default_path(), end_id)
    place = positions(tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for doc_id, n, raw, at, total in zip(b["doc_id"], b["n"].tolist(), b["ids"], b["at"].tolist(), b["total"].tolist()):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                tail = cuts(total, length)
                full = total // length
                done = 0
                while done < n:
                    here = at + done
                    if here < full * length:
                        number, offset, room = here // length, here % length, length - here % length
                    else:
                        k = next(i for i, (s, size) in enumerate(tail) if here < s + size)
                        number, offset, room = full + k, here - tail[k][0], tail[k][0] + tail[k][1] - here
                    piece = ids[done : done + room]
                    row = (doc_id, done, len(piece), zlib.crc32(piece.tobytes()), n, number, offset, *[piece.astype(np.int32)] * keep_ids)
                    for k, v in zip(names, row):
                        out[k].append(v)
                    done += len(piece)
            yield pd.DataFrame(out)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    # merged at every size: positions grow with the documents, so they are never sent to all executors
    return tokens.select("row", "doc_id", "n", "ids").join(place.hint("merge"), "row").drop("row").mapInPandas(run, schema)
