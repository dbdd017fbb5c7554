"""Token ids written through an adaptive context-mixing range coder.

Three predictors look at each id: the id last seen after the same two ids (order 2), the id last seen after the same one
id (order 1), and adaptive frequencies of all ids (order 0). How far each of the first two has been right lately (their
confidence) selects an adaptive distribution over "order 2 was right", "order 1 was right" and "neither": that is the mix.
The outcome drives a range coder; on "neither" the id is coded by its order-0 frequency.

A block holds the ids of consecutive documents. It is reset (nothing is learned from other blocks) and carries CRC-32
checksums of its ids and of its payload. Inside a block the ids are cut into lanes of equal length which step together and
share one model, so that numpy codes a whole row of lanes at a time; each lane has its own coder state. Encoder and
decoder learn the same things in the same order.

Block layout (little-endian): magic "TGB1", ids u32, lanes u32, vocabulary u32, crc of ids u32, crc of payload u32, then
the payload: digits per lane as u16 (u32 if ids >= 2**24), then each lane's 16-bit digits one lane after another.

In Spark: documents are range-partitioned by id (the only shuffle), each partition is encoded in order into shards of
blocks written by Spark's own writer (Parquet rows: partition, block, ids of its documents, their lengths, payload), and the
shards are read back and decoded block by block. A document never spans blocks, so a block decodes alone; a lost executor
costs a task. Positions come from a running sum over one row per partition.

Defined results: a null or empty text has the end id alone; rows with a null id come first (as Spark sorts nulls), repeated
rows follow one another; an empty table gives an empty table; further columns are left out. A damaged block raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.word_tokens import default_path, encoder

MAGIC = b"TGB1"
#: Ids that a block is filled up to, and lanes in a full block.
BLOCK_IDS, LANES = 1 << 21, 8192
#: Slots of the order-2 table (hashed by two ids), steps between refreshes of the order-0 frequencies, and their gain.
SLOTS, REFRESH, GAIN = 1 << 18, 2, 24
CONFIDENT = 7  # confidence runs from 0 (never right) to this
#: By 8 * right + confidence: what an entry gains. Right: more confident; wrong: half as much, until the new id takes its place.
_GAINS = np.array([(c >> 1) - c for c in range(CONFIDENT + 1)] + [int(c < CONFIDENT) for c in range(CONFIDENT + 1)], dtype=np.int32)
MIX = 12  # bits of the mix's probabilities
_U = np.uint64
_MIX = _U(MIX)
_LOW, _DOWN, _DIGIT = _U(1 << 48), _U(48), _U(16)  # spans run from 2**48 to 2**64 between ids


class _Model:
    """The predictors and the mix, shared by the lanes of a block. A row of the mix always sums up to 2**MIX."""

    def __init__(self, vocabulary: int):
        self.n = vocabulary
        self.one = np.zeros(vocabulary + 1, dtype=np.int32)  # context: predicted id * 8 + confidence
        self.two = np.zeros(SLOTS, dtype=np.int32)
        self.weight = np.ones(vocabulary, dtype=np.int64)
        self.seen: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.tally = np.tile(np.array([24, 8, 32], dtype=np.int64), ((CONFIDENT + 1) ** 2, 1))
        self.refresh()

    def share(self) -> None:
        """The mix as interval ends: ``ends[3 * row + outcome]`` is where an outcome begins, ``sizes`` how long it is."""
        part = (1 << MIX) - 3
        total = self.tally.sum(axis=1)
        two, one = 1 + self.tally[:, 0] * part // total, 1 + self.tally[:, 1] * part // total
        sizes = np.stack((two, one, (1 << MIX) - two - one), axis=1)
        self.sizes = sizes.astype(np.uint64).ravel()
        self.ends = (np.cumsum(sizes, axis=1) - sizes).astype(np.uint64).ravel()

    def refresh(self) -> None:
        """Order-0 frequencies and mix, with what was seen since the last refresh."""
        if self.seen:
            self.weight += GAIN * np.bincount(np.concatenate(self.seen), minlength=self.n)
            self.tally += 8 * np.bincount(np.concatenate(self.places), minlength=self.tally.size).reshape(self.tally.shape)
            self.seen.clear()
            self.places.clear()
            while (large := self.tally.sum(axis=1) > 1 << 15).any():
                self.tally[large] = (self.tally[large] + 1) >> 1
        self.below = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(self.weight, out=self.below[1:])
        while self.below[-1] >= 1 << 24:
            self.weight = (self.weight + 1) >> 1
            np.cumsum(self.weight, out=self.below[1:])
        self.total = int(self.below[-1])
        self.starts, self.counts = self.below.view(np.uint64), self.weight.view(np.uint64)
        self.share()

    def predict(self, a: np.ndarray, b: np.ndarray):
        """For each lane's last two ids (b the later): table slots, both predictions, first place in the mix."""
        slot = (a * 40_503 ^ b * 1_013) & (SLOTS - 1)
        p2, p1 = self.two.take(slot), self.one.take(b)
        return slot, p2, p1, ((p2 & 7) << 3 | p1 & 7) * 3

    def learn(self, slot, b, p2, p1, place, ids) -> None:
        """Later lanes win where several write one entry; the decoder sees the same order."""
        fresh = (ids << 3 | 1).astype(np.int32)
        for held, at, p in ((self.two, slot, p2), (self.one, b, p1)):
            state = p & 7
            state[(p ^ fresh) < 8] += 8
            new = p + _GAINS.take(state)
            np.copyto(new, fresh, where=state < 2)  # wrong, and not confident
            held[at] = new
        self.places.append(place)
        self.seen.append(ids)
        if len(self.seen) == REFRESH:
            self.refresh()


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps): lanes of at least 64 ids where there are enough."""
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    if n == 0:
        return MAGIC + struct.pack("<5I", 0, 0, vocabulary, 0, 0)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)  # past the last id: zeros, coded like ids and cut off again
    model = _Model(vocabulary)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    digits = np.zeros((3 * steps + 8, lanes), dtype=np.int32)  # a digit may overflow by a carry, which is resolved at the end
    used = np.zeros(lanes, dtype=np.int64)
    everyone = np.arange(lanes)

    a = b = np.full(lanes, vocabulary, dtype=np.int64)
    for x in grid:
        slot, p2, p1, first = model.predict(a, b)
        miss = p2 >> 3 != x
        place = first + miss + (miss & (p1 >> 3 != x))
        span >>= _MIX
        add = span * model.ends.take(place)
        low += add
        over = low < add  # past 2**64: a carry into the last digit
        span *= model.sizes.take(place)
        rest = np.flatnonzero(place - first == 2)
        if len(rest):
            y = x.take(rest)
            part = span.take(rest) // _U(model.total)
            add, start = part * model.starts.take(y), low.take(rest)
            low[rest] = add = start + add
            over[rest] |= add < start
            span[rest] = part * model.counts.take(y)
        if len(w := np.flatnonzero(over)):
            digits[used.take(w) - 1, w] += 1
        while len(w := np.flatnonzero(span < _LOW)):  # put out a digit of every lane whose span got short
            start, at = low.take(w), used.take(w)
            digits[at, w] = start >> _DOWN
            used[w] = at + 1
            low[w] = start << _DIGIT
            span[w] = span.take(w) << _DIGIT
        model.learn(slot, b, p2, p1, place, x)
        a, b = b, x
    last = (low >> _DOWN) + ((low & (_LOW - _U(1))) != 0)  # one digit that lies in the final interval of at least 2**48
    digits[used, everyone] = last & _U(0xFFFF)
    over = np.flatnonzero(last > _U(0xFFFF))
    digits[used[over] - 1, over] += 1
    used += 1
    digits = digits[: int(used.max())]
    for k in range(len(digits) - 1, 0, -1):
        carry = digits[k] >> 16
        if carry.any():
            digits[k] &= 0xFFFF
            digits[k - 1] += carry
    digits = np.ascontiguousarray(digits.T.astype("<u2"))
    kind = "<u2" if n < 1 << 24 else "<u4"
    body = used.astype(kind).tobytes() + digits[np.arange(digits.shape[1])[None, :] < used[:, None]].tobytes()
    return MAGIC + struct.pack("<5I", n, lanes, vocabulary, zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if data[:4] != MAGIC or len(data) < 24:
        raise ValueError("not a block")
    n, lanes, vocabulary, sum_ids, sum_body = struct.unpack_from("<5I", data, 4)
    body = data[24:]
    if zlib.crc32(body) != sum_body:
        raise ValueError("a block's payload doesn't match its checksum")
    if n == 0:
        return np.empty(0, dtype="<u4")
    steps = -(-n // lanes)
    kind = np.dtype("<u2" if n < 1 << 24 else "<u4")
    used = np.frombuffer(body, kind, lanes).astype(np.int64)
    width = int(used.max()) + 4  # past a lane's last digit: zeros
    flat = np.zeros((lanes, width), dtype=np.uint16)
    flat[np.arange(width)[None, :] < used[:, None]] = np.frombuffer(body, "<u2", offset=lanes * kind.itemsize)
    flat = flat.ravel()
    at = np.arange(lanes) * width
    model = _Model(vocabulary)
    span = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    value = np.zeros(lanes, dtype=np.uint64)

    for _ in range(4):
        value = value << _DIGIT | flat.take(at)
        at += 1
    grid = np.empty((steps, lanes), dtype=np.int64)
    a = b = np.full(lanes, vocabulary, dtype=np.int64)
    for k in range(steps):
        slot, p2, p1, first = model.predict(a, b)
        span >>= _MIX
        place = first + (value >= span * model.ends.take(first + 1))
        place += value >= span * model.ends.take(first + 2)
        value -= span * model.ends.take(place)
        span *= model.sizes.take(place)
        outcome = place - first
        x = np.where(outcome == 0, p2, p1) >> 3
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            part, v = span.take(rest) // _U(model.total), value.take(rest)
            q = (v / part).astype(np.uint64)  # a float quotient, at most one off
            q -= part * q > v
            q += v - part * q >= part
            np.minimum(q, _U(model.total - 1), out=q)
            keyed = np.sort(q << _U(32) | np.arange(len(q), dtype=np.uint64))  # in order, the search stays in the cache
            y = np.empty(len(q), dtype=np.int64)
            y[(keyed & _U(0xFFFFFFFF)).view(np.int64)] = np.searchsorted(model.starts, keyed >> _U(32), side="right") - 1
            value[rest] = v - part * model.starts.take(y)
            span[rest] = part * model.counts.take(y)
            x[rest] = y
        while len(w := np.flatnonzero(span < _LOW)):
            here = at.take(w)
            value[w] = value.take(w) << _DIGIT | flat.take(here)
            at[w] = here + 1
            span[w] = span.take(w) << _DIGIT
        model.learn(slot, b, p2, p1, place, x)
        grid[k] = x
        a, b = b, x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != sum_ids:
        raise ValueError("a block's ids don't match their checksum")
    return ids


def write_token_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = 1, vocabulary: int = 49_408) -> None:
    """Encode ``docs`` in ascending order of id into shards of blocks under ``path``."""
    source = vocabulary_path or default_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, number = encoder(source), 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], dtype="<u4")

        def block() -> pd.DataFrame:
            payload = encode_block(np.concatenate(parts), vocabulary)
            return pd.DataFrame({"block": [number], "doc_ids": [doc_ids], "lengths": [[len(p) for p in parts]], "payload": [payload]})

        for b in batches:
            for doc_id, ids in zip(b["doc_id"], enc.batch(b["text"].tolist())):
                ids = np.concatenate((ids, end))
                if parts and held + len(ids) > BLOCK_IDS:
                    yield block()
                    number, doc_ids, parts, held = number + 1, [], [], 0
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(ids)
                held += len(ids)
        if parts:
            yield block()

    # rows of one id, or of none, are dealt on by the order they are read in, so that they needn't meet in one task
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = plain.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    blocks = ordered.mapInPandas(encode, "block long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.select(F.spark_partition_id().alias("shard"), "*").write.parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, block) of every document, decoded from the files under ``path``."""
    found = spark.read.schema("shard int, block long, doc_ids array<long>, lengths array<long>, payload binary").parquet(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids = decode_block(row.payload)
                ends = np.cumsum(np.asarray(row.lengths, dtype=np.int64))
                if ends[-1] != len(ids):
                    raise ValueError("a block's documents don't add up to its ids")
                starts = ends - np.asarray(row.lengths)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"),
                    "inside": starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())],
                    "shard": row.shard,
                    "block": row.block,
                })

    docs = found.mapInPandas(decode, "doc_id long, inside long, n_tokens long, ids_crc32 long, shard int, block long")
    sizes = found.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    # one row per shard, then per block of a shard: small tables that grow with the files, not with the documents
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    blocks = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before_block"))
    base = blocks.join(shards, "shard").select("shard", "block", (F.col("before_shard") + F.col("before_block")).alias("base"))
    return docs.join(base, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
