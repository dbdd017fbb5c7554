"""Byte-level BPE by merge replay over a whole slice of the corpus.

A task takes the texts it reads in slices of bounded size. The distinct pieces (pre-tokens) of a slice are laid end to end
as one array of symbols. An inverted index from token pair to positions is built once; merges are then replayed in rank
order over all pieces at once, and after each merge only the touched neighbours enter the index anew. Merging never
crosses a piece, so a piece's ids depend on that piece alone: slices give the ids that one pass over all distinct pieces
of the whole corpus would, without moving a word between machines. Ids of pieces stay in the worker's bounded memory.

No shuffle. Memory: one slice, and ``REMEMBERED`` pieces.

Defined results: a null or empty text has no ids and the hashes of no bytes; lone surrogates (not valid text) count as
U+FFFD; repeated rows are encoded alike; a null id stays null; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.word_tokens import spliced

#: Characters of text in a slice; pieces that a worker remembers, and the longest of them: together they bound its memory, never the results.
SLICE_CHARS = 32_000_000
REMEMBERED, REMEMBERED_CHARS = 600_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays the merges of a rank file over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * self.size
        for token, i in ranks.items():
            self.vocab[i] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = {}  # every pair of tokens that together are a token: (left id, right id) as one number
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    merges[a * self.size + b] = rank
        self.pairs = np.array(sorted(merges), dtype=np.int64)
        self.pair_rank = np.array([merges[k] for k in self.pairs.tolist()], dtype=np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, or -1."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], -1)

    def one_by_one(self, piece: bytes) -> list[int]:
        """The plain rule for one piece: merge the leftmost pair of least rank until none is left."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x + y, self.size), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == self.size:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, as uint32."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [i for i, r in enumerate(whole) if r is None and pieces[i]]
        out: list[np.ndarray] = [np.array([] if r is None else [r], dtype="<u4") for r in whole]
        if not rest:
            return out
        raw = np.frombuffer(b"".join(pieces[i] for i in rest), dtype=np.uint8)
        lengths = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        ends = np.cumsum(lengths)
        symbol = self.byte_id[raw]
        piece = np.repeat(np.arange(len(rest)), lengths)
        after = np.arange(1, len(symbol) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(symbol) - 1)
        before[ends - lengths] = -1
        early = self._replay(symbol, before, after)
        alive = symbol >= 0
        ids, owner = symbol[alive].astype("<u4"), piece[alive]
        cuts = np.searchsorted(owner, np.arange(len(rest) + 1))
        for k, i in enumerate(rest):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        for k in np.unique(piece[early]).tolist():
            out[rest[k]] = np.array(self.one_by_one(pieces[rest[k]]), dtype="<u4")
        return out

    def _replay(self, symbol: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Merge in place: a merged position's right neighbour becomes -1 and leaves the chain.

        Returns positions where a merge made a pair of no greater rank than its own, if only until the next merge beside
        it: there the order of merges inside the piece may differ from the replay's, and the caller encodes that piece by
        the plain rule.
        """
        index: dict[int, list[np.ndarray]] = {}  # rank: positions at which a pair of that rank begins
        heap: list[int] = []
        early: list[np.ndarray] = []

        def enter(left: np.ndarray, done: int) -> None:
            ranks = self.ranks_of(symbol[left], symbol[after[left]])
            known = ranks >= 0
            if not known.any():
                return
            left, ranks = left[known], ranks[known]
            if (low := ranks <= done).any():
                early.append(left[low])
            order = np.argsort(ranks, kind="stable")
            left, ranks = left[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for rank, at in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(left, cut)):
                if rank in index:
                    index[rank].append(at)
                else:
                    index[rank] = [at]
                    heapq.heappush(heap, rank)

        enter(np.flatnonzero(after >= 0), -1)
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            right = after[at]
            good = (symbol[at] >= 0) & (right >= 0)
            at, right = at[good], right[good]
            good = self.ranks_of(symbol[at], symbol[right]) == rank
            at, right = at[good], right[good]
            if len(at) > 1 and (chained := np.concatenate(([False], right[:-1] == at[1:]))).any():
                place = np.arange(len(at))  # in a run of overlapping pairs, every other one from its left end
                keep = (place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0
                at, right = at[keep], right[keep]
            if not len(at):
                continue
            far = after[right]
            if len(at) > 1 and (beside := np.flatnonzero(far[:-1] == at[1:])).size:
                # between two merges side by side, the first one's token stood before the second one's first symbol
                between = self.ranks_of(np.full(len(beside), rank), symbol[at[1:][beside]])
                early.append(at[beside[(between >= 0) & (between <= rank)]])
            symbol[at], symbol[right] = rank, -1
            after[at] = far
            inner = far >= 0
            before[far[inner]] = at[inner]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[inner]))
            if len(touched):
                enter(np.unique(touched), rank)
        return np.concatenate(early) if early else np.empty(0, dtype=np.int64)


class _Numbers(dict):
    """Pieces to numbers in the order in which they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class PieceMemory:
    """The ids of pieces, remembered in two generations of bounded size."""

    def __init__(self, path: str, pattern: str):
        self.replay, self.pattern = MergeReplay(load_ranks(path)), regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.decimal = [str(i).encode() for i in range(self.replay.size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, of a slice. Only distinct pieces are held as strings."""
        number = _Numbers()
        split = [np.fromiter(map(number.__getitem__, self.pattern.findall(t)), np.int32) for t in texts]
        words = list(number)
        known = [self.young.get(w) or self.old.get(w) for w in words]
        new = [i for i, k in enumerate(known) if k is None]
        for i, ids in zip(new, self.replay.encode([words[i].encode() for i in new])):
            known[i] = ids.tobytes()
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat, begin = np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(size) - size
        short = {w: k for w, k in zip(words, known) if len(w) <= REMEMBERED_CHARS}
        if len(self.young) + len(short) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        if len(short) <= REMEMBERED // 2:
            self.young |= short
        return [spliced(flat, begin[s], size[s])[0] for s in split]


_memories: dict[tuple[str, str], PieceMemory] = {}


def memory(path: str, pattern: str) -> PieceMemory:
    if (path, pattern) not in _memories:
        _memories[path, pattern] = PieceMemory(path, pattern)
    return _memories[path, pattern]


def slices(batches: Iterable[pd.DataFrame], most: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows of at most ``most`` characters, or of one row."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"]):
            t = t or ""
            if texts and held + len(t) > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


def valid(text: str) -> str:
    """``text`` with lone surrogates as U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids array, n_tokens, ids_sha256, decoded_sha256) of every row; ``keep_ids=False`` leaves the ids out."""
    names = ["doc_id", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = {"doc_id": "long", "ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mem = memory(path, pattern)
        decimal, vocab = mem.decimal, mem.replay.vocab
        for doc_ids, texts in slices(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, mem.encode(list(map(valid, texts)))):
                each = ids.tolist()
                a = hashlib.sha256(b",".join(map(decimal.__getitem__, each))).hexdigest()
                b = hashlib.sha256(b"".join(map(vocab.__getitem__, each))).hexdigest()
                rows.append((doc_id, *[ids.astype(np.int32)] * keep_ids, len(each), a, b))
            yield pd.DataFrame(rows, columns=names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def decode(ids: Iterable[int], path: str) -> bytes:
    """The bytes of ``ids``."""
    vocab = {i: t for t, i in load_ranks(path).items()}
    return b"".join(vocab[i] for i in ids)
