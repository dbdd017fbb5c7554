"""Periodic runs of words: the branching-tandem test over an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, times * q)`` words long, that no
neighbouring word extends keeping the period. Per text, in the task that read it (there is no shuffle):

1. Words become numbers. A run of the default kind repeats a window of five words, so a text in which every such window is new
   has none and is done; the others go on in batches, whose suffixes are kept apart by the text's number.
2. Prefix doubling gives the suffix array SA, its inverse ISA, and the ranks of the prefixes of 1, 2, 4 ... words; the ranks
   give the LCP of neighbours in SA by binary lifting.
3. Each LCP interval is found from the nearest smaller values on both sides, without tree nodes. The suffixes i of all its
   children but the largest are asked whether ISA[i + depth], or ISA[i - depth], lies in the interval but in another child: then a
   square of that depth branches there. With the largest child left out, a suffix is asked at most log2(n) times.
4. A square is rotated to the left as far as the words repeat (binary lifting again), which gives a run from its rightmost
   square. Multiples of a period give the same stretch: stretches merge under their smallest period.

Defined results: null and wordless texts have no runs, and the hash of an empty text; repeated rows and ids give one row each, a
null id stays; an empty table gives an empty table; further input columns are left out. Memory grows with the longest text of a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a batch of texts whose suffixes are sorted together; a longer text is a batch of its own.
BATCH_WORDS = 1 << 16
#: The window of words that any run of at least ``LEAST`` words and ``TIMES`` periods repeats: LEAST - 1 words where the period is one.
LEAST, TIMES = 6, 4

Planting = Callable[[int | None, np.ndarray], np.ndarray]


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeats_a_window(words: np.ndarray, width: int) -> bool:
    """Whether a window of ``width`` words may stand twice; a false alarm is possible, a miss isn't."""
    n = len(words) - width + 1
    if n < 2:
        return False
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed = (mixed + words[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): positions sorted by key, and the place of each position's key among the distinct keys."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


class SuffixArray:
    """Suffixes of several number sequences laid end to end; no prefix of one equals that of another.

    ``levels[k]`` ranks each position by its first 2**k words, and ends with a place for "past the end".
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        last = np.searchsorted(text, text, side="right")  # one past the end of the position's text
        order, rank = dense(text * (int(words.max()) + 1) + words)
        self.levels, width, at = [], 1, np.arange(n)
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if rank[order[-1]] == n - 1:
                break
            ahead = at + width
            second = np.where(ahead < last, rank[np.minimum(ahead, n - 1)] + 1, 0)
            order, rank = dense(rank * (n + 1) + second)
            width *= 2
        self.n, self.order, self.rank = n, order, rank
        self.lcp = self._common(order[:-1], order[1:])

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``x`` and ``y`` have in common."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][x] == self.levels[k][y]).astype(np.int64) << k
            x, y, out = x + same, y + same, out + same
        return out

    def common_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the stretches before ``x`` and ``y`` (of one text, x < y) have in common, read backwards."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = x >= 1 << k
            a, b = np.where(fits, x - (1 << k), 0), np.where(fits, y - (1 << k), 0)
            same = (fits & (self.levels[k][a] == self.levels[k][b])).astype(np.int64) << k
            x, y, out = x - same, y - same, out + same
        return out


def nearest_smaller(values: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place the nearest place before it whose value is smaller (``or_equal``: or equal); -1 where there is none.

    All places follow one another's pointers at once; a pointer skips only values that are too large.
    """
    held = np.append(values, np.iinfo(np.int64).min)  # place -1
    prev = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo):
        p = prev[todo]
        large = held[p] > values[todo] if or_equal else held[p] >= values[todo]
        todo, p = todo[large], p[large]
        prev[todo] = prev[p]
    return prev


def branching_squares(sa: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching squares: the root's copies have their longest common prefix with what follows them."""
    at = np.flatnonzero(sa.lcp > 0)  # boundary t lies between places t and t + 1 of SA
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none
    lcp, m = sa.lcp, len(sa.lcp)
    back = lambda a: m - 1 - nearest_smaller(lcp[::-1], a)[::-1]
    low, high = nearest_smaller(lcp, False)[at] + 1, back(False)[at]  # first and last place of the interval
    until = back(True)[at]  # last place of the child that begins behind the boundary
    depth = lcp[at]
    # boundaries of one interval have its first place and its depth in common; its first child begins at that place
    order = np.lexsort((at, depth, low))
    first = np.ones(len(order), bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (depth[order][1:] != depth[order][:-1])
    group = np.cumsum(first) - 1
    heads = order[first]
    begin = np.concatenate([low[heads], at[order] + 1])
    end = np.concatenate([at[heads], until[order]])
    of = np.concatenate([np.arange(len(heads)), group])
    size = end - begin + 1
    by_size = np.lexsort((-size, of))
    largest = np.zeros(len(of), bool)
    largest[by_size[np.searchsorted(of[by_size], np.arange(len(heads)))]] = True
    begin, end, of, size = (v[~largest] for v in (begin, end, of, size))
    found_at, found_period = [], []
    offsets = np.cumsum(size)
    for a in range(0, len(size), 1 << 20):  # children in slices: the suffixes asked at a time stay near a batch's words
        b = min(a + (1 << 20), len(size))
        n = size[a:b]
        child = np.repeat(np.arange(a, b), n)
        place = begin[child] + np.arange(len(child)) - np.repeat(offsets[a:b] - n - (offsets[a - 1] if a else 0), n)
        i, head = sa.order[place], heads[of[child]]
        q = depth[head]
        for j, start in ((i + q, i), (i - q, i - q)):
            inside = (j >= 0) & (j < sa.n)
            r = sa.rank[np.where(inside, j, 0)]
            hit = inside & (r >= low[head]) & (r <= high[head]) & ((r < begin[child]) | (r > end[child]))
            found_at.append(start[hit])
            found_period.append(q[hit])
    return np.concatenate(found_at), np.concatenate(found_period)


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the sequences laid end to end, by start, then period."""
    none = np.empty(0, np.int64)
    if len(words) < 2:
        return none, none, none
    sa = SuffixArray(words, text)
    at, q = branching_squares(sa)
    left = sa.common_before(at, at + q)
    start, length = at - left, 2 * q + left
    enough = length >= np.maximum(least, times * q)
    start, length, q = start[enough], length[enough], q[enough]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    smallest = np.ones(len(q), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[smallest], length[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; ties go to the smallest start, then period."""
    if not runs:
        return None
    top = max(n / q for _, n, q in runs)
    near = [r for r in runs if r[1] / r[2] >= top * (1 - 1e-12)]
    return min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def planted_tail(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words as the query takes them: in a tenth of the texts, by the id's crc32, all words from a place on repeat a stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _measured(ids: list, texts: list, planting: Planting | None, least: int, times: int) -> Iterator[tuple]:
    """A row per text: id, n_runs, the strongest run, hashes of all runs and of the kept words."""
    waiting: list[tuple] = []
    held = 0

    def row(doc_id: int | None, split: list[bytes], place: np.ndarray | None, runs: list[tuple[int, int, int]]) -> tuple:
        best = strongest(runs)
        if runs:
            mark = np.zeros(len(split) + 1, np.int64)
            for s, n, q in runs:
                mark[s + q] += 1
                mark[s + n] -= 1
            keep = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
            kept = [split[i] for i in (keep if place is None else place[keep]).tolist()]
        else:
            kept = split if place is None else [split[i] for i in place.tolist()]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())

    def flush() -> Iterator[tuple]:
        lengths = np.array([len(w[3]) for w in waiting])
        ends = np.cumsum(lengths)
        start, length, q = runs_of(np.concatenate([w[3] for w in waiting]), np.repeat(np.arange(len(waiting)), lengths), least, times)
        cuts = np.searchsorted(start, np.concatenate([[0], ends]))
        for k, (doc_id, split, place, _) in enumerate(waiting):
            a, b = cuts[k], cuts[k + 1]
            own = zip((start[a:b] - (ends[k] - lengths[k])).tolist(), length[a:b].tolist(), q[a:b].tolist())
            yield row(doc_id, split, place, list(own))

    window = min(least - 1, (times - 1) * 2) if times > 1 else 1
    for doc_id, text in zip(ids, texts):
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        split = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes.split: \x20 and \x09-\x0D only
        numbers = WordNumbers()
        words = np.fromiter(map(numbers.__getitem__, split), np.int64, len(split))
        place = None
        if planting is not None:
            moved = planting(doc_id, np.arange(len(split)))
            if len(moved) and (moved[-1] != len(split) - 1 or not np.array_equal(moved, np.arange(len(split)))):
                place, words = moved, words[moved]
        if not repeats_a_window(words, max(window, 1)):
            yield row(doc_id, split, place, [])
            continue
        waiting.append((doc_id, split, place, words))
        held += len(words)
        if held >= BATCH_WORDS:
            yield from flush()
            waiting, held = [], 0
    if waiting:
        yield from flush()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planting: Planting | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per row of ``docs``.

    The four numbers are those of the run with the greatest exact length over period. ``runs_sha256`` hashes ``start,length,period``
    lines of all runs; ``collapsed_sha256`` the words, joined by one space, without those that a run repeats after its first period.
    ``planting`` changes the order of a text's words first (id, places of the words; places out).
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        for b in batches:
            found = pd.DataFrame(_measured(b["doc_id"].tolist(), b["text"].tolist(), planting, least, times), columns=names)
            yield found.astype({c: "Int64" for c in names[:6]})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
