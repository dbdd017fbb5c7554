"""Documents scored by the difference of two language models' cross-entropies.

Two word bigram models share one vocabulary (all words of the corpus), one order and one smoothing: the target model counts
the documents marked as wanted, the background model counts all documents. A document's score is the mean over its tokens
of (background loss - target loss) in nats: the higher, the more it reads like the target. Both models leave the document
itself out when they score it, or else every text would look as familiar as it is long.

p1(w) = (c(w) + FLOOR) / (N + FLOOR * V) and p(w | h) = (c(h, w) + MU * p1(w)) / (c(h) + MU). A text stands between a mark
for its beginning and one for its end; the end is predicted like a word.

In Spark, nothing of the models meets in one place, and their size follows the corpus:
1. Texts are read in slices of bounded size and written as word numbers with the slice's distinct words, hashed.
2. Each slice sends its distinct words and word pairs with their counts to buckets by hash, packed, one row per bucket. A
   word in every document costs one entry per slice, so no key is hot.
3. A bucket adds up what slices sent and gives each slice back, for its own entries, what all other slices counted.
4. Slices meet their counts again, take out each document's own, and score.
The number of buckets grows with the text, so a bucket's size doesn't. In a bucket, an entry is known by 40 bits of its
hash: about one of a million is taken for another one, at any size of the corpus.

Defined results: a null or empty text has no tokens, null losses and score 0; a null id is scored, and counts as background
only; repeated rows count each, so a copy is known from its twin; with no target document the target's losses come from
smoothing alone; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import written

FLOOR, MU = 0.5, 4.0
#: Characters of text in a slice (or one document), and of the corpus for each bucket.
SLICE_CHARS, BUCKET_CHARS = 12_000_000, 16_000_000
#: Bits by which a bucket tells its entries apart.
BITS = 40
_U = np.uint64
#: Stand-ins for the hashes of a text's beginning and end.
_EDGES = np.array([1, 2], dtype=np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, those of equal weight side by side."""
    return zstandard.compress(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def read_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, word numbers, hashes of the numbered words) of lower-cased texts split at white space."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    named = np.fromiter(map(bool, words), bool, len(words))  # white space at an edge leaves an empty word
    number = coded.indices.to_numpy()
    real = named[number]
    upto = np.concatenate(([0], np.cumsum(real)))[lists.offsets.to_numpy()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) >> 16 for w in words[named]), np.uint64, int(named.sum()))
    return np.diff(upto), (np.cumsum(named) - 1)[number[real]], hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Events:
    """What a slice predicts, in order: words and ends of its texts. Entries are its distinct words, then its distinct pairs."""

    doc: np.ndarray
    history: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    pairs: int
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, number: np.ndarray, hashes: np.ndarray, buckets: int) -> Events:
        """``keys``: bucket and ``BITS`` bits of each entry; the last bit is 0 for a word and 1 for a pair. ``order`` sorts them."""
        first, last = len(hashes), len(hashes) + 1
        some = np.flatnonzero(lengths)
        size = lengths[some] + 1
        ends = np.cumsum(size)
        word = np.full(int(size.sum()), last, dtype=np.int64)
        inner = np.ones(len(word), dtype=bool)
        inner[ends - 1] = False
        word[inner] = number
        history = np.concatenate(([first], word[:-1])) if len(word) else word.copy()
        history[ends - size] = first
        code, pair = np.unique(history * (last + 1) + word, return_inverse=True)
        h = np.concatenate((hashes, _EDGES))
        ones = _mixed(h + _U(0x9E3779B97F4A7C15)) & ~_U(1)
        twos = _mixed(_mixed(h[code // (last + 1)] * _U(0xD6E8FEB86659FD93)) + h[code % (last + 1)]) | _U(1)
        whole = np.concatenate((ones, twos))
        bucket = ((whole >> _U(40)) * _U(buckets)) >> _U(24)
        keys = bucket << _U(BITS) | whole & _U((1 << BITS) - 1)
        return cls(np.repeat(some, size), history, word, pair, len(code), keys, np.argsort(keys, kind="stable"))

    def counts(self, picked: np.ndarray | None = None) -> np.ndarray:
        """How often each entry occurs (in the ``picked`` events); a beginning counts as a word where it is a history."""
        word, pair, history = (self.word, self.pair, self.history) if picked is None else (self.word[picked], self.pair[picked], self.history[picked])
        words = len(self.keys) - self.pairs
        ones = np.bincount(word, minlength=words)
        ones[words - 2] = np.count_nonzero(history == words - 2)
        return np.concatenate((ones, np.bincount(pair, minlength=self.pairs)))

    def inside(self, entry: np.ndarray) -> np.ndarray:
        """How often each event's ``entry`` (a column of word or pair numbers) occurs in its document."""
        _, at, n = np.unique(self.doc * len(self.keys) + entry, return_inverse=True, return_counts=True)
        return n[at]


def _slices(rows: DataFrame) -> DataFrame:
    """(slice, doc_ids, lengths, words, hashes): runs of documents as word numbers, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        held = 0

        def send() -> pd.DataFrame:
            lengths, number, hashes = read_words(texts)
            return pd.DataFrame({"doc_ids": [ids], "lengths": [packed(lengths)], "words": [packed(number)], "hashes": [packed(hashes)]})

        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                t = t or ""
                if texts and held + len(t) > SLICE_CHARS:
                    yield send()
                    ids, texts, held = [], [], 0
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                held += len(t)
        if texts:
            yield send()

    found = rows.mapInPandas(run, "doc_ids array<long>, lengths binary, words binary, hashes binary")
    return written(found.select(F.monotonically_increasing_id().alias("slice"), "*"), "slices")


def _marks(slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(marked, places): the places in each slice of the documents whose id is in ``wanted``."""
    each = slices.select(F.col("slice").alias("marked"), F.posexplode("doc_ids").alias("place", "wanted_id")).where("wanted_id is not null")
    # merged at every size: marks grow with the documents, so they are never sent to all executors
    return each.join(wanted.hint("merge"), "wanted_id").groupBy("marked").agg(F.collect_list("place").alias("places"))  # a slice is bounded


def lm_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) of every row; ``target`` has the wanted ids in its column doc_id."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(1, -(-(plain.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS))
    slices = _slices(plain)
    wanted = target.select(F.col("doc_id").cast("long").alias("wanted_id")).where("wanted_id is not null").distinct()
    marks = _marks(slices, wanted)

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["slice", "bucket", "keys", "every", "target", "events", "wanted", "marks"])
        row = left.iloc[0]
        lengths = unpacked(row["lengths"]).astype(np.int64)
        e = Events.of(lengths, unpacked(row["words"]).astype(np.int64), unpacked(row["hashes"]), buckets)
        mark = np.zeros(len(lengths), dtype=bool)
        if len(right):
            mark[np.asarray(right["places"].iloc[0], dtype=np.int64)] = True
        keys, every, ours = e.keys[e.order], e.counts()[e.order], e.counts(mark[e.doc])[e.order]
        cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << _U(BITS))
        out = []
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            head = b == 0
            step = np.diff(keys[x:y], prepend=_U(b << BITS))
            out.append((int(row["slice"]), b, packed(step), packed(every[x:y]), packed(ours[x:y]), len(e.word) * head, int(mark[e.doc].sum()) * head, packed(mark) if head else None))
        return pd.DataFrame(out, columns=["slice", "bucket", "keys", "every", "target", "events", "wanted", "marks"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Per slice: what the other slices counted of its entries."""
        start = _U(int(rows["bucket"].iloc[0]) << BITS)
        each = [np.cumsum(unpacked(k), dtype=np.uint64) + start for k in rows["keys"]]
        cuts = np.cumsum([len(k) for k in each])[:-1]
        keys = np.concatenate(each)
        _, at = np.unique(keys, return_inverse=True)
        out = {}
        for name in ("every", "target"):
            own = np.concatenate([unpacked(x) for x in rows[name]]).astype(np.int64)
            total = np.bincount(at, own, minlength=1).astype(np.int64)  # exact below 2**53
            out[name] = [packed(x) for x in np.split(total[at] - own, cuts)]
        words = len(np.unique(keys[keys & _U(1) == 0]))
        return rows.assign(**out, words=words)[["slice", "bucket", "every", "target", "events", "wanted", "marks", "words"]]

    sent = slices.groupBy("slice").cogroup(marks.groupBy("marked")).applyInPandas(send, "slice long, bucket long, keys binary, every binary, target binary, events long, wanted long, marks binary")
    others = sent.groupBy("bucket").applyInPandas(merge, "slice long, bucket long, every binary, target binary, events long, wanted long, marks binary, words long")
    others = written(others, "others")
    each = others.groupBy("bucket").agg(F.sum("events").alias("n"), F.sum("wanted").alias("w"), F.max("words").alias("v"))
    total = each.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("v").alias("v")).first()
    n_words = (total.v or 0) - 1  # without the beginning, which is never predicted

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, rows = left.iloc[0], right.sort_values("bucket")
        lengths = unpacked(row["lengths"]).astype(np.int64)
        e = Events.of(lengths, unpacked(row["words"]).astype(np.int64), unpacked(row["hashes"]), buckets)
        mark = unpacked(rows["marks"].iloc[0]).astype(bool)
        own_word, own_pair = e.inside(e.word), e.inside(e.pair)
        own_history = np.concatenate(([1], own_word[:-1])) if len(own_word) else own_word
        begins = np.flatnonzero(e.history == len(e.keys) - e.pairs - 2)
        own_history[begins] = 1
        size = np.bincount(e.doc, minlength=len(lengths))
        losses = {}
        for name, all_events, picked in (("target", total.w, mark[e.doc]), ("every", total.n, None)):
            count = np.empty(len(e.keys), dtype=np.int64)
            count[e.order] = np.concatenate([unpacked(x) for x in rows[name]]).astype(np.int64)
            count += e.counts(picked)
            out = 1 if picked is None else picked.astype(np.int64)  # only what a model counted is left out of it
            ones, twos = count[: len(count) - e.pairs], count[len(count) - e.pairs :]
            left_over = all_events - (size[e.doc] if picked is None else size[e.doc] * out)
            p1 = (ones[e.word] - own_word * out + FLOOR) / (left_over + FLOOR * n_words)
            p = (twos[e.pair] - own_pair * out + MU * p1) / (ones[e.history] - own_history * out + MU)
            sums = np.bincount(e.doc, -np.log(p), minlength=len(lengths))
            losses[name] = np.divide(sums, size, out=np.full(len(lengths), np.nan), where=size > 0)
        found = pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in row["doc_ids"]], dtype="Int64"), "n_tokens": lengths, "ce_target": losses["target"], "ce_background": losses["every"]})
        found["score"] = (found["ce_background"] - found["ce_target"]).fillna(0.0)
        return found.astype({"ce_target": "Float64", "ce_background": "Float64"})

    return slices.groupBy("slice").cogroup(others.groupBy("slice")).applyInPandas(score, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
