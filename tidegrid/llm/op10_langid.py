"""Language identification with a blended-spectrum string kernel.

The kernel of two texts compares which character n-grams (n = 1 to 5) each holds, whatever their number:
``k(x, z) = sum over n of |X_n & Z_n| / sqrt(|X_n| |Z_n|) / 5``. With Nyström landmarks z_1..z_m the features of a text are
``k(x, Z) K_ZZ^(-1/2)``, and one-versus-rest kernel ridge regression fits a weight vector per language on them.

The kernel is linear in the n-gram presence vectors, so landmarks and ridge weights fold into one matrix per n (n-grams by
languages). A batch of texts is scored by one product per n of its sparse presence rows with them: same numbers, far less work.

The ridge outputs of all languages sum to the same value for every text, so the best one tells languages apart but not
whether the text is in any of them. That is read from the share of the text's n-grams (n = 2 to 4) that some landmark holds.
The least share is learned: ``FALSE_REJECTS`` of the texts learned from are below it, each against the other landmarks.

The model is fitted on at most ``SAMPLE`` labelled texts, or ``LEAST`` of each language if that is more (whole texts; the
presence vectors are made on the executors). Its size depends on the languages alone, and it is what is broadcast. All rows are then scored in the tasks that read them, without a shuffle.

Defined results: a null text or one with no letter is ``und`` with score 0; rows with a null id are scored, and neither
learned from nor held out; repeated rows score alike; with no labelled text every row is ``und``; an empty table gives an
empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.rows import keep_rows

#: Labelled texts learned from, over all languages, and of one language at least; landmarks among them (one per language at least).
SAMPLE, LEAST, LANDMARKS = 1_200, 8, 192
#: Buckets of the hashed n-grams for n = 1 to 5.
BUCKETS = (1_024, 8_192, 32_768, 65_536, 65_536)
RIDGE = 3e-3
#: Share of the texts learned from that may be taken for texts in none of the languages; and the n whose n-grams tell.
FALSE_REJECTS, TELLING = 0.005, (2, 3, 4)
UNKNOWN = "und"

_ALPHA = np.array([c.isalpha() for c in map(chr, range(0x10000))], dtype=bool)


def presence(text: str | None) -> list[np.ndarray]:
    """The buckets of the n-grams that the lower-cased text holds, for each n; other than letters counts as one space."""
    if not text:
        return [np.empty(0, dtype=np.int64)] * len(BUCKETS)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _ALPHA[np.minimum(codes, 0xFFFF)] & (codes < 0x10000) | (codes >= 0x10000)
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = np.concatenate(([32], codes[keep], [32]))
    out = []
    for n, size in enumerate(BUCKETS, 1):
        many = max(0, len(codes) - n + 1)
        h = codes[:many].copy()
        for i in range(1, n):
            h = h * 0x9E3779B1 + codes[i : many + i]
        h = ((h * 0x2545F4914F6CDD1D) >> 20) & 0x7FFFFFFFFFF if n > 1 else h
        seen = np.zeros(size, dtype=bool)
        seen[h % size] = True
        out.append(np.flatnonzero(seen))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def rows_of(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Presence sets as rows of ones over the root of their size."""
    m = np.zeros((len(sets), size), dtype=np.float32)
    for i, s in enumerate(sets):
        if len(s):
            m[i, s] = 1 / np.sqrt(len(s))
    return m


def product(sets: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """``rows_of(sets, len(w)) @ w`` without the zeros."""
    out = np.zeros((len(sets), w.shape[1]))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(w[np.concatenate([sets[i] for i in some])], starts, axis=0) / np.sqrt(sizes[some])[:, None]
    return out


def known_share(sets: list[list[np.ndarray]], held: list[np.ndarray], least: np.ndarray | int = 1) -> np.ndarray:
    """Per text, the share of its n-grams that at least ``least`` landmarks hold (``held``: per bucket), mean over ``TELLING``."""
    shares = np.full((len(TELLING), len(sets)), np.nan)
    for row, n in zip(shares, TELLING):
        sizes = np.fromiter((len(s[n - 1]) for s in sets), np.int64, len(sets))
        some = np.flatnonzero(sizes)
        if len(some):
            found = held[n - 1][np.concatenate([sets[i][n - 1] for i in some])] >= np.repeat(np.broadcast_to(least, len(sets))[some], sizes[some])
            row[some] = np.add.reduceat(found, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64) / sizes[some]
    there = ~np.isnan(shares)
    return np.where(there, shares, 0).sum(axis=0) / np.maximum(1, there.sum(axis=0))


def least_share(shares: np.ndarray, rate: float = FALSE_REJECTS) -> float:
    """The value that at most ``rate`` of rows like these are below. Too few rows for the rate: as far below the least one as that is below the median."""
    ordered = np.sort(shares)
    k = int(rate * (len(ordered) + 1))
    return float(ordered[k - 1] if k else 2 * ordered[0] - np.median(ordered)) if len(ordered) else 0.0


@dataclass
class KernelModel:
    """``weights[n - 1]``: buckets by languages; landmarks and ridge weights folded. ``held[n - 1]``: landmarks that hold each bucket."""

    languages: list[str]
    weights: list[np.ndarray]
    bias: np.ndarray
    held: list[np.ndarray]
    least_known: float

    @classmethod
    def fit(cls, sets: list[list[np.ndarray]], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
        """``sets``: presence sets of each text; landmarks are spread evenly over the texts ordered by language."""
        languages = sorted(set(labels))
        order = sorted(range(len(labels)), key=lambda i: labels[i])
        marks = [order[i] for i in np.unique(np.linspace(0, len(order) - 1, min(max(landmarks, len(languages)), len(order))).astype(int))]
        k = np.zeros((len(sets), len(marks)))
        for n, size in enumerate(BUCKETS):
            z = rows_of([sets[i][n] for i in marks], size).T
            for i in range(0, len(sets), 128):  # a block of texts at a time
                k[i : i + 128] += rows_of([s[n] for s in sets[i : i + 128]], size) @ z / len(BUCKETS)
        value, vector = np.linalg.eigh(k[marks])
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = k @ root
        y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        weight = np.sqrt(1 / np.maximum(1, (y > 0).sum(axis=0)))[np.argmax(y, axis=1)]  # languages count alike
        mean = np.average(phi, axis=0, weights=weight**2), np.average(y, axis=0, weights=weight**2)
        a = (phi - mean[0]) * weight[:, None]
        alpha = np.linalg.solve(a.T @ a + ridge * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]), a.T @ ((y - mean[1]) * weight[:, None]))
        fold = (root @ alpha / len(BUCKETS)).astype(np.float32)
        weights = [np.zeros((size, len(languages)), np.float32) for size in BUCKETS]
        for i, row in zip(marks, fold):
            for w, s in zip(weights, sets[i]):
                w[s] += row / np.sqrt(max(1, len(s)))
        held = [np.zeros(size, np.int16) for size in BUCKETS]
        for i in marks:
            for h, s in zip(held, sets[i]):
                h[s] += 1
        own = np.zeros(len(sets), np.int16)
        own[marks] = 1  # a landmark is held against the others; texts without a letter, which hold the space alone, tell nothing
        return cls(languages, weights, mean[1] - mean[0] @ alpha, held, least_share(known_share(sets, held, 1 + own)[[len(s[0]) > 1 for s in sets]]))

    def score(self, texts: list[str | None], batch: int = 256, shares: list[float] | None = None) -> tuple[list[str], np.ndarray]:
        """The language and its score: the ridge output of the best language, from -1..1 to 0..1 and clipped. ``shares``: gets the known shares."""
        names, scores = [], []
        for i in range(0, len(texts), batch):
            part = texts[i : i + batch]
            sets = [presence(t) for t in part]
            out = self.bias + sum(product([s[n] for s in sets], w) for n, w in enumerate(self.weights))
            best = out.argmax(axis=1)
            if shares is not None:
                shares += known_share(sets, self.held).tolist()
            for t, j, row in zip(part, best.tolist(), out):
                known = has_letter(t)
                names.append(self.languages[j] if known else UNKNOWN)
                scores.append(float(np.clip((row[j] + 1) / 2, 0, 1)) if known else 0.0)
        return names, np.array(scores)


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null where the id is."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % folds


def fit_language_model(docs: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """A model from at most ``sample`` of the rows where ``learn`` holds, as many of each language as there are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn")).where("learn and lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not counts:
        return None
    each = max(LEAST, sample // len(counts))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, (1.15 * each + 4) / r.n))])[F.col("lang")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [[x.astype(np.int32) for x in presence(t)] for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "spread": b["spread"], **{f"s{n}": [s[n].tobytes() for s in sets] for n in range(len(BUCKETS))}})

    picked = rows.withColumn("spread", spread).where(F.col("spread") < share).select("lang", "spread", "text")
    found = picked.mapInPandas(run, "lang string, spread double, " + ", ".join(f"s{n} binary" for n in range(len(BUCKETS)))).toPandas()
    found = found.sort_values(["lang", "spread"], kind="stable").groupby("lang", sort=False).head(each)
    sets = [[np.frombuffer(x, dtype=np.int32) for x in r] for r in found[[f"s{n}" for n in range(len(BUCKETS))]].itertuples(index=False)]
    return KernelModel.fit(sets, found["lang"].tolist()) if sets else None


def identify_language(docs: DataFrame, model: KernelModel | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            names, scores = m.score(b["text"].tolist()) if m else ([UNKNOWN] * len(b), np.zeros(len(b)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names, "score": scores})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: KernelModel | None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language (by the model's least share) with a score of at least ``least``; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list) -> list[bool]:
        if sent.value is None:
            return [False] * len(texts)
        shares: list[float] = []
        names, scores = sent.value.score(texts, shares=shares)
        return [n != UNKNOWN and s >= least and k >= sent.value.least_known for n, s, k in zip(names, scores.tolist(), shares)]

    return keep_rows(docs, text_col, judge)
