"""Toxicity scores of deobfuscated text.

Noisy channel: writers hide words by look-alike signs (1d10t, a55), by spacing or separators (i d i o t, i.d.i.o.t) and by
repeated letters (idiiiot). Each suspicious token, and each run of three or more one-letter tokens, becomes a lattice: every
position offers the letters that may have been meant, a repeated letter offers one or two of itself, a separator offers
nothing, and a space offers nothing or a word's end. Words cut into parts (idi ot) enter as such a run where none of the parts
is a known word, and all of them, laid together, are one that the scores weigh as toxic; addresses, assignments and tokens with long numbers enter part by part. Viterbi finds the path with the greatest probability under a character
model times the channel, so the model decides where words begin and end; the restored words are then scored.

Score: logistic regression on the presence of words and word beginnings that are in toxic documents more often than in
clean ones, by a log-likelihood ratio test; copies count once. Model and character model are learned from all labelled rows
(whole texts): counts are summed and the regression is fitted by Spark, from rows grouped by the features they hold. All
features that pass the test are kept, and the character model counts all words. Models hold a weight per feature and a count
per n-gram, and are broadcast; all rows are scored in the tasks that read them, without a shuffle.

Defined results: a null or empty text gets the score of a text without any feature; rows with a null id are scored, and
neither learned from nor held out; a document with several labels counts as toxic if one says so; with no labels of both
kinds every score is 0; repeated rows score alike; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.rows import keep_rows
from tidegrid.session import written

#: Least rows that must hold a feature, and clean ones that must hold a known word; least log-likelihood ratio.
LEAST_ROWS, LEAST_G2 = 3, 10.8
#: Keys counted by a task before it hands them on, and tokens whose features it remembers: they bound its memory.
COUNTED = 100_000
#: Features that are looked for at once; for more of them the rows are read again.
CANDIDATES = 20_000
#: Places (as a power of 2) of the hashes of the learned rows' ids.
PLACES = 26
#: Rows of different features that a task holds while the regression is fitted.
ROWS_OF_A_TASK = 50_000
#: Signs and the letters they are written for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = ".-_*~,'’·/\\"
#: What a star may stand for.
STARRED = "aeiou"
#: Channel costs in nats: a look-alike instead of its letter, a dropped separator, a dropped space, a collapsed run, a sign kept as it is.
SWAP, DROP, JOIN, COLLAPSE, KEEP = 1.0, 0.5, 0.5, 0.7, 6.0
#: Tokens remembered by a worker, and the longest that is: together they bound its memory, never the results.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
BEGINNINGS = (4, 5, 6)
#: Letters before the next one that the character model looks at, and the weight of what fewer of them tell.
CONTEXT, BACK_OFF = 3, 1.0

#: Punctuation that is no look-alike.
POINTS = ".,;:?\"'()-_*~«»¿“”„’…–—·/\\"
_POINTS = f"[{re.escape(POINTS)}]"
_ONE = r"(?:[^\W_]|[@$!|+€£¡])"  # what may stand for one letter
_ALONE = rf"{_POINTS}*+{_ONE}{_POINTS}*+!*+(?!\S)"
_SIGN = re.compile(r"[0-9@$!|+€£¡]")
_HIDDEN = re.compile(rf"([^\W\d_])\1\1|(?:{_ONE}[{re.escape(SEPARATORS)}]+){{2}}{_ONE}(?![^\W_])|[^\W\d_][.*_~·]+[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(rf"\s({_ALONE}(?:\s+{_ALONE}){{2,}}+)")  # begins with a blank, so that the search leaps from blank to blank
_MACHINE = re.compile(r"=|@[^.]*\.|\d{4}|://")
#: What parts a token that a machine wrote.
_BETWEEN = re.compile(r"[=/&?:@]+|\d{4,}|\.(?=[^\W\d_]{2})")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class CharModel:
    """Characters after up to ``CONTEXT`` others, each order smoothed by the one below; ``^`` stands for the edges of a word."""

    counts: dict[str, int] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def grams(words: Iterable[tuple[str, int]]) -> Counter:
        """How often each character stands after the ``CONTEXT`` others before it, from words and how often they stand."""
        counts: Counter = Counter()
        for w, n in words:
            s = "^" * CONTEXT + w + "^"
            for i in range(len(s) - CONTEXT):
                counts[s[i : i + CONTEXT + 1]] += n
        return counts

    @classmethod
    def of_grams(cls, grams: Counter) -> CharModel:
        """``counts``: of each n-gram, and with a NUL behind it of each history."""
        counts: Counter = Counter()
        for g, n in grams.items():
            for k in range(CONTEXT + 1):
                counts[g[k:]] += n
                counts[g[k:CONTEXT] + "\0"] += n
        return cls(dict(counts))

    @classmethod
    def fit(cls, words: Counter) -> CharModel:
        return cls.of_grams(cls.grams(words.items()))

    def share(self, before: str, c: str) -> float:
        below = self.share(before[1:], c) if before else 1 / 60
        return (self.counts.get(before + c, 0) + BACK_OFF * below) / (self.counts.get(before + "\0", 0) + BACK_OFF)

    def cost(self, before: str, c: str) -> float:
        """Nats of ``c`` after the last ``CONTEXT`` characters."""
        found = self.known.get(before + c)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[before + c] = -math.log(self.share(before, c))
        return found

    def arcs(self, c: str, run: int) -> list[tuple[str, float]]:
        """What ``run`` times the character ``c`` may have been meant for, with the channel's cost; a blank is a word's end."""
        if c == " ":
            return [(" ", 0.0), ("", JOIN)]
        out: list[tuple[str, float]] = []
        for letter, cost in [(c, 0.0 if c.isalpha() else KEEP), *[(x, SWAP) for x in LOOKS_LIKE.get(c, STARRED if c == "*" else "")]]:
            out += [(letter * k, cost + (COLLAPSE if k != run else 0.0)) for k in {1, min(run, 2)}]
        return [*out, ("", DROP)] if c in SEPARATORS else out

    def restore(self, token: str) -> str:
        """The most probable written-out words for ``token``."""
        beam: dict[str, tuple[float, tuple]] = {"^" * CONTEXT: (0.0, ())}
        for c, same in groupby(token):
            new: dict[str, tuple[float, tuple]] = {}
            arcs = self.arcs(c, sum(1 for _ in same))
            for before, (spent, done) in beam.items():
                for letters, cost in arcs:
                    state, total = before, spent + cost
                    for x in letters:
                        if x == " ":
                            if state[-1] != "^":
                                total += self.cost(state, "^")
                            state = "^" * CONTEXT
                        else:
                            total += self.cost(state, x)
                            state = state[1:] + x
                    if state not in new or total < new[state][0]:
                        new[state] = (total, (done, letters))
            beam = new
        _, done = min(((spent + (self.cost(before, "^") if before[-1] != "^" else 0.0), done) for before, (spent, done) in beam.items()), key=lambda x: x[0])
        parts = []
        while done:
            done, letters = done
            parts.append(letters)
        return "".join(reversed(parts))


def words_of(text: str | None, tokens: list[str] | None = None) -> set[str]:
    """The distinct tokens of a text, lower-cased, and its runs of one-letter tokens; ``tokens``: those of a text in lower case."""
    if not text:
        return set()
    if tokens is None:
        text = text.lower()
        tokens = text.split()
    return {*tokens, *(" ".join(m[1].split()) for m in _SPACED.finditer(f" {text}"))}


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def hidden(token: str) -> str:
    """The part of a token that goes through the lattice: without punctuation at its edges; empty if nothing seems hidden."""
    if " " in token:
        return " ".join(x.strip(POINTS).rstrip("!") or x for x in token.split()) if _LETTERS.search(token) else ""
    if token.isalpha():
        return token if _RUN.search(token) else ""
    token = token.lstrip(POINTS + "¡").rstrip(POINTS + "!")
    if _MACHINE.search(token) or not _LETTERS.search(token) or len(token) < 3:
        return ""
    return token if _SIGN.search(token) or _HIDDEN.search(token) else ""


def plain_word(token: str) -> str:
    """The token's letters where it is one word with at most punctuation around it, as most are, and nothing in it seems hidden; else empty."""
    word = token if token.isalpha() else token.lstrip(POINTS + "¡").rstrip(POINTS + "!")
    return word if word.isalpha() and not _RUN.search(word) else ""


def written_words(token: str, chars: CharModel) -> list[str]:
    """The words that a token stands for: as it is, and restored if it seems hidden."""
    if plain := plain_word(token):
        return [plain]
    words = [] if " " in token else _LETTERS.findall(token)
    for part in _BETWEEN.split(token) if " " not in token and _MACHINE.search(token) else (token,):
        if found := hidden(part):
            words += _LETTERS.findall(chars.restore(found))
    return words


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[str, float]
    bias: float
    known: frozenset[str] = frozenset()
    clean: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.toxic = {f[1:] for f, w in self.weights.items() if f[0] == "=" and w > 0}
        self.begins = {w[:n] for w in self.toxic for n in range(1, len(w))}
        self.opens = self.begins - self.known
        self.starts = {f[1 : 1 + BEGINNINGS[0]] for f in self.weights}

    def cut_words(self, tokens: list[str]) -> list[str]:
        """Runs of tokens, none of them a known word, that are a toxic word, or one with punctuation behind it, once they are laid together."""
        found: list[str] = []
        if self.opens.isdisjoint(tokens):
            return found
        for i in [i for i, t in enumerate(tokens) if t in self.opens]:
            whole = tokens[i]
            for j in range(i + 1, len(tokens)):
                if tokens[j].rstrip(POINTS + "!") in self.known:
                    break
                whole += tokens[j]
                if whole.rstrip(POINTS + "!") in self.toxic:
                    found.append(" ".join(tokens[i : j + 1]))
                if whole not in self.begins:
                    break
        return found

    def hits(self, token: str) -> list[str]:
        """The model's features that a raw token holds, after restoring it if it seems hidden."""
        return [f for w in written_words(token, self.chars) if w[: BEGINNINGS[0]] in self.starts for f in features_of(w) if f in self.weights]

    def features(self, text: str | None) -> set[str]:
        """Tokens without any feature are most tokens, and are remembered."""
        found: set[str] = set()
        text = (text or "").lower()
        tokens = text.split()
        for token in words_of(text, tokens) - self.clean:
            if hits := self.hits(token):
                found.update(hits)
            elif len(token) <= REMEMBERED_CHARS:
                if len(self.clean) >= REMEMBERED:
                    self.clean.clear()
                self.clean.add(token)
        if tokens and self.begins:
            for run in set(self.cut_words(tokens)):
                found.update(self.hits(run))
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.features(text))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_logistic(rows: DataFrame, counts: dict[int, int], n_features: int, l2: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on the mean loss, classes weighed alike. ``rows``: feature numbers (held), label (toxic) and how
    many rows (n) of the ``counts`` of each class. A step is a Spark job that sums the gradient; the rows stay with the tasks."""

    def block(part: Iterator) -> Iterator[tuple]:
        part = list(part)
        y = np.array([r.toxic for r in part], dtype=np.float64)
        owner = np.repeat(np.arange(len(part)), [len(r.held) for r in part])
        each = np.array([0.5 * r.n / max(1, counts[r.toxic]) for r in part])
        yield y, owner, np.array([j for r in part for j in r.held], dtype=np.int64), each

    def gradient(w: np.ndarray, bias: float) -> np.ndarray:
        def of(held: tuple) -> np.ndarray:
            y, owner, feature, each = held
            z = bias + np.bincount(owner, w[feature], len(y))
            off = (1 / (1 + np.exp(-z)) - y) * each
            return np.append(np.bincount(feature, off[owner], n_features), off.sum())

        return blocks.map(of).reduce(lambda a, b: a + b)

    ready = written(rows.orderBy("toxic", "held"), "toxicity-rows")
    blocks = ready.coalesce(ready.count() // ROWS_OF_A_TASK + 1).rdd.mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK)
    w, bias, m, v = np.zeros(n_features), 0.0, np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        grad = gradient(w, bias) + np.append(l2 * 1e-4 * w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    blocks.unpersist()
    return w, float(bias)


def _counted(batches: Iterable[pd.DataFrame], chars: CharModel | None) -> Iterator[pd.DataFrame]:
    """(feature, toxic, clean): rows of each class that hold it, in parts to be summed; with no character model, those of words as they stand."""
    counts, known = {0: Counter(), 1: Counter()}, {}

    def of(token: str) -> list[str]:
        if chars is None:
            words = [plain] if (plain := plain_word(token)) else [] if hidden(token) else _LETTERS.findall(token)
            return [f for w in words for f in features_of(w)]
        return [f for w in written_words(token, chars) for f in features_of(w)]

    def part() -> pd.DataFrame:
        keys = list(counts[0].keys() | counts[1].keys())
        return pd.DataFrame({"feature": pd.Series(keys, dtype=object), "toxic": np.array([counts[1][k] for k in keys], np.int64), "clean": np.array([counts[0][k] for k in keys], np.int64)})

    for b in batches:
        for text, label in zip(b["text"], b["toxic"]):
            seen: set[str] = set()
            for token in words_of(text):
                found = known.get(token)
                if found is None:
                    found = of(token)
                    if len(token) <= REMEMBERED_CHARS:
                        if len(known) >= COUNTED:
                            known.clear()
                        known[token] = found
                seen.update(found)
            counts[int(label)].update(seen)
            if len(counts[0]) + len(counts[1]) >= COUNTED:
                yield part()
                counts[0].clear()
                counts[1].clear()
    yield part()


def taken_places(keys: DataFrame, bits: int = PLACES) -> np.ndarray:
    """Which of 2^bits places the hashes of the rows of ``keys`` take, one bit a place: of one size however many rows there are."""
    at = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(1 << bits)).alias("at")).distinct()

    def block(part: pd.DataFrame) -> pd.DataFrame:
        taken = np.zeros(1 << 16, np.uint8)
        taken[part["at"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"b": [int(part["at"].iloc[0]) >> 16], "taken": [np.packbits(taken, bitorder="little").tobytes()]})

    found = np.zeros(max(1, 1 << bits >> 16) << 13, np.uint8)
    for r in at.groupBy(F.shiftright("at", 16).alias("b")).applyInPandas(block, "b long, taken binary").toLocalIterator():
        found[r.b << 13 : (r.b + 1) << 13] = np.frombuffer(r.taken, np.uint8)
    return found


def with_place_taken(df: DataFrame, cols: list[str], taken: np.ndarray, bits: int = PLACES) -> DataFrame:
    """The rows of ``df`` whose ``cols`` may be among the keys; only a join tells which are."""
    sent = df.sparkSession.sparkContext.broadcast(taken)

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        v = at.to_numpy()
        return pd.Series((sent.value[v >> 3] >> (v & 7) & 1).astype(bool))

    return df.where(may(F.pmod(F.xxhash64(*cols), F.lit(1 << bits))))


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """The different (text, toxic) of all labelled rows where ``learn`` holds, and how many of each class.

    Digests of the texts meet the labels; then only the texts of one document per digest and class are moved, once.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").where(learn)
    plain = plain.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    plain = plain.withColumn("none", F.col("text").isNull())
    each = plain.select("doc_id", "digest", "none").join(marked.hint("merge"), "doc_id").groupBy("digest", "none", "toxic").agg(F.min("doc_id").alias("doc_id"))
    keys = written(each, "toxicity-keys")
    counts = {r.toxic: r.n for r in keys.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = with_place_taken(plain, ["doc_id"], taken_places(keys.select("doc_id")))
    rows = some.join(keys.hint("merge"), ["doc_id", "digest", "none"]).dropDuplicates(["doc_id", "digest", "none", "toxic"])
    return written(rows.select("text", "toxic"), "toxicity-labelled"), counts


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """A model from the labels of all rows where ``learn`` (over ``doc_id``) holds.

    Features of the words as they stand are counted in all rows, then all features in the toxic rows. Restored words only add to
    a clean count, and the ratio falls with it: what can't reach the least ratio even so is never looked for. All others are
    counted in all rows, ``CANDIDATES`` at once, and those that reach it are kept. Words that stand in clean rows are known; the
    model holds those that are part of a toxic word, as others are never asked for.
    """
    rows, counts = labelled_texts(docs, labels, learn, id_col, text_col)
    if set(counts) != {0, 1}:
        return None

    def counted(part: DataFrame, chars: CharModel | None) -> DataFrame:
        found = part.mapInPandas(lambda b: _counted(b, chars), "feature string, toxic long, clean long")
        return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = CharModel.grams((f[1:], n) for b in batches for f, n in zip(b["feature"], b["n"]))
        yield pd.DataFrame({"gram": pd.Series(list(found), dtype=object), "n": np.array(list(found.values()), np.int64)})

    toxic, clean = F.col("toxic"), F.col("clean")
    every = written(counted(rows, None), "toxicity-words")
    words, plain = every.where(F.col("feature").startswith("=")), every.where(toxic + clean >= LEAST_ROWS)
    found = words.select("feature", (toxic + clean).alias("n")).mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    chars = CharModel.of_grams(Counter({r.gram: r.n for r in found.collect()}))
    expected = (toxic + clean) / (counts[0] + counts[1])
    g2 = 2 * (F.when(toxic > 0, toxic * F.log(toxic / (expected * counts[1]))).otherwise(0.0) + F.when(clean > 0, clean * F.log(clean / (expected * counts[0]))).otherwise(0.0))
    ratio = F.when(toxic / counts[1] > 2 * clean / counts[0], g2).otherwise(0.0)

    least = plain.where("clean > 0").select("feature", "clean")
    seen = counted(rows.where("toxic = 1"), chars).select("feature", "toxic").where(2 * toxic * math.log((counts[0] + counts[1]) / counts[1]) >= LEAST_G2 - 1e-6)
    able = seen.join(least.hint("merge"), "feature", "left").withColumn("clean", F.coalesce("clean", F.lit(0))).select("feature", ratio.alias("most"))
    names = sorted(r.feature for r in able.where(F.col("most") >= LEAST_G2 - 1e-6).collect())

    def held_of(names: list[str]) -> DataFrame:
        """(held, toxic, n): rows of each class by the places of the names that they hold."""
        place = {f: i for i, f in enumerate(names)}
        probe = ToxicityModel(chars, dict.fromkeys(place, 0.0), 0.0)

        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"held": [sorted(place[f] for f in probe.features(t)) for t in b["text"]], "toxic": b["toxic"]})

        return written(rows.mapInPandas(held, "held array<int>, toxic int").groupBy("held", "toxic").agg(F.count("*").alias("n")), "toxicity-held")

    chosen: dict[str, float] = {}
    for k in range(0, len(names), CANDIDATES):
        some = names[k : k + CANDIDATES]
        holders = held_of(some)
        count = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
        found = holders.select(F.explode("held").alias("i"), F.col("toxic").alias("y"), "n").groupBy("i").agg(count(1).alias("toxic"), count(0).alias("clean"))
        found = found.where(toxic + clean >= LEAST_ROWS).select("i", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_G2)
        chosen |= {some[r.i]: r.ratio for r in found.collect()}
    if not chosen:
        return None
    number = {f: i for i, f in enumerate(sorted(chosen, key=lambda f: (-chosen[f], f)))}
    if len(names) > CANDIDATES:
        names = list(number)
        holders = held_of(names)
    kept = {i: number[f] for i, f in enumerate(names) if f in number}

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"held": [sorted(kept[i] for i in h if i in kept) for h in b["held"]], "toxic": b["toxic"], "n": b["n"]})

    learned = holders.mapInPandas(only, "held array<int>, toxic int, n long").groupBy("held", "toxic").agg(F.sum("n").alias("n"))
    w, bias = fit_logistic(learned, counts, len(number))
    weights = {f: float(w[i]) for f, i in number.items()}
    wholes = "\n".join(ToxicityModel(chars, weights, bias).toxic)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[np.array([f[1:] in wholes for f in b["feature"]], dtype=bool)]

    known = words.where(clean >= LEAST_ROWS).select("feature").mapInPandas(asked, "feature string").collect()
    return ToxicityModel(chars, weights, bias, frozenset(r.feature[1:] for r in known))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            scores = np.array([m.score(t) if m else 0.0 for t in b["text"]], dtype=np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: [sent.value is None or sent.value.score(t) < limit for t in texts])
