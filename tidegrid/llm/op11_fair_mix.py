"""Mixing sources to target weights by weighted fair queueing.

1. A document's size is its number of words. Sources are numbered in code-point order; their weights give targets in words by
   water-filling: the level at which weights, each stopped at ``most`` times its source's size, make up the budget.
2. Each source's documents are shuffled by a hash, once per epoch, ``most`` epochs one after the other. The running sum of a
   source's words divided by its target is the virtual finish time. Long documents are served in parts of at most ``part_words``
   words, as packets are, so a source is never ahead of its share by more than a part.
3. All parts are range-sorted by finish time and cut where the running total reaches the budget; the part at the cut is served as far
   as the budget goes. Since every target is reached at time one, each source ends within a part of its target.

Both orders are range sorts with offsets of one row per partition (``running_sums``): a hot source spreads over tasks like any other.

Defined results: null and wordless texts have size 0 and take nothing; a null source is one source, the last; a null id is kept
and shuffled like an id; repeated rows and ids are documents of their own; an empty table gives an empty table; a budget beyond
``most`` times all sizes takes everything that often. Further input columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.running import running_sums
from tidegrid.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is sent to all executors; more of them are joined by shuffling.
FEW_SOURCES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(source, rank, source_size, target) of the sources in ``sized`` (source, size); ``source`` may be NULL.

    The sources are sorted by the level at which they are full; at each of them, the level is what the full ones leave, divided by
    the weights of the others. The first that isn't full there gives the level of all that follow.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_one": F.lit(1).cast("long"), "_all": F.lit(0).cast("long")})
    numbered = running_sums(sources, "_all", [F.col("source").asc_nulls_last()], ["_one"], ["source", "source_size"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_one_upto") - 1, F.lit(len(weights))) + 1).cast("int"))
    numbered = numbered.select("source", F.col("_one_upto").alias("rank"), "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"), F.lit(0).cast("long").alias("_all"))
    numbered = written(numbered.withColumn("milli", F.round(F.col("weight") * 1000).cast("long")), "sources")  # sums of longs are exact
    filled = running_sums(numbered, "_all", [F.col("cap") / F.col("weight"), "rank"], ["cap", "milli"], ["rank", "weight"])
    total = numbered.agg((F.sum("source_size") * F.lit(float(share))).alias("_budget"), F.sum("milli").alias("_weights"))  # one row
    full = filled.crossJoin(F.broadcast(total)).select("cap", "weight", "rank", (F.col("_budget") - (F.col("cap_upto") - F.col("cap"))).alias("left"), ((F.col("_weights") - (F.col("milli_upto") - F.col("milli"))) / 1000).alias("open"))
    fits = full.where(F.col("left") / F.col("open") * F.col("weight") <= F.col("cap"))
    level = fits.agg(F.min_by(F.col("left") / F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank")).alias("_level"))  # one row
    target = F.least(F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return written(numbered.crossJoin(F.broadcast(level)).select("source", "rank", "source_size", target.alias("target")), "targets")


def mix_schedule(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, part_words: int = 256, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, parts): documents (row, doc_id, size, source_size, target), and the parts that the mix takes, in its order.

    A part is (row, epoch, start, length, finish, position): ``length`` words of the row's text from word ``start``, served at
    ``position`` words into the mix.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    targets = source_targets(sized, weights, share, most)
    few = targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    known = targets.withColumnRenamed("source", "_s")
    base = sized.join(F.broadcast(known) if few else known, sized.source.eqNullSafe(F.col("_s"))).select("row", "doc_id", "size", "rank", "source_size", "target")
    base = written(base, "weighed")
    budget = base.groupBy().agg(F.sum("size").alias("_total")).select(F.floor(F.col("_total") * F.lit(float(share))).alias("_budget"))  # one row
    served = base.where("size > 0").select("row", "doc_id", "size", "rank", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    queued = running_sums(served, "rank", ["epoch", shuffled, "size", "row"], ["size"], ["row", "epoch", "target"])
    parts = queued.select("row", "rank", "epoch", "target", "size", (F.col("size_upto") - F.col("size")).alias("before"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / part_words))).alias("k"))
    parts = parts.select("row", "rank", "epoch", "target", "before", (F.col("k") * part_words).alias("start"), F.least(F.lit(part_words), F.col("size") - F.col("k") * part_words).cast("long").alias("length"))
    parts = parts.withColumns({"finish": (F.col("before") + F.col("start") + F.col("length")) / F.col("target"), "_all": F.lit(0).cast("long")})
    line = running_sums(parts, "_all", ["finish", "rank", (F.col("before") + F.col("start"))], ["length"], ["row", "epoch", "start", "finish"])
    line = line.crossJoin(F.broadcast(budget)).withColumn("position", F.col("length_upto") - F.col("length")).where("position < _budget")
    return base, line.select("row", "epoch", "start", F.least("length", F.col("_budget") - F.col("position")).alias("length"), "finish", "position")


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted."""
    base, parts = mix_schedule(docs, **options)
    taken = parts.groupBy("row").agg(F.sum("length").alias("taken"))
    joined = base.join(taken.hint("merge"), "row", "left")  # merged at every size, as both grow with the documents
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle_sql(weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, part_words: int = 256, seed: str = "mix") -> str:
    """The same for DuckDB, over the view ``documents``."""
    return rf"""
WITH sized AS (SELECT row_number() OVER () AS row, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, weights))}][CAST((rank - 1) % {len(weights)} AS INT) + 1] AS weight, source_size * {most} AS cap FROM sources),
filled AS (SELECT *, (SELECT sum(size) * {share}::DOUBLE FROM sized) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open, row_number() OVER w AS k FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank)),
level AS (SELECT min_by(left_over / open, k) AS level FROM filled WHERE left_over / open * weight <= cap),
targets AS (SELECT source, rank, source_size, least(coalesce(level * weight, cap), cap::DOUBLE) AS target FROM weighed, level),
base AS (SELECT row, doc_id, size, rank, source_size, target FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
queued AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY epoch, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), size, row) - size AS before FROM base, range({most}) t(epoch) WHERE size > 0),
parts AS (SELECT row, rank, before, k * {part_words} AS start, least({part_words}, size - k * {part_words}) AS length, target FROM queued, LATERAL (SELECT unnest(range((size - 1) // {part_words} + 1)) AS k)),
line AS (SELECT *, sum(length) OVER (ORDER BY (before + start + length)::DOUBLE / target, rank, before + start) - length AS position FROM parts),
taken AS (SELECT row, sum(least(length, (SELECT floor(sum(size) * {share}::DOUBLE) FROM sized) - position)) AS taken FROM line WHERE position < (SELECT floor(sum(size) * {share}::DOUBLE) FROM sized) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM base LEFT JOIN taken USING (row)
"""
