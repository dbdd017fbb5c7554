"""Models on MLlib: clusters, forests with group bootstrap, grid search and prediction of cell tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import columns as C
from tidegrid.operators.tables import dense_ids, group_kfold, small_or_shuffled
from tidegrid.session import written

#: Blocks of groups that a fold's rows with equal features are laid together in: what a forest's bootstrap draws.
BLOCKS = 64


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with the column ``features``; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def spatial_kmeans(df: DataFrame, coordinates: Sequence[str], k: int = 20, seed: int = 1) -> DataFrame:
    """``df`` with the column cluster."""
    v = vectors(df, coordinates)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).drop("features")


def bootstrap_draws(df: DataFrame, group: str, trees: int, seed: int = 1) -> DataFrame:
    """(group, draws): how often each group is drawn for each tree, as an array over the trees.

    For every tree, as many groups are drawn with replacement as there are: draw k of tree t takes the group at the place that a
    hash of (seed, t, k) gives, among the groups in order. So each tree's draws add up to the number of groups, and are repeatable.
    """
    numbered = written(dense_ids(df.where(F.col(group).isNotNull()), [group], "_id"), "groups")
    size = numbered.agg(F.count("*").alias("_n"))  # one row
    drawn = numbered.crossJoin(F.broadcast(size)).select("_id", "_n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_t"))
    drawn = drawn.select("_t", (F.pmod(F.xxhash64(F.lit(seed), "_t", "_id"), F.col("_n")) + 1).alias("_id")).groupBy("_id", "_t").agg(F.count("*").alias("_k"))
    held = drawn.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_t", F.col("_k").cast("double")))).alias("_m"))  # one entry per tree at most
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), trees)
    return numbered.join(held, "_id", "left").select(group, F.when(F.col("_m").isNull(), none).otherwise(every).alias("draws"))


def fitted_trees(rows: DataFrame, trees: int, depth: int, seed: int = 1, parallelism: int = 4) -> list[DecisionTreeRegressionModel]:
    """A tree per entry of the arrays ``draws`` (weights) and ``label`` of ``rows`` (features, draws, label). Some trees are fitted at once."""

    def fit(k: int) -> DecisionTreeRegressionModel:
        one = rows.select(F.col("label")[k].alias("label"), "features", F.col("draws")[k].alias("weight")).where("weight > 0")
        return DecisionTreeRegressor(maxDepth=depth, seed=seed + k, weightCol="weight").fit(one)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(trees)))


def mean_prediction(models: Sequence, rows: DataFrame, name: str, keep: Sequence[str], among: Column | None = None, counted_as: str | None = None, at_once: int = 20) -> DataFrame:
    """``rows`` (with features) as ``keep``, the mean of the models' predictions, and (if asked for) the number of models in it.

    ``among``: an array of marks per row; only models with a mark count, and the mean of none is NULL. Models are asked one after the
    other in the task that reads a row, some at a time with sums written in between: no rows are shuffled.
    """
    now = rows.select(*keep, "features", (F.array_repeat(F.lit(True), len(models)) if among is None else among).alias("_among"), F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_n"))
    for a in range(0, len(models), at_once):
        some = models[a : a + at_once]
        for k, m in enumerate(some):
            now = m.copy().setPredictionCol(f"_p{k}").transform(now)
        given = [F.when(F.col("_among")[a + k], F.col(f"_p{k}")).otherwise(0.0) for k in range(len(some))]
        marks = [F.col("_among")[a + k].cast("long") for k in range(len(some))]
        now = now.select(*keep, "features", "_among", sum(given, F.col("_sum")).alias("_sum"), sum(marks, F.col("_n")).alias("_n"))
        if a + at_once < len(models):
            now = written(now, "predicted")
    return now.select(*keep, C.ratio("_sum", "_n").alias(name), *([F.col("_n").alias(counted_as)] if counted_as else []))


def given(df: DataFrame, features: Sequence[str]) -> Column:
    """Whether all features are given: neither NULL nor NaN."""
    return reduce(and_, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])


def train_forest(df: DataFrame, features: Sequence[str], target: str, group: str, trees: int = 20, depth: int = 6, seed: int = 1, least: int = 5) -> tuple[list[DecisionTreeRegressionModel], DataFrame]:
    """Trees on bootstrap draws of whole groups, and (group, n, n_scored, oob, r) of every group.

    A row's out-of-bag prediction is the mean over the trees for which its group wasn't drawn. Per group: rows, rows with such a
    prediction, their mean squared error, and Pearson's r of label and prediction where more than ``least`` rows have one.

    Rows with equal features always share a leaf, so each tree is fitted on the weight and the weighted mean label of every
    different vector of features, from one pass for all trees; each vector is predicted once, and the rows find their predictions.
    """
    names = [f"_f{i}" for i in range(len(features))]
    v = df.where(given(df, features)).select(group, F.col(target).cast("double").alias("label"), *[(F.col(f).cast("double") + 0.0).alias(n) for f, n in zip(features, names)]).where("label is not null")  # + 0.0: no -0.0
    drawn = written(bootstrap_draws(v, group, trees, seed), "draws")
    k = lambda t: F.col("draws")[t]
    sums = [c for t in range(trees) for c in (F.sum(k(t)).alias(f"_w{t}"), F.sum(k(t) * F.col("label")).alias(f"_y{t}"))]
    cells = v.join(small_or_shuffled(drawn), group).groupBy(*names).agg(*sums)
    each = F.array(*[F.struct(F.col(f"_w{t}").alias("weight"), F.col(f"_y{t}").alias("y")) for t in range(trees)])
    cells = written(vectors(cells, names).select(*names, "features", each.alias("trees")), "cells")
    models = fitted_trees(cells.select("features", F.transform("trees", lambda s: s["weight"]).alias("draws"), F.transform("trees", lambda s: C.ratio(s["y"], s["weight"])).alias("label")), trees, depth, seed)
    asked = cells
    for t, m in enumerate(models):
        asked = m.copy().setPredictionCol(f"_p{t}").transform(asked)
    asked = written(asked.select(*names, F.array(*[f"_p{t}" for t in range(trees)]).alias("_p")), "asked")
    held = v.join(small_or_shuffled(asked), names).join(small_or_shuffled(drawn), group)
    unseen = held.select(group, "label", C.ratio(sum(F.when(k(t) == 0, F.col("_p")[t]).otherwise(0.0) for t in range(trees)), sum((k(t) == 0).cast("long") for t in range(trees))).alias("p"))
    e = (F.col("p") - F.col("label")) ** 2
    found = unseen.groupBy(group).agg(F.count("*").alias("n"), F.count("p").alias("n_scored"), F.avg(e).alias("oob"), C.corr("label", "p").alias("r"))
    return models, found.withColumn("r", F.when(F.col("n_scored") > least, F.col("r")))


def forest_per_target(df: DataFrame, features: Sequence[str], targets: Sequence[str], group: str, trees: int = 10, depth: int = 6, seed: int = 1) -> tuple[dict[str, list[DecisionTreeRegressionModel]], DataFrame, DataFrame]:
    """Forests of each target (as the quantiles of a month) on the same draws, (target, feature, importance) as means over trees, and (target, group, n, n_scored, oob, r)."""
    models, weights, scored = {}, [], None
    for t in targets:
        models[t], oob = train_forest(df, features, t, group, trees, depth, seed)
        each = [m.featureImportances for m in models[t] if m.numNodes > 1]
        weights += [(t, f, float(sum(w[i] for w in each) / max(len(each), 1))) for i, f in enumerate(features)]
        oob = oob.select(F.lit(t).alias("target"), "*")
        scored = oob if scored is None else scored.unionByName(oob)
    return models, df.sparkSession.createDataFrame(weights, "target string, feature string, importance double"), scored


class ErrorOfCells(Evaluator):
    """Root mean squared error of all rows behind cells (label: their mean, weight: their number, spread: their squared differences from it)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        off = (F.col("prediction") - F.col("label")) ** 2 * F.col("weight") + F.col("spread")
        return dataset.select(F.sqrt(F.sum(off) / F.sum("weight"))).first()[0]

    def isLargerBetter(self) -> bool:
        return False


def grid_search_forest(df: DataFrame, features: Sequence[str], target: str, group: str, depths: Sequence[int] = (3, 5), trees: Sequence[int] = (5, 10), subsets: Sequence[int] = (), folds: int = 3) -> CrossValidatorModel:
    """Cross-validation by whole groups over depths, numbers of trees and (if given) numbers of features tried at a split.

    Rows of a fold with equal features are laid together in up to ``BLOCKS`` blocks of whole groups, as one row that weighs as much; a
    tree's bootstrap draws such blocks. The error is that of all rows: what their labels differ inside a block is added.
    """
    names = [f"_f{i}" for i in range(len(features))]
    v = group_kfold(df.where(given(df, features)), group, folds).where(F.col(target).isNotNull())
    v = v.select(F.col("fold").cast("int").alias("fold"), F.pmod(F.xxhash64(group), F.lit(BLOCKS)).alias("_block"), F.col(target).cast("double").alias("label"), *[(F.col(f).cast("double") + 0.0).alias(n) for f, n in zip(features, names)])
    cells = v.groupBy("fold", "_block", *names).agg(F.count("*").cast("double").alias("weight"), F.avg("label").alias("_mean"), (F.var_pop("label") * F.count("*")).alias("spread"))
    cells = written(vectors(cells, names).select("fold", "features", "weight", F.col("_mean").alias("label"), "spread"), "cells")
    forest = RandomForestRegressor(seed=1, weightCol="weight")
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees))
    grid = (grid.addGrid(forest.featureSubsetStrategy, [str(k) for k in subsets]) if subsets else grid).build()
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=ErrorOfCells(), numFolds=folds, foldCol="fold").fit(cells)


def predict_table(models: Sequence, cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """``cells`` with prediction: the mean over the models, not below 0. Rows with a missing feature are left out."""
    found = mean_prediction(models, vectors(cells, features), "prediction", cells.columns)
    return found.select(*cells.columns, F.greatest("prediction", F.lit(0.0)).alias("prediction"))
