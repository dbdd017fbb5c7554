"""Resumable ingest: new files of daily values bring the months they touch up to date.

The state is one set of raw rows and one of quantiles per month, and an index that says which batch wrote a month last. A batch
reads the months it touches, writes them anew with its own rows, and then the index; what no index refers to any more goes.
So a batch costs what its months hold, and reading the result costs its months, however many batches there were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.aggregates import monthly_quantiles


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it isn't there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _indexes(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose index is complete, in order."""
    return sorted(int(n.removeprefix("batch=")) for n in _folders(spark, f"{target}/index") if n.startswith("batch=") and _has(spark, f"{target}/index/{n}/_SUCCESS"))


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _index(spark: SparkSession, target: str, batch: int) -> dict[int, int]:
    """Month (years times twelve, plus month) to the batch that wrote it last: one entry per month of the data."""
    return {r.ym: r.batch for r in spark.read.parquet(f"{target}/index/batch={batch}").collect()}


def _months(spark: SparkSession, target: str, kind: str, of: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/{kind}/batch={b}/ym={m}" for m, b in sorted(of.items())]
    return spark.read.parquet(*paths) if paths else None


def incremental_quantiles(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, station: str = "station", date: str = "date", value: str = "value") -> None:
    """Process the files of ``source`` that no earlier call has seen; ``target`` holds raw rows by month and their quantiles.

    A file stream with availableNow remembers the files in its checkpoint. A batch that is repeated after a failure finds the
    state as it was before it, as nothing that its predecessor's index refers to is removed before the batch after it. Rows without
    a date are left out.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        earlier = [n for n in _indexes(spark, target) if n < number]
        known = _index(spark, target, earlier[-1]) if earlier else {}
        rows = batch.where(F.col(date).isNotNull()).withColumn("ym", (F.year(date) * 12 + F.month(date)).cast("long"))
        fresh = f"{target}/fresh/batch={number}"
        rows.write.mode("overwrite").parquet(fresh)  # read once, whatever the source does
        new = spark.read.schema(rows.schema).parquet(fresh)
        touched = sorted(r.ym for r in new.select("ym").distinct().collect())  # as many as the batch has months
        old = _months(spark, target, "raw", {m: known[m] for m in touched if m in known})
        every = new if old is None else new.unionByName(old.withColumn("ym", (F.year(date) * 12 + F.month(date)).cast("long")))
        every.write.mode("overwrite").partitionBy("ym").parquet(f"{target}/raw/batch={number}")
        if touched:
            whole = _months(spark, target, "raw", dict.fromkeys(touched, number))
            found = monthly_quantiles(whole, station, date, value).withColumn("ym", (F.col("yyyy") * 12 + F.col("mm")).cast("long"))
            seen = spark.createDataFrame([(m,) for m in touched], "ym long")  # a month without a value has a folder too
            seen.join(found, "ym", "left").write.mode("overwrite").partitionBy("ym").parquet(f"{target}/quantiles/batch={number}")
        now = known | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "ym long, batch long").coalesce(1).write.mode("overwrite").parquet(f"{target}/index/batch={number}")
        _remove(spark, fresh)
        _sweep(spark, target, now, known, {number, *earlier[-1:]})

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"quantiles-{uuid.uuid4().hex}").start()
    query.awaitTermination()


def _sweep(spark: SparkSession, target: str, now: dict[int, int], before: dict[int, int], indexes: set[int]) -> None:
    """Remove months that neither of the two last indexes refers to, and older indexes."""
    used = {(b, m) for index in (now, before) for m, b in index.items()}
    for kind in ("raw", "quantiles"):
        for folder in _folders(spark, f"{target}/{kind}"):
            batch = int(folder.removeprefix("batch="))
            held = [int(n.removeprefix("ym=")) for n in _folders(spark, f"{target}/{kind}/{folder}") if n.startswith("ym=")]
            for m in held:
                if (batch, m) not in used:
                    _remove(spark, f"{target}/{kind}/{folder}/ym={m}")
            if not any((batch, m) in used for m in held):
                _remove(spark, f"{target}/{kind}/{folder}")
    for folder in _folders(spark, f"{target}/index"):
        if int(folder.removeprefix("batch=")) not in indexes:
            _remove(spark, f"{target}/index/{folder}")


def current_quantiles(spark: SparkSession, target: str, station: str = "station") -> DataFrame:
    """The quantiles of every month as the last complete batch left them."""
    found = _indexes(spark, target)
    if not found:
        raise ValueError("no batch has been completed")
    return _months(spark, target, "quantiles", _index(spark, target, found[-1])).where(F.col("yyyy").isNotNull())
