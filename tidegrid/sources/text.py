"""Readers and writers of the text tables: commented TSV, space-separated tables, metadata headers, features in JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_commented_tsv(spark: SparkSession, path: str, suffix: str, station: str = "site_no", date: str = "datetime") -> DataFrame:
    """(station_id, date, q) of tab-separated files with # comments, a header and a row of types.

    Each file goes by its own header, whatever the order of its columns; a file without one (a later part of a split file)
    goes by the first header of all files. The value column is the first whose name ends with ``suffix``; failing that, the
    first after the date. Values and dates that can't be read are NULL.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), "value").where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    is_head = F.array_contains(cells, station) & F.array_contains(cells, date)
    heads = lines.where(is_head).groupBy("_file").agg(F.min("value").alias("_own"))  # one row per file
    first = heads.agg(F.min_by("_own", "_file").alias("_first"))  # one row
    types = F.forall(cells, lambda x: x.rlike(r"^\d+[snd]$"))
    body = lines.where(~is_head & ~types).join(heads, "_file", "left").crossJoin(F.broadcast(first)).select(cells.alias("c"), F.split(F.coalesce("_own", "_first"), "\t").alias("h"))
    place = lambda name: F.array_position("h", F.lit(name)).cast("int") - 1
    value = F.array_position(F.transform("h", lambda n: n.endswith(suffix)), F.lit(True)).cast("int") - 1
    found = body.select(F.get("c", place(station)).alias("station_id"), F.get("c", place(date)).alias("_d"), F.get("c", F.when(value >= 0, value).otherwise(place(date) + 1)).alias("_q"))
    return found.select("station_id", F.expr("try_cast(_d as date)").alias("date"), F.expr("try_cast(_q as double)").alias("q"))


def read_space_table(spark: SparkSession, path: str, names: Sequence[str], header: bool = True) -> DataFrame:
    """White-space separated columns as strings; a line that repeats the names is the header."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"))
    if header:
        lines = lines.where(F.col("c") != F.array(*map(F.lit, names)))
    return lines.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_metadata_header(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(file, <keys>, line): the body lines of every file with the ``# key: value`` pairs of its own preamble."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    pair = F.regexp_extract("value", r"^#\s*([^:]+?)\s*:", 1)
    text = F.regexp_extract("value", r"^#[^:]*:\s*(.*?)\s*$", 1)
    meta = lines.where(F.col("value").startswith("#")).groupBy("file").agg(*[F.max(F.when(pair == k, text)).alias(k) for k in keys])
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(meta, "file", "left").select("file", *keys, F.col("value").alias("line"))


def read_json_features(df: DataFrame, column: str) -> DataFrame:
    """(id, name, lat, lon) of every feature in a column of feature collections."""
    shape = "struct<features:array<struct<id:string,properties:struct<name:string>,geometry:struct<coordinates:array<double>>>>>"
    one = df.select(F.explode(F.from_json(column, shape)["features"]).alias("f"))
    return one.select("f.id", F.col("f.properties.name").alias("name"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))


def token_width_profile(df: DataFrame, column: str) -> DataFrame:
    """(n_tokens, n_rows): how many tokens rows have."""
    trimmed = F.trim(F.coalesce(F.col(column), F.lit("")))
    return df.select(F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_rows"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], files_each: int = 1, fmt: str = "parquet") -> None:
    """A folder per value of ``by``; rows are dealt by ``by`` and a salt first, so that folders get few files and no task a whole hot one."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_each))
    df.repartition(*by, salt).write.partitionBy(*by).format(fmt).save(path)


def write_fixed_precision(df: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], digits: int, sep: str = " ") -> None:
    """Text lines in key order with a fixed number of decimals."""
    shown = [F.format_string(f"%.{digits}f", F.col(v).cast("double")) for v in values]
    df.orderBy(*keys).select(F.concat_ws(sep, *[F.col(k).cast("string") for k in keys], *shown).alias("value")).write.text(path)
