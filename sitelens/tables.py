"""Reading tables, the rows that count in them, and bounded lists of a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str = "ingested_at") -> DataFrame:
    """The row with the latest ``stamp`` of each ``key``.

    Rows without a key are dropped; a null stamp loses to any other. Rows
    that tie on the stamp are told apart by a hash of their content, so that
    the choice does not depend on the partitioning. Select the columns needed
    before: all columns of ``df`` are read and shuffled. The row_number filter
    is planned as a group limit, which drops older rows before the shuffle.
    """
    if stamp not in df.columns:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key])
    hashable = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    rank = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.xxhash64(*hashable))
    return df.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


#: Most entries of a list that is shown with a group; the group's size is always counted in full.
LISTED = 1000


def first_listed(df: DataFrame, by: list[str], order: list[str], value: str, name: str, most: int = LISTED) -> DataFrame:
    """(by, name): the first ``most`` values of each group in order.

    The limit is planned as a group limit before the shuffle, so no task ever
    holds more than ``most`` rows of a group, however large it is.
    """
    rank = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= most)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("r"), F.col(value).alias("v"))))
    return first.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


#: Rows of a group that are numbered in one task.
CHUNK = 100_000


def numbered(df: DataFrame, by: list[str], order: str, tie: str | Column, name: str = "ord") -> DataFrame:
    """``df`` with the position of each row in its group of ``by``, from 0, in the order of ``order`` (a whole number) and ``tie``.

    A group is cut into ranges of ``order``: the ranges are counted first and
    their sums carried on, so no task numbers a whole group. Rows of null ``order`` come first. A range
    holds all rows of one ``order``.
    """
    at = F.floor(F.coalesce(F.col(order), F.lit(-1)) / CHUNK)
    cut = df.withColumn("__chunk", at)
    sizes = cut.groupBy(*by, "__chunk").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__chunk")) - F.col("__n")).drop("__n")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__chunk"]]
    both = cut.alias("l").join(before.alias("r"), same).select("l.*", "r.__before")
    inside = F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(F.col(order).asc_nulls_first(), tie)) - 1
    return both.withColumn(name, (F.col("__before") + inside).cast("bigint")).drop("__before", "__chunk")
