"""Eligibility, sampling and batching of traces.

Sampling sorts by a hash of the id instead of drawing row by row, so it gives the same
rows at any partitioning and rank limits are applied before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import places


def hash_order(c: str = "uid", seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.col(c).cast("string"), F.lit(seed)).cast("binary"))


def eligible(df: DataFrame, order: Sequence[str], min_chars: int = 200, scan_limit: int | None = None) -> DataFrame:
    """The first row of each (dataset, uid) in ``order`` with enough reasoning, among the first ``scan_limit`` scanned rows of a dataset.

    The limit is found on keys alone; a rank limit keeps ``scan_limit`` rows of each task and dataset.
    """
    if scan_limit is not None:
        w = Window.partitionBy("dataset").orderBy(*order)
        first = df.select("dataset", *order).withColumn("__scan", F.row_number().over(w)).where(F.col("__scan") <= scan_limit).drop("__scan")
        df = df.join(first, ["dataset", *order], "left_semi")
    w = Window.partitionBy("dataset", "uid").orderBy(*order)
    return df.where(F.col("reasoning_chars") >= min_chars).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sample(df: DataFrame, n: int, by: Sequence[str] = ("dataset",), key: str = "uid", seed: int = 42) -> DataFrame:
    """``n`` rows of each group, those with the least hashes."""
    w = Window.partitionBy(*by).orderBy(hash_order(key, seed), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def stratified(df: DataFrame, n: int, stratum: str = "domain", key: str = "uid", seed: int = 42) -> DataFrame:
    """``n`` rows, dealt over strata in proportion, one at least of each; trimmed, or filled from the rest, to ``n``. ``key`` names a row."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c")).first()[0] or 1
    quota = sizes.select(F.col(stratum).alias("__s"), F.least(F.col("__c"), F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.col("__c") / F.lit(total)))).cast("int").alias("__quota"))
    # No stratum gives more than n rows, so a rank limit on keys leaves n of each before anything else moves.
    w = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    keys = df.select(stratum, key).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    picked = keys.join(quota, F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("__extra", F.col("__n") > F.col("__quota"))
    picked = picked.orderBy("__extra", hash_order(key, seed), key).limit(n).select(F.col(key).alias("__key"))
    return df.join(picked, F.col(key) == F.col("__key"), "left_semi")


def length_window(df: DataFrame, low: int, high: int, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` whose reasoning has from ``low`` to ``high`` characters."""
    return df.where(F.col("reasoning_chars").between(low, high)).orderBy(*order).limit(n)


def batches(df: DataFrame, order: Sequence[str], size: int = 5, job: str = "dataset") -> DataFrame:
    """``df`` with batch_id and pos: rows of each job in ``order``, which names a row, ``size`` to a batch.

    Places are found on keys alone and joined back, so texts move once, by their keys.
    """
    keys = places(df.select(job, *order), [job], order, "__place").select(*(F.col(c).alias(f"__k_{c}") for c in (job, *order)), "__place")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (job, *order)))
    placed = df.join(keys, same).drop(*(f"__k_{c}" for c in (job, *order)))
    rn = F.col("__place")
    return placed.withColumns({"batch_id": F.floor(rn / F.lit(size)).cast("int"), "pos": F.pmod(rn, F.lit(size)).cast("int")}).drop("__place")


def manifest(batched: DataFrame, job: str = "dataset") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "uid"))), lambda s: s["uid"])
    return batched.groupBy(job, "batch_id").agg(F.count(F.lit(1)).alias("n"), ordered.alias("uids"))
