"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in spark.checkpoint.dir.

    The cluster names that shared folder. A folder of our own is set only where none
    is named and the master is local, as in tests on one machine; elsewhere that raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracemill-checkpoint-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def inner_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns added on the way."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def id_fold(id_col: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def bounded_sample(df: DataFrame, group: str, order: Column, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of each group, those with the smallest ``order``, a 64-bit hash. For fitting models only.

    Only rows under a cut that leaves about twice as many of each group are ranked, so one
    task gets a few times ``per_group`` rows, whatever the input is. Groups are the classes
    of a model, so their sizes are a small table. Rows without a group are left out; rows should
    differ, as repeated ones count as often as they stand there.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    cut = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(2.0 * per_group + 100) / F.col("__size")) * F.lit(2.0**64)
    some = df.join(F.broadcast(sizes), group).withColumn("__order", order).where(F.col("__order").cast("double") <= cut)
    w = Window.partitionBy(group).orderBy("__order", *(c for c in df.columns if c != group))
    return some.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_group).select(df.columns)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of ``batch`` of about ``max_bytes`` of text; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)
