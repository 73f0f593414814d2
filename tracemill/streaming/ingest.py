"""Incremental ingest and pairing of record files.

A streaming file source remembers in its checkpoint which files it has read; each batch is
parsed, matched with the small side's problems and appended. Reruns take up where they ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_problem, problem_hash
from ..operators.pairing import one_of
from ..sources.layouts import as_traces


def trace_stream(spark: SparkSession, path: str, dataset: str, files_per_batch: int = 100) -> DataFrame:
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).text(path)
    records = lines.select(F.try_parse_json("value").alias("record"), F.col("_metadata.file_path").alias("src_file")).where("record is not null")
    return as_traces(records, dataset)


def pair_stream(traces: DataFrame, small: DataFrame, order: str) -> DataFrame:
    """Stream-static join on the problem hash."""
    build = small.withColumn("problem_hash", problem_hash("problem")).where(normalize_problem("problem") != "")
    build = one_of(build, ["problem_hash"], F.desc(order)).select("problem_hash", F.col("uid").alias("ds_id"))
    keyed = traces.withColumn("problem_hash", problem_hash("problem")).where(normalize_problem("problem") != "")
    return keyed.join(build, "problem_hash").select(F.col("problem_hash").alias("ds_hash"), "ds_id", F.col("uid").alias("glm_id"), "domain", "src_file")


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Work off all files that are there, append the rows to ``out`` as Parquet, and end."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def dedup_stream(traces: DataFrame) -> DataFrame:
    """One trace for each (dataset, uid) over all batches."""
    return traces.dropDuplicates(["dataset", "uid"])
