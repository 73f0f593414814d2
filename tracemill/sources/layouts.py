"""Readers of the six record layouts into one trace schema, and the sinks.

Lines are parsed as variants, so a layout's fields may be missing or vary in type; a line
that isn't JSON is skipped. Missing texts become empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import derived_uid, split_thinking, strip

TRACE = ("dataset", "teacher", "problem", "reasoning", "answer", "domain", "difficulty", "uid", "reasoning_chars")
#: Layout of each dataset (fixed values).
DATASETS = {
    "glm": "output_thinking", "deepseek": "output_thinking", "kimi": "output_thinking", "qwen": "output_thinking",
    "claude46_ti": "trace_inversion", "claude47_ti": "trace_inversion", "gemini": "gemini", "nohurry_opus": "nohurry",
    "angrygiraffe": "messages_think", "roman_claude": "messages_inline",
}
LAYOUTS: dict[str, Callable[[Column], dict[str, Column]]] = {}


def layout(f: Callable[[Column], dict[str, Column]]) -> Callable[[Column], dict[str, Column]]:
    LAYOUTS[f.__name__] = f
    return f


def field(v: Column, path: str, default: str = "") -> Column:
    got = F.try_variant_get(v, f"$.{path}", "string")
    return F.coalesce(F.nullif(got, F.lit("")), F.lit(default))


def first_message(v: Column, role: str) -> Column:
    """Content of the first message of a role, empty if it isn't text."""
    messages = F.try_variant_get(v, "$.messages", "array<struct<role:string,content:variant>>")
    content = F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")), F.lit(""))


@layout
def output_thinking(v: Column) -> dict[str, Column]:
    reasoning, answer = split_thinking(field(v, "output"))
    return {"problem": field(v, "input"), "reasoning": reasoning, "answer": answer, "teacher": field(v, "meta.teacher_model", "?"), "uid": field(v, "id"), "domain": field(v, "domain")}


@layout
def trace_inversion(v: Column) -> dict[str, Column]:
    raw = field(v, "inverted_reasoning")
    reasoning, _ = split_thinking(raw)
    whole = F.when(reasoning == "", strip(raw)).otherwise(reasoning)
    return {"problem": field(v, "input"), "reasoning": whole, "answer": field(v, "output"), "teacher": field(v, "meta.teacher_model", "claude"), "uid": field(v, "id"), "domain": field(v, "domain")}


@layout
def gemini(v: Column) -> dict[str, Column]:
    inner = F.schema_of_variant(F.try_variant_get(v, "$.original_input", "variant")).startswith("OBJECT")
    problem = F.when(inner, field(v, "original_input.text")).otherwise(field(v, "original_input"))
    return {"problem": problem, "reasoning": field(v, "model_thoughts"), "answer": field(v, "model_response"), "teacher": F.lit("gemini"), "uid": derived_uid(problem), "domain": F.when(inner, field(v, "original_input.domain")), "difficulty": F.when(inner, field(v, "original_input.difficulty"))}


@layout
def nohurry(v: Column) -> dict[str, Column]:
    return {"problem": field(v, "problem"), "reasoning": field(v, "thinking"), "answer": field(v, "solution"), "teacher": F.lit("opus"), "uid": field(v, "hash"), "domain": field(v, "category"), "difficulty": field(v, "difficulty")}


@layout
def messages_think(v: Column) -> dict[str, Column]:
    problem = first_message(v, "user")
    reasoning, answer = split_thinking(first_message(v, "assistant"))
    return {"problem": problem, "reasoning": reasoning, "answer": answer, "teacher": field(v, "model", "claude"), "uid": derived_uid(problem), "domain": field(v, "category")}


@layout
def messages_inline(v: Column) -> dict[str, Column]:
    problem, said = first_message(v, "user"), first_message(v, "assistant")
    return {"problem": problem, "reasoning": said, "answer": said, "teacher": field(v, "metadata.model"), "uid": derived_uid(problem), "domain": field(v, "metadata.category"), "difficulty": field(v, "metadata.difficulty")}


def as_traces(records: DataFrame, dataset: str, column: str = "record") -> DataFrame:
    """Traces of a table with a variant column of records in the dataset's layout."""
    got = LAYOUTS[DATASETS[dataset]](F.col(column))
    cols = {c: F.coalesce(got[c], F.lit("")) if c in got else F.lit("") for c in TRACE if c not in ("dataset", "reasoning_chars")}
    df = records.select(F.lit(dataset).alias("dataset"), *(e.alias(c) for c, e in cols.items()), *(c for c in ("src_file", "src_pos") if c in records.columns))
    return df.withColumn("reasoning_chars", F.length("reasoning"))


def read_records(spark: SparkSession, path: str, file_filter: str | list[str] | None = None, strict: bool = False, limit: int | None = None) -> DataFrame:
    """(record variant, src_file, src_pos) of all *.jsonl under ``path``; blank lines are skipped, bad ones skipped or raised.

    src_pos is the byte where the block of a file begins that a task reads, and the line's number in it:
    ordering by (src_file, src_pos) is the order of the file. ``file_filter``: only files whose name
    contains it, or one of them. ``limit``: the first records in that order.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    # a task reads blocks of files one after the other, so the running number orders the lines of each block
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select("value", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_name").alias("__name"), place.alias("src_pos"))
    if file_filter:
        names = [file_filter] if isinstance(file_filter, str) else file_filter
        lines = lines.where(reduce(Column.__or__, (F.contains("__name", F.lit(x)) for x in names)))
    lines = lines.where(F.trim("value") != "")
    record = F.parse_json("value") if strict else F.try_parse_json("value")
    out = lines.select(record.alias("record"), "src_file", "src_pos").where("record is not null")
    return out.orderBy("src_file", "src_pos").limit(limit) if limit is not None else out


def read_traces(spark: SparkSession, path: str, dataset: str, file_filter: str | list[str] | None = None, limit: int | None = None) -> DataFrame:
    return as_traces(read_records(spark, path, file_filter, limit=limit), dataset)


def read_score_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, pos, fields) of files that hold one JSON array each; unreadable files are left out."""
    texts = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    return texts.select("file", F.posexplode(rows).alias("pos", "r")).select("file", "pos", "r.*")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a resumable JSON log."""
    df.write.mode("append").json(path)


def write_batches(batched: DataFrame, path: str, job: str = "dataset") -> None:
    """Batches as JSON lines with batch_id and pos, sorted, one folder for each job; earlier ones are replaced."""
    ranged = batched.repartitionByRange(job, "batch_id").sortWithinPartitions(job, "batch_id", "pos")
    ranged.write.mode("overwrite").partitionBy(job).json(path)


def index_by_uid(df: DataFrame, path: str, files: int) -> None:
    """Traces sorted by uid in Parquet with bloom filters, so that looking up an id reads few row groups."""
    df.repartitionByRange(files, "uid").sortWithinPartitions("uid").write.mode("overwrite").option("parquet.bloom.filter.enabled#uid", "true").parquet(path)


def report_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with each row of a report."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_report(df: DataFrame, path: str) -> None:
    """A report as one file of JSON lines; reports have a row for each dataset or pair of judges, so one task writes them."""
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
