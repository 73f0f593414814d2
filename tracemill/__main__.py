"""Command line: ingest, metrics, reports, pairing, sampling, batches and judging over folders of records.

    python -m tracemill traces  --dataset glm --path data/glm --out traces
    python -m tracemill metrics --traces traces --out metrics
    python -m tracemill index   --traces traces --out index --files 8
    python -m tracemill pair    --small a --large b --out pairs
    python -m tracemill sample  --traces traces --n 100 --out sample
    python -m tracemill batches --traces sample --out batches
    python -m tracemill judge   --traces sample --done judged --out judged --backend mock
    python -m tracemill report  --judged judged --out report
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import judging, pairing, reports, sampling, structural
from .session import build_session, ship
from .sources import layouts

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], Sequence[str]]] = {}


def command(*options: str) -> Callable:
    def put(f: Callable[[SparkSession, argparse.Namespace], None]) -> Callable[[SparkSession, argparse.Namespace], None]:
        COMMANDS[f.__name__] = (f, options)
        return f

    return put


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


@command("dataset", "path", "out", "only?", "limit?")
def traces(spark: SparkSession, a: argparse.Namespace) -> None:
    only = a.only.split(",") if a.only else None
    save(layouts.read_traces(spark, a.path, a.dataset, only, int(a.limit) if a.limit else None), a.out)


@command("traces", "out")
def metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    found = structural.all_metrics(spark.read.parquet(a.traces))
    save(found.select("dataset", "uid", "reasoning_chars", *structural.METRICS), a.out)


@command("traces", "out", "files")
def index(spark: SparkSession, a: argparse.Namespace) -> None:
    layouts.index_by_uid(spark.read.parquet(a.traces), a.out, int(a.files))


@command("small", "large", "out")
def pair(spark: SparkSession, a: argparse.Namespace) -> None:
    small, large = (spark.read.parquet(p) for p in (a.small, a.large))
    save(pairing.pair_manifest(small, large, "uid"), a.out)


@command("traces", "n", "out")
def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    found = sampling.eligible(spark.read.parquet(a.traces), ["uid"])
    save(sampling.sample(found, int(a.n)), a.out)


@command("traces", "out")
def batches(spark: SparkSession, a: argparse.Namespace) -> None:
    layouts.write_batches(sampling.batches(pairing.judge_items(spark.read.parquet(a.traces)), ["uid"]), a.out)


@command("traces", "out", "backend?", "done?")
def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    todo = spark.read.parquet(a.traces)
    if a.done:
        done = spark.read.schema("dataset string, uid string, status string").option("ignoreMissingFiles", True).json(a.done)
        todo = pairing.resume_todo(todo, done)
    layouts.append_log(judging.judge(todo, a.backend or "mock"), a.out)


@command("judged", "out")
def report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.schema("dataset string, uid string, status string, ccr_closure int, reasoning_topology string").json(a.judged)
    counts = rows.groupBy("dataset").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("judged", "error")), F.avg("ccr_closure").alias("ccr_mean"), F.median("ccr_closure").alias("ccr_median"))
    layouts.write_report(counts.join(reports.commonest(rows, "dataset", "reasoning_topology"), "dataset", "left"), a.out)


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser("tracemill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
    a = parser.parse_args(args)
    COMMANDS[a.command][0](ship(build_session(f"tracemill {a.command}")), a)


if __name__ == "__main__":
    main(sys.argv[1:])
