"""Times the headline queries; prints one JSON line. Every result is written out in full by the noop sink."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracemill.plans.registry import QUERIES  # noqa: E402
from tracemill.session import build_session  # noqa: E402
from tracemill.sources.layouts import index_by_uid  # noqa: E402

HEADLINE = (
    "rt_density_by_dataset", "all_metrics_by_dataset", "pdd", "rae", "ccs_exact", "pagerank_ici", "ce", "oed",
    "summary_by_dataset", "paired_summary", "wilcoxon_a", "cliffs_delta", "panel_matrix", "pearson_metric_ccr",
    "metric_dataset_rank", "pair_manifest", "positional_join", "resume_todo", "eligible_sample", "dataset_report", "panel_left_join",
    "spearman_ordinal", "batches_of_five", "judge_items",
)


def index_rate(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    """Seconds to index all texts by an id in Parquet with bloom filters, and MB of text a second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat('d', doc_id) AS uid", "text")
    size = docs.selectExpr("sum(octet_length(text))").first()[0] / 1e6
    with tempfile.TemporaryDirectory() as folder:
        began = time.time()
        index_by_uid(docs, f"{folder}/index", int(spark.conf.get("spark.sql.shuffle.partitions")))
        seconds = time.time() - began
    return round(seconds, 3), round(size / seconds, 1)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark__driver__memory": "8g", "spark__ui__enabled": "false", "spark__sql__shuffle__partitions": cpus, "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: QUERIES[n] for n in HEADLINE}
    try:
        from tracemill.llm import queries as llm

        queries |= llm.queries()
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("tracemill.llm"):
            raise
    only = set(sys.argv[1:])
    seconds = {}
    # one untimed query, so that none of the others carries the warm-up
    QUERIES["rt_density_by_dataset"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name, run in queries.items():
        if only and name not in only:
            continue
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    more = {}
    if not only or "index_by_uid" in only:
        seconds["index_by_uid"], more["index_mb_per_second"] = index_rate(spark, sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), **more}))


if __name__ == "__main__":
    main()
