"""Registered queries of reports, panels, tests and judge items, over the derived fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as t
from ..operators import pairing, reports, stats, structural
from .catalog import EDGE, Query, body, files, judgments, manifest, marked, pairs_of, rounded, scored, wide

QUERIES: dict[str, Query] = {}
#: Fields that the fixture's judgments lack, as SQL text that Spark and DuckDB both run.
MORE_FIELDS = {
    "planning_depth": "CASE WHEN ccr_closure IS NOT NULL THEN doc_id % 4 END",
    "plan_execution_consistency": "CASE WHEN ccr_closure IS NOT NULL AND doc_id % 6 <> 0 THEN doc_id % 3 END",
    "divergent_score": "CASE WHEN ccr_closure IS NOT NULL THEN (doc_id + k) % 5 END",
    "creative_destruction": "CASE WHEN ccr_closure IS NOT NULL THEN CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END END",
    "verification_independence": "CASE WHEN ccr_closure IS NOT NULL THEN (doc_id + ccr_closure) % 3 END",
}
DISPLAY = ("qwen", "glm", "kimi", "claude47_ti", "deepseek", "gemini", "claude46_ti")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def full(spark: SparkSession, sf_dir: str, judge: str | None = "a") -> DataFrame:
    """Judgments with all fields, density, length and a teacher."""
    traces = body(spark, sf_dir).select("doc_id", F.col("domain").alias("teacher"), "reasoning_chars", t.density("reasoning", lx.DENSITY_B).alias("density"))
    return judgments(spark, sf_dir, judge).join(traces, "doc_id").withColumns({k: F.expr(e) for k, e in MORE_FIELDS.items()})


@query
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.dataset_report(full(spark, sf_dir), "doc_id"))


@query
def legacy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.legacy_report(full(spark, sf_dir, "b")))


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.run_report(full(spark, sf_dir, None), ["ccr_closure", "causal_depth_of_critique"], "judge"))


@query
def teacher_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.teacher_means(full(spark, sf_dir), "teacher")


@query
def model_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = t.split_generated("output")[2]
    rows = marked(spark, sf_dir, (*EDGE, "action")).select("dataset", closed.alias("closed"), structural.action_bigrams()[0].alias("entropy"), structural.topology()[0].alias("edge_density"), (t.count_matches("reasoning", lx.OVERTHROW) > 0).alias("overthrown"))
    return rounded(reports.model_read(rows))


@query
def effect_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.effect_rates(full(spark, sf_dir), ["dataset"], 2000))


@query
def three_way_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which two judges scored every item; of the first one's files every third lacks a score."""
    items, a = files(spark, sf_dir)
    _, b = files(spark, sf_dir, "b", whole=True)
    return pairing.panel(items, {"a": a, "b": b}, strict=True).select("file", "pos", "doc_id", "a", "b")


@query
def panel_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, a = files(spark, sf_dir)
    others = {j: files(spark, sf_dir, j, whole=True)[1] for j in ("b", "c")}
    return pairing.panel(items, {"a": a} | others).select("file", "pos", "doc_id", "dataset", "a", "b", "c")


@query
def metric_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace with the last of its judges' scores."""
    metrics = body(spark, sf_dir).select("doc_id", "dataset", "uid", "reasoning_chars")
    return reports.with_score(metrics, judgments(spark, sf_dir, None), "judge")


@query
def calibration_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.calibration(judgments(spark, sf_dir, "a"), judgments(spark, sf_dir, "b"), "doc_id", ["uid"]))


@query
def verify_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, first = files(spark, sf_dir)
    _, second = files(spark, sf_dir, "c", whole=True)
    return rounded(reports.verify_consistency(second, first))


@query
def batch_all_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = files(spark, sf_dir)
    return pairing.judged_files(items, files(spark, sf_dir, "b", whole=True)[1])


@query
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.paired_report(pairs_of(full(spark, sf_dir), ["ccr_closure", "density", "monitoring_control_coupling", "reasoning_topology"])))


@query
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = judgments(spark, sf_dir).where("ccr_closure is not null").groupBy("dataset").agg(F.avg("ccr_closure").alias("ccr_mean"))
    return rounded(reports.in_display_order(means, DISPLAY))


@query
def judge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the paired round and of the other datasets."""
    traces = body(spark, sf_dir).withColumns({"teacher": F.lit("?"), "answer": F.col("output")})
    of = lambda name: pairing.one_of(traces.where(F.col("dataset") == name), ["uid"], F.desc("doc_id"))
    pairs = pairing.one_of(manifest(spark, sf_dir), ["ds_id"], F.col("probe_pos"))
    out = pairing.paired_and_standalone(pairs, of("deepseek"), of("glm"), traces.where("dataset not in ('deepseek', 'glm')"), 2400)
    digest = lambda c: F.sha1(F.col(c).cast("binary")).alias(c)
    return out.select("job", "dataset", "uid", "pair_ds", "pair_glm", "reasoning_chars", digest("problem"), digest("reasoning"), digest("answer"))


@query
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"single": t.judge_prompt("problem", "reasoning", "output", 2400)} | {w: t.batch_prompt("problem", "reasoning", "output", w) for w in ("batch", "panel")}
    return body(spark, sf_dir).select("doc_id", *(F.sha1(c.cast("binary")).alias(k) for k, c in made.items()))


@query
def last_trace_of_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last trace of every id of the pair manifest, over all datasets."""
    wanted = manifest(spark, sf_dir).select(F.explode(F.array("ds_id", "glm_id")).alias("uid"))
    return pairing.lookup(body(spark, sf_dir), wanted, last="doc_id").select("uid", "doc_id", "dataset")


@query
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir, None).where("dataset in ('glm', 'deepseek')")
    return rounded(stats.mann_whitney(rows, "ccr_closure", F.col("dataset") == "glm", ["judge"]))


@query
def chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.chi_squared(judgments(spark, sf_dir), "dataset", "reasoning_topology"))


@query
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = wide(spark, sf_dir).select("dataset", (F.col("a") >= 2).cast("int").alias("x"), (F.col("b") >= 2).cast("int").alias("y"))
    return rounded(stats.mcnemar(both, "x", "y", ["dataset"]))


@query
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full(spark, sf_dir).groupBy("dataset").agg(*(c.alias(k) for f in ("ccr_closure", "density") for k, c in stats.quartiles(f).items())))


@query
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cohen_kappa(wide(spark, sf_dir), "a", "b", ["dataset"]))


@query
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bootstrap_mean(judgments(spark, sf_dir), "ccr_closure", "doc_id", ["dataset"], rounds=50))


@query
def wilcoxon_p_negative_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs_of(scored(spark, sf_dir), ["ccr_closure"]).select((F.col("ccr_closure_b") - F.col("ccr_closure_a")).alias("d"))
    return rounded(stats.signed_rank(d, "d", ties="negative_first").withColumn("p", stats.two_sided_p("z")).select("n_nonzero", "z", "p"))


@query
def ranked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every trace within its dataset by length."""
    rows = body(spark, sf_dir).select("dataset", "reasoning_chars", "doc_id")
    return stats.places(rows, ["dataset"], ["reasoning_chars", "doc_id"], "place").select("doc_id", "place")
