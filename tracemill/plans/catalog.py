"""The registered queries of the engine's own operators, over the derived fixtures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..fixtures import fixture
from ..functions import text as t
from ..operators import judging, pairing, reports, sampling, stats, structural
from ..session import ship
from ..sources import layouts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if k in ("double", "float") or k.startswith("decimal") else F.col(c) for c, k in df.dtypes))


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(ship(spark), sf_dir, "fx_trace").select("doc_id", "k", "dataset", "uid", "domain", "problem", "reasoning", "output", "reasoning_chars")


EDGE = ("causal", "branch", "merge", "backref", "step")


def marked(spark: SparkSession, sf_dir: str, only: Sequence[str] = structural.MARKS) -> DataFrame:
    return structural.with_marks(body(spark, sf_dir), only=only)


def judgments(spark: SparkSession, sf_dir: str, judge: str | None = "a") -> DataFrame:
    df = fixture(spark, sf_dir, "fx_judgment")
    return df.where(F.col("judge") == judge) if judge else df


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge a's scores with critique density and length of the traces."""
    traces = body(spark, sf_dir).select("doc_id", "domain", "reasoning_chars", t.density("reasoning", lx.DENSITY_B).alias("density"))
    return judgments(spark, sf_dir).join(traces, "doc_id")


def metric(name: str, make: Callable[[], Column], only: Sequence[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return marked(spark, sf_dir, only).select("doc_id", r6(make()).alias(name))

    run.__name__ = name
    QUERIES[name] = run


for _name, _make, _only in (
    ("ccs_exact", structural.critique_coupling, ["critique"]), ("pdd", structural.dependency_depth, ["backref", "step"]),
    ("inertia_slope", structural.inertia_slope, ["step"]), ("ear", structural.early_assertion_rate, ["assertion"]),
    ("oed", structural.overthrow_density, ["step"]), ("fsd", structural.format_switch_density, ["format"]),
    ("ce", structural.compression, ["step"]), ("nrr", structural.noise_ratio, ["step"]), ("bsd", structural.branching_sparsity, EDGE),
):
    metric(_name, _make, _only)


@query
def rt_density_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marked(spark, sf_dir, EDGE).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(structural.topology()[0]).alias("rt_density")))


@query
def rt_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r, b = structural.topology()
    return rounded(marked(spark, sf_dir, EDGE).select("doc_id", d.alias("density"), r.alias("branch_merge_ratio"), b.alias("back_ref_depth")))


@query
def rae(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r, top = structural.action_bigrams()
    return rounded(marked(spark, sf_dir, ["action"]).select("doc_id", e.alias("entropy"), r.alias("routinization"), top.alias("dominant_ratio")))


@query
def ci_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = structural.inertia_index(structural.early_assertion_rate(), structural.overthrow_density(), structural.inertia_slope())
    return marked(spark, sf_dir, ["assertion"]).select("doc_id", r6(ci).alias("ci"))


@query
def action_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir, ["action"]).select("dataset", F.explode("marks").alias("m")).groupBy("dataset", F.col("m.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query
def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir, EDGE).select("doc_id", F.explode(structural.edges()).alias("e")).groupBy("doc_id", "e.src", "e.dst").agg(F.count(F.lit(1)).alias("n"))


@query
def pagerank_ici(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structural.concentration(marked(spark, sf_dir, EDGE)).select("doc_id", "ici"))


@query
def ccs_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir, ["critique"]).select("doc_id", r6(structural.critique_coupling_sampled()).alias("ccs"))


@query
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform("paras", lambda p: F.length(p).cast("double"))
    return marked(spark, sf_dir, ["step"]).select("doc_id", r6(structural.gini(lengths)).alias("gini"))


@query
def all_metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = structural.all_metrics(body(spark, sf_dir), digits=None)
    return rounded(m.groupBy("dataset").agg(*(F.avg(c).alias(c) for c in structural.METRICS if c != "ci"), F.avg("ci_exact").alias("ci_exact")))


@query
def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.paragraphs("reasoning")
    return body(spark, sf_dir).select("doc_id", F.size(p).alias("n_paras"), F.length(F.array_join(p, "")).alias("n_chars"), t.count_matches("reasoning", lx.WORD).alias("n_words"), t.count_matches("reasoning", lx.CHUNK).alias("n_chunks"))


@query
def split_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t.split_thinking("output")
    return body(spark, sf_dir).select("doc_id", a.alias("reasoning"), b.alias("answer"))


@query
def split_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = t.split_generated("output")
    return body(spark, sf_dir).select("doc_id", F.length(a).alias("reasoning_chars"), b.alias("answer"), c.alias("closed"))


@query
def problem_norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", t.normalize_problem("problem", False).alias("norm"), t.problem_hash("problem", False).alias("hash"))


@query
def problem_norm_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", t.normalize_problem("problem").alias("norm"), t.problem_hash("problem").alias("hash"))


@query
def derived_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", t.derived_uid("problem").alias("derived"))


@query
def truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = t.head_and_tail("reasoning", 9000)
    return body(spark, sf_dir).select("doc_id", F.length(cut).alias("n_chars"), F.sha1(cut.cast("binary")).alias("sha1"))


@query
def judge_prompt_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", F.length(t.judge_prompt("problem", "reasoning", "output", 2400)).alias("n_chars"))


@query
def critique_density_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", r6(t.density("reasoning", lx.DENSITY_A)).alias("density"))


@query
def critique_density_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", r6(t.density("reasoning", lx.DENSITY_B)).alias("density"))


@query
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(spark, sf_dir).select("doc_id", r6(t.jaccard(t.token_set(F.col("problem")), t.token_set(F.col("output")))).alias("jaccard"), r6(t.log_length(F.col("reasoning_chars"))).alias("log_chars"))


@query
def traces_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    record = F.to_variant_object(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    traces = layouts.as_traces(messages.select("conv_id", record.alias("record")).withColumn("src_pos", F.col("conv_id")), "roman_claude")
    return traces.select(F.col("src_pos").alias("conv_id"), "uid", "problem", F.length("reasoning").alias("reasoning_chars"), F.sha1(F.col("answer").cast("binary")).alias("answer_sha1"))


@query
def layout_output_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_variant_object(F.struct(F.col("uid").alias("id"), F.col("problem").alias("input"), "output", "domain"))
    return layouts.as_traces(body(spark, sf_dir).select(record.alias("record"), F.col("doc_id").alias("src_pos")), "glm").select(F.col("src_pos").alias("doc_id"), "uid", "teacher", "domain", "reasoning_chars", F.length("answer").alias("answer_chars"))


@query
def judge_json_parse_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "fx_judge_raw").withColumn("j", judging.parse("content"))
    qc = judging.problems(F.col("j"), ("ccr_closure", "reasoning_topology"))
    return raw.select("doc_id", judging.integer_field(F.col("j"), "ccr_closure").alias("ccr"), F.when(F.col("j").isNull(), "error").otherwise("judged").alias("status"), F.array_join(qc, ",").alias("qc"))


@query
def judge_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = body(spark, sf_dir).select("dataset", "uid", "problem", "reasoning", F.lit("").alias("answer"))
    return judging.judge(traces).groupBy("dataset").agg(F.count_if(F.col("status") == "judged").alias("judged"), F.sum(F.size("qc")).alias("flaws"), F.avg("ccr_closure").alias("ccr"))


@query
def eligible_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(sampling.eligible(body(spark, sf_dir), ["doc_id"], 200, 60), 10).select("dataset", "uid", "doc_id")


@query
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(body(spark, sf_dir), 50, "domain", "doc_id").select("doc_id", "domain")


@query
def length_window_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.length_window(body(spark, sf_dir), 1500, 8000, 3, ["doc_id"]).select("doc_id", "reasoning_chars")


@query
def batches_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.manifest(sampling.batches(body(spark, sf_dir), ["doc_id"])).select("dataset", "batch_id", "n", F.array_join("uids", ",").alias("uids"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = body(spark, sf_dir)
    return pairing.pair_manifest(df.where("dataset = 'deepseek'"), df.where("dataset = 'glm'"), "doc_id", False)


@query
def pair_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("ds_hash", "ds_id", "glm_id", "domain")


@query
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_dedup(manifest(spark, sf_dir), 20, "probe_pos").select("ds_id", "glm_id")


@query
def pair_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the other side's id; ids whose last hex digit of MD5 is 0 to 5 are misspelt, and so fall back to ds_id."""
    misspelt = F.when(F.right(F.md5(F.col("glm_id").cast("binary")), F.lit(1)) < "6", "x").otherwise("")
    wanted = manifest(spark, sf_dir).select("ds_id", F.concat("glm_id", misspelt).alias("glm_id"))
    return pairing.resolve_pairs(wanted, pairing.one_of(body(spark, sf_dir), ["uid"], F.col("doc_id")), ["doc_id", "dataset"]).select("ds_id", "glm_id", "doc_id", "dataset")


@query
def pair_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.pair_yield(manifest(spark, sf_dir), body(spark, sf_dir).where("dataset = 'glm'")))


@query
def pair_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.match_rate(manifest(spark, sf_dir), body(spark, sf_dir).where("dataset = 'glm'"), "doc_id")


def files(spark: SparkSession, sf_dir: str, judge: str = "a", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items in files of five, and a judge's scores of them; unless ``whole``, in every third file the first score is missing."""
    items = sampling.batches(body(spark, sf_dir), ["doc_id"]).withColumn("file", F.concat_ws("_", "dataset", F.col("batch_id").cast("string")))
    scores = items.join(judgments(spark, sf_dir, judge).select("doc_id", "ccr_closure"), "doc_id")
    if not whole:
        scores = scores.where("not (batch_id % 3 = 0 and pos = 0)").withColumn("pos", F.when(F.col("batch_id") % 3 == 0, F.col("pos") - 1).otherwise(F.col("pos")))
    return items.select("file", "pos", "uid", "doc_id", "dataset"), scores.select("file", "pos", "uid", "ccr_closure")


@query
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, scores = files(spark, sf_dir)
    return pairing.positional_join(items, scores, ["ccr_closure"]).select("file", "pos", "uid", "doc_id", "ccr_closure", "aligned")


@query
def batch_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, scores = files(spark, sf_dir)
    return pairing.complete_files((items, "items"), (scores, "scores"))


@query
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.resume_todo(body(spark, sf_dir), judgments(spark, sf_dir, "b").where("doc_id % 3 = 0 or doc_id % 50 = 49")).select("doc_id", "dataset", "uid")


@query
def uid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.lookup(body(spark, sf_dir), manifest(spark, sf_dir).select(F.col("glm_id").alias("uid"))).select("doc_id", "dataset", "uid")


@query
def summary_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.summary_by_dataset(scored(spark, sf_dir)))


@query
def summary_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.summary_legacy(judgments(spark, sf_dir, "b")))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.run_summary(judgments(spark, sf_dir, None), ["ccr_closure", "monitoring_control_coupling"], ["judge"]))


@query
def topology_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(judgments(spark, sf_dir), "dataset", "reasoning_topology")


@query
def failure_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(judgments(spark, sf_dir), "dataset", "failure_type", 5)


@query
def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.length_report(scored(spark, sf_dir)))


@query
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.judge_means(judgments(spark, sf_dir, None), ["a", "b", "c"]))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir, None).groupBy("doc_id", "dataset").pivot("judge", ["a", "b", "c"]).agg(F.max("ccr_closure"))


@query
def bias_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.mean_by_level(wide(spark, sf_dir), "a", "b"))


@query
def self_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.self_bias(judgments(spark, sf_dir, None), "b", "kimi"))


@query
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wide(spark, sf_dir).groupBy("dataset").agg(*(c.alias(k) for k, c in stats.agreement("a", "b").items() if k != "qwk")))


@query
def qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wide(spark, sf_dir).groupBy("dataset").agg(stats.weighted_kappa("a", "c").alias("qwk")))


@query
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges joined on (dataset, uid)."""
    return rounded(reports.calibration(judgments(spark, sf_dir, "a"), judgments(spark, sf_dir, "b"), "doc_id"))


def pairs_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return reports.paired(df, "k", "deepseek", "glm", columns, "doc_id")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(scored(spark, sf_dir), ["ccr_closure", "reasoning_topology", "overthrow_present", "density"])


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("k", (F.col("ccr_closure_b") - F.col("ccr_closure_a")).alias("d"))


@query
def wilcoxon_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(differences(spark, sf_dir), "d"))


@query
def wilcoxon_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(differences(spark, sf_dir), "d", ties="negative_first"))


@query
def wilcoxon_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(differences(spark, sf_dir), "d", ties="input", order="k", least=5))


@query
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(differences(spark, sf_dir), "d").withColumn("p", stats.two_sided_p("z")).select("n_nonzero", "z", "p"))


@query
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir, None).where("dataset in ('glm', 'deepseek')")
    return rounded(stats.cliffs_delta(rows, "ccr_closure", F.col("dataset") == "glm", ["judge"]))


@query
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.paired_summary(pairs(spark, sf_dir)))


@query
def paradox_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.paradox(pairs(spark, sf_dir)))


@query
def spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(wide(spark, sf_dir), "a", "b", ["dataset"], "ordinal", "doc_id"))


@query
def spearman_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(wide(spark, sf_dir), "a", "b", ["dataset"]))


SIMPLE = ("pdd", "ear", "oed", "rt_topology_density", "ce", "nrr", "bsd")


def with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(spark, sf_dir, (*EDGE, "assertion")).withColumn("words", t.count_matches("reasoning", lx.WORD))
    m = m.withColumns({"pdd": structural.dependency_depth(), "ear": structural.early_assertion_rate(), "oed": structural.overthrow_density(), "rt_topology_density": structural.topology()[0], "ce": structural.compression(words="words"), "nrr": structural.noise_ratio(words="words"), "bsd": structural.branching_sparsity()})
    return m.select("doc_id", *SIMPLE).join(judgments(spark, sf_dir).select("doc_id", "dataset", "uid", "ccr_closure"), "doc_id")


@query
def pearson_metric_ccr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.convergent_validity(with_metrics(spark, sf_dir), SIMPLE))


@query
def metric_dataset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.metric_ranking(with_metrics(spark, sf_dir), SIMPLE))


@query
def mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir).withColumn("changed", F.when(F.col("answer_change").isNotNull(), (F.col("answer_change") != "none").cast("int")))
    own = rows.groupBy("dataset").agg(stats.mutual_information("critique_present", "changed").alias("mi"))
    return rounded(own.union(rows.agg(F.lit("(pooled)").alias("dataset"), stats.mutual_information("critique_present", "changed").alias("mi"))))


@query
def label_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{sf_dir}/labels.parquet").agg(stats.mutual_information("quality", "toxic").alias("mi")))


@query
def panel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.panel_agreement(judgments(spark, sf_dir, None), ["doc_id"]))


@query
def panel_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.ranking_agreement(judgments(spark, sf_dir, None)))


@query
def panel_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.headline_by_judge(judgments(spark, sf_dir, None), "k", "deepseek", "glm"))


@query
def dataset_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.density_ladder(scored(spark, sf_dir)))


@query
def closure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.closure_rates(judgments(spark, sf_dir), ["dataset"]))


@query
def method_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.method_means(judgments(spark, sf_dir)))


@query
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kruskal_wallis(judgments(spark, sf_dir), "ccr_closure", "dataset"))


@query
def training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.training_set(judgments(spark, sf_dir)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query
def report_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.report_json(judgments(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("ccr_closure").alias("most")).select("dataset", "n", "most"))
