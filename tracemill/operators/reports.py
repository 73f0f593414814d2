"""Reports over judged traces: summaries, pairs, length, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicons as lx
from ..functions.text import log_length
from . import stats


def pct(c: Column) -> Column:
    """Share of rows in percent; rows where ``c`` is null count as no."""
    return 100.0 * F.count_if(c) / F.count(F.lit(1))


def judged(df: DataFrame) -> DataFrame:
    """Rows with a score; rows without a status count as judged."""
    return df.where((F.coalesce("status", F.lit("judged")) == "judged") & F.col("ccr_closure").isNotNull())


def summary_by_dataset(df: DataFrame) -> DataFrame:
    return df.where("ccr_closure is not null").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ccr_closure").alias("ccr_mean"),
        stats.upper_median("ccr_closure").cast("int").alias("ccr_median"),
        F.avg("monitoring_control_coupling").alias("coupling_mean"),
        F.avg("causal_depth_of_critique").alias("depth_mean"),
        F.avg("density").alias("density_mean"),
        pct(F.col("reasoning_topology") == "loop").alias("loop_pct"),
        pct(F.col("overthrow_present") == 1).alias("overthrow_pct"),
        pct(F.col("early_assertion") == 1).alias("early_pct"),
        pct(F.col("answer_change") == "final").alias("final_pct"),
        pct(F.col("templated_divergence") == 1).alias("templated_pct"),
    )


def summary_legacy(df: DataFrame) -> DataFrame:
    return judged(df).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg("ccr_closure"), F.lit(0.0)).alias("ccr_mean"),
        F.coalesce(F.median("ccr_closure"), F.lit(0.0)).alias("ccr_median"),
        F.coalesce(F.avg("monitoring_control_coupling"), F.lit(0.0)).alias("coupling_mean"),
        F.count_if(F.col("templated_divergence") == 1).alias("templated_n"),
        *(F.count_if(F.col("answer_change") == a).alias(f"change_{a}") for a in ("none", "intermediate", "final")),
    )


def run_summary(df: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    cols = {k: c for f in fields for k, c in stats.mean_and_spread(f).items()}
    status = F.coalesce("status", F.lit("judged"))
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in cols.items()), F.count_if(status == "judged").alias("judged_n"), F.count_if(status == "error").alias("error_n"))


def histogram(df: DataFrame, group: str, category: str, top: int | None = None) -> DataFrame:
    """(group, category, n): the ``top`` commonest of each group, ties by name; nulls left out."""
    counts = df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    w = Window.partitionBy(group).orderBy(F.desc("n"), category)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def paired(df: DataFrame, key: str, a: str, b: str, columns: Sequence[str], order: str) -> DataFrame:
    """One row for each key with a row of both datasets: columns suffixed _a and _b. Of several rows of one key and dataset the last in ``order`` counts, whole."""
    last = {s: F.max_by(F.struct(*columns), F.when(F.col("dataset") == d, F.col(order))).alias(s) for s, d in (("a", a), ("b", b))}
    both = df.where(F.col("dataset").isin(a, b) & F.col(key).isNotNull()).groupBy(key).agg(*last.values(), F.count_distinct("dataset").alias("__n"))
    return both.where("__n = 2").select(key, *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in columns for s in ("a", "b")))


def paired_summary(pairs: DataFrame, score: str = "ccr_closure") -> DataFrame:
    """Wins, losses and ties of b over a, median difference, rank-biserial and shares."""
    d = F.col(f"{score}_b") - F.col(f"{score}_a")
    n = F.count(F.lit(1))
    wins, losses = F.count_if(d > 0), F.count_if(d < 0)
    return pairs.agg(
        n.alias("n_pairs"), F.avg(f"{score}_a").alias("a_mean"), F.avg(f"{score}_b").alias("b_mean"), F.median(d).alias("median_diff"),
        wins.alias("b_higher"), losses.alias("a_higher"), (n - wins - losses).alias("tied"), stats.ratio(wins - losses, n).alias("rank_biserial"),
        pct(F.col("reasoning_topology_a") == "loop").alias("a_loop_pct"), pct(F.col("reasoning_topology_b") == "loop").alias("b_loop_pct"),
        pct(F.col("overthrow_present_a") == 1).alias("a_overthrow_pct"), pct(F.col("overthrow_present_b") == 1).alias("b_overthrow_pct"),
        F.avg("density_a").alias("a_density"), F.avg("density_b").alias("b_density"),
    )


def paradox(pairs: DataFrame, score: str = "ccr_closure") -> DataFrame:
    """Whether a has the higher critique density and yet the lower closure."""
    r = pairs.agg(F.avg("density_a").alias("a_density"), F.avg("density_b").alias("b_density"), F.avg(f"{score}_a").alias("a_score"), F.avg(f"{score}_b").alias("b_score"), F.count_if((F.col("density_a") > F.col("density_b")) & (F.col(f"{score}_a") < F.col(f"{score}_b"))).alias("pairs_in_paradox"))
    return r.withColumn("holds", (F.col("a_density") > F.col("b_density")) & (F.col("a_score") < F.col("b_score")))


def length_report(df: DataFrame, low: int = 1000, high: int = 8000) -> DataFrame:
    rows = df.where(F.col("ccr_closure").isNotNull() & (F.col("reasoning_chars") > 0))
    native, rebuilt = (F.col("dataset").isin(*s) for s in (lx.NATIVE_SETS, lx.RECONSTRUCTED_SETS))
    band = F.col("reasoning_chars").between(low, high)
    mean = lambda c, x: F.coalesce(F.avg(F.when(c, F.col(x))), F.lit(0.0))
    return rows.agg(
        F.coalesce(stats.pearson(log_length(F.col("reasoning_chars")), F.col("ccr_closure"), 1), F.lit(0.0)).alias("pearson_log_len"),
        mean(native, "reasoning_chars").alias("chars_native"), mean(rebuilt, "reasoning_chars").alias("chars_rebuilt"),
        F.count_if(band & native).alias("band_native_n"), mean(band & native, "ccr_closure").alias("band_native_ccr"),
        F.count_if(band & rebuilt).alias("band_rebuilt_n"), mean(band & rebuilt, "ccr_closure").alias("band_rebuilt_ccr"),
    )


def judge_means(df: DataFrame, judges: Sequence[str]) -> DataFrame:
    return df.groupBy("dataset").pivot("judge", list(judges)).agg(F.avg("ccr_closure"))


def judge_pairs(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(judge_a, judge_b, score_a, score_b) of every pair of judges on the same item."""
    rows = df.where("ccr_closure is not null").select(*key, "judge", "ccr_closure")
    a = rows.select(*key, F.col("judge").alias("judge_a"), F.col("ccr_closure").alias("score_a"))
    b = rows.select(*key, F.col("judge").alias("judge_b"), F.col("ccr_closure").alias("score_b"))
    return a.join(b, list(key)).where("judge_a < judge_b")


def panel_agreement(df: DataFrame, key: Sequence[str], least: int = 3) -> DataFrame:
    pairs = judge_pairs(df, key)
    a = stats.agreement("score_a", "score_b") | {"qwk": stats.weighted_kappa("score_a", "score_b", least=least)}
    return pairs.groupBy("judge_a", "judge_b").agg(*(c.alias(k) for k, c in a.items()))


def ranking_agreement(df: DataFrame, mode: str = "average") -> DataFrame:
    """Rank correlation of the datasets' means between every two judges."""
    means = df.where("ccr_closure is not null").groupBy("dataset", "judge").agg(F.avg("ccr_closure").alias("m"))
    a = means.select("dataset", F.col("judge").alias("judge_a"), F.col("m").alias("x"))
    b = means.select("dataset", F.col("judge").alias("judge_b"), F.col("m").alias("y"))
    return stats.spearman(a.join(b, "dataset").where("judge_a < judge_b"), "x", "y", ["judge_a", "judge_b"], mode, "dataset")


def headline_by_judge(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    pick = lambda d: F.max(F.when(F.col("dataset") == d, F.col("ccr_closure")))
    d = df.where(F.col("dataset").isin(a, b)).groupBy("judge", key).agg((pick(b) - pick(a)).alias("d")).where("d is not null")
    return d.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("b_higher"), F.count_if(F.col("d") < 0).alias("a_higher"), F.count_if(F.col("d") == 0).alias("tied"), F.avg("d").alias("mean_diff"))


def mean_by_level(df: DataFrame, primary: str, other: str) -> DataFrame:
    """The other judge's mean at each level of the primary one."""
    return df.where(F.col(primary).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(primary).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(other).alias("other_mean"))


def self_bias(df: DataFrame, judge: str, dataset: str) -> DataFrame:
    rows = df.where((F.col("dataset") == dataset) & F.col("ccr_closure").isNotNull())
    own, other = (F.avg(F.when(c, F.col("ccr_closure"))) for c in (F.col("judge") == judge, F.col("judge") != judge))
    return rows.agg(own.alias("self_mean"), other.alias("others_mean"), (own - other).alias("bias"))


def convergent_validity(df: DataFrame, metrics: Sequence[str], score: str = "ccr_closure") -> DataFrame:
    """(metric, n, r): correlation of each metric with the score."""
    long = df.unpivot([score], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.count_if(F.col("value").isNotNull() & F.col(score).isNotNull()).alias("n"), stats.pearson(F.col("value"), F.col(score)).alias("r"))


def metric_ranking(df: DataFrame, metrics: Sequence[str], score: str = "ccr_closure", mode: str = "average") -> DataFrame:
    """(metric, n, rho): rank correlation of datasets' means of each metric and of the score."""
    means = df.groupBy("dataset").agg(*(F.avg(m).alias(m) for m in metrics), F.avg(score).alias(score))
    return stats.spearman(means.unpivot(["dataset", score], list(metrics), "metric", "value"), "value", score, ["metric"], mode, "dataset")


def density_ladder(df: DataFrame, high: float = 5.0, low: float = 2.0) -> DataFrame:
    """Datasets by critique density, and how dense they are."""
    means = df.groupBy("dataset").agg(F.avg("density").alias("density_mean"), F.avg("ccr_closure").alias("ccr_mean"))
    level = F.when(F.col("density_mean") >= high, "high").when(F.col("density_mean") >= low, "medium").otherwise("low")
    place = F.row_number().over(Window.orderBy(F.desc("density_mean"), "dataset"))
    return means.select("dataset", "density_mean", "ccr_mean", level.alias("level"), place.alias("place"))


def closure_rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares of traces whose critique acts, is idle, overturns, and verifies, and a group mean of means is built on it."""
    return df.where("ccr_closure is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pct(F.col("answer_change") != "none").alias("acting_pct"),
        pct((F.col("critique_present") == 1) & (F.col("answer_change") == "none")).alias("idle_pct"),
        pct(F.col("overthrow_present") == 1).alias("overturn_pct"), pct(F.col("ccr_closure") >= 2).alias("closed_pct"),
    )


def method_means(df: DataFrame) -> DataFrame:
    """Unweighted means over the datasets of each method group."""
    method = F.when(F.col("dataset").isin(*lx.NATIVE_SETS), "native").when(F.col("dataset").isin(*lx.RECONSTRUCTED_SETS), "reconstructed").otherwise("other")
    sets = df.where("ccr_closure is not null").groupBy("dataset").agg(F.avg("ccr_closure").alias("m"))
    return sets.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("datasets"), F.avg("m").alias("mean_of_means"))


def commonest(df: DataFrame, group: str, category: str, top: int | None = None) -> DataFrame:
    """(group, category) with the category's counts as text ``name:n,...``, commonest first, ties by name; nulls left out."""
    counts = df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(category).cast("string").alias("name"))))
    ordered = F.slice(ordered, 1, top) if top else ordered
    named = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["name"], (-x["less"]).cast("string"))), ",")
    return counts.groupBy(group).agg(named.alias(category))


def _with_counts(report: DataFrame, rows: DataFrame, group: str, tops: dict[str, int | None]) -> DataFrame:
    for category, top in tops.items():
        report = report.join(commonest(rows, group, category, top), group, "left").withColumn(category, F.coalesce(category, F.lit("")))
    return report


def dataset_report(df: DataFrame, order: str, teacher: str = "teacher") -> DataFrame:
    """The summary of each dataset with its topologies, five commonest failures and the teacher of its first row in ``order``."""
    rows = df.where("ccr_closure is not null")
    first = rows.groupBy("dataset").agg(F.min_by(teacher, order).alias("teacher"))
    return _with_counts(summary_by_dataset(df).join(first, "dataset"), rows, "dataset", {"reasoning_topology": None, "failure_type": 5})


def legacy_report(df: DataFrame) -> DataFrame:
    """The older summary of each dataset, in full: planning, divergence, creativity, topologies, failures and answer changes; means are 0 where nothing has them."""
    rows = judged(df)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    more = rows.groupBy("dataset").agg(
        mean("causal_depth_of_critique").alias("depth_mean"), mean("density").alias("density_mean"), mean("planning_depth").alias("planning_mean"),
        mean("plan_execution_consistency").alias("plan_exec_mean"), mean("divergent_score").alias("divergent_mean"),
        F.count_if(F.col("creative_destruction") == 1).alias("creative_n"), pct(F.col("reasoning_topology") == "loop").alias("loop_pct"),
    )
    return _with_counts(summary_legacy(df).join(more, "dataset"), rows, "dataset", {"reasoning_topology": None, "failure_type": None, "answer_change": None})


def run_report(df: DataFrame, fields: Sequence[str], by: str) -> DataFrame:
    """Counts by status, spread of the fields over judged rows, their mean density, topologies and failures."""
    status = F.coalesce("status", F.lit("judged"))
    counts = df.groupBy(by).agg(*(F.count_if(status == k).alias(f"n_{k}") for k in ("judged", "skipped", "error")))
    scored = df.where(status == "judged")
    cols = {k: c for f in fields for k, c in stats.mean_and_spread(f, None).items()} | {"density_mean": F.avg("density")}
    spread = scored.groupBy(by).agg(*(c.alias(k) for k, c in cols.items()))
    return _with_counts(counts.join(spread, by, "left"), scored, by, {"reasoning_topology": None, "failure_type": None})


def teacher_means(df: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, n, mean_ccr) of a pilot, means to two places."""
    return df.where("ccr_closure is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ccr_closure"), 2).alias("mean_ccr"))


def model_read(df: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """How a model reasons, without a judge: closed think blocks, mean bigram entropy and edge density, traces with an overthrow. Needs ``closed``, ``entropy``, ``edge_density`` and ``overthrown``."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), F.count_if("closed").alias("n_closed"), F.avg("entropy").alias("entropy_mean"), F.avg("edge_density").alias("edge_density_mean"), F.count_if("overthrown").alias("n_overthrown"), pct(F.col("overthrown")).alias("overthrown_pct"))


def effect_rates(df: DataFrame, by: Sequence[str], long_chars: int = 8000) -> DataFrame:
    """Rates of whether critique does anything, in percent; null where nothing qualifies.

    answer_impact: of traces that revise anything, those whose final answer changes; idle_critique: of those
    with critique, those that revise nothing; over_reasoning: of long ones, those whose loop closes at 1 or
    less; independent_check: of those that verify, those that do so independently (level 2).
    """
    share = lambda c, of: stats.ratio(100 * F.count_if(of & c), F.count_if(of))
    revised, critique = F.col("answer_change").isin("intermediate", "final"), F.col("critique_present") == 1
    return df.where("ccr_closure is not null").groupBy(*by).agg(
        share(F.col("answer_change") == "final", revised).alias("answer_impact"), share(~revised, critique).alias("idle_critique"),
        share(F.col("ccr_closure") <= 1, F.col("reasoning_chars") >= long_chars).alias("over_reasoning"),
        share(F.col("verification_independence") == 2, F.col("verification_independence") >= 1).alias("independent_check"),
    )


def last_scores(df: DataFrame, key: Sequence[str], order: str, score: str = "ccr_closure", name: str | None = None) -> DataFrame:
    """(key, score) of the last scored row of each key in ``order``."""
    return df.where(F.col(score).isNotNull()).groupBy(*key).agg(F.max_by(score, order).alias(name or score))


def with_score(metrics: DataFrame, scores: DataFrame, order: str, key: Sequence[str] = ("dataset", "uid"), score: str = "ccr_closure") -> DataFrame:
    """Every metric row with the last score of its key, null without one."""
    return metrics.join(last_scores(scores, key, order, score), list(key), "left")


def calibration(rows: DataFrame, other: DataFrame, order: str, key: Sequence[str] = ("dataset", "uid")) -> DataFrame:
    """Agreement of scored rows with the other judge's last score of the same key. With the key ``uid`` alone, datasets that share ids meet."""
    both = rows.where("ccr_closure is not null").select(*key, F.col("ccr_closure").alias("x")).join(last_scores(other, key, order, name="y"), list(key))
    return both.agg(*(c.alias(k) for k, c in stats.agreement("x", "y").items()), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def verify_consistency(second: DataFrame, first: DataFrame, order: str = "pos") -> DataFrame:
    """Agreement of a second pass with the first over the same (file, uid); of several scores of the first pass the last counts."""
    both = second.where("ccr_closure is not null").select("file", "uid", F.col("ccr_closure").alias("x")).join(last_scores(first, ["file", "uid"], order, name="y"), ["file", "uid"])
    return both.agg(*(c.alias(k) for k, c in stats.agreement("x", "y").items() if k != "qwk"))


def paired_report(pairs: DataFrame, score: str = "ccr_closure") -> DataFrame:
    """Upper medians, means of score, density and coupling, and topologies of both sides of pairs; null couplings are left out."""
    out = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *(stats.upper_median(f"{score}_{s}").cast("int").alias(f"{s}_median") for s in ("a", "b")),
        stats.upper_median(f"{score}_b - {score}_a").cast("int").alias("upper_median_diff"),
        *(F.avg(f"{c}_{s}").alias(f"{s}_{n}") for c, n in ((score, "mean"), ("density", "density"), ("monitoring_control_coupling", "coupling")) for s in ("a", "b")),
    )
    for s in ("a", "b"):
        named = pairs.select(F.lit(1).alias("__one"), F.coalesce(f"reasoning_topology_{s}", F.lit("?")).alias(f"{s}_topology"))
        out = out.withColumn("__one", F.lit(1)).join(commonest(named, "__one", f"{s}_topology"), "__one", "left").drop("__one")
    return out


def in_display_order(df: DataFrame, names: Sequence[str], column: str = "dataset") -> DataFrame:
    """``df`` with ``place``: where the column's value stands in ``names``; others behind them, alike."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int")
    return df.withColumn("place", F.when(at > 0, at).otherwise(len(names) + 1)).orderBy("place", column)
