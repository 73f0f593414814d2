"""Hand-checked vectors of the text metrics and statistics, and an independent Python form of the regex metrics."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill import lexicons as lx
from tracemill.functions import text as t
from tracemill.operators import judging, pairing, reports, sampling, stats, structural


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("v")).first().v


def metric(spark, text, make):
    return structural.with_marks(spark.createDataFrame([(text,)], "reasoning string")).select(make().alias("v")).first().v


def test_split_thinking(spark):
    for text, want in (("x<THINKING>a\nb</think>c</think>d", ("a\nb", "c</think>d")), ("pre <think>abc", ("", "pre <think>abc")), (None, ("", "")), ("", ("", ""))):
        assert tuple(spark.createDataFrame([(text,)], "x string").select(*t.split_thinking("x")).first()) == want


def test_head_and_tail(spark):
    assert one(spark, "a" * 9000, lambda c: t.head_and_tail(c, 9000)) == "a" * 9000
    assert "[... 1 chars elided ...]" in one(spark, "a" * 9001, lambda c: t.head_and_tail(c, 9000))


def test_paragraphs(spark):
    assert one(spark, "a\n\nb\n \n\nc\n\n", t.paragraphs) == ["a", "b", "c"]
    assert one(spark, None, t.paragraphs) == []


def test_normalize(spark):
    assert one(spark, " ﬁne  X\n", t.normalize_problem) == "fine x"


@pytest.mark.parametrize(("text", "pattern"), [("等等，不对", lx.CRITIQUE), ("因此", lx.CAUSAL), ("因此", lx.ASSERTION), ("综上", lx.MERGE), ("如前所述", lx.BACKREF)])
def test_cjk_markers(spark, text, pattern):
    assert one(spark, text, lambda c: t.matches(F.col(c), pattern))


def test_boundary_next_to_cjk(spark):
    assert not one(spark, "不好wait不好", lambda c: t.matches(F.col(c), r"(?i)\bwait\b"))


def test_metric_vectors(spark):
    five = "\n\n".join(["the answer is 1", "b", "c", "d", "e"])
    assert metric(spark, five, structural.early_assertion_rate) == 1.0
    assert metric(spark, "\n\n".join(["wait"] * 5), lambda: structural.action_bigrams()[0]) is None
    assert metric(spark, "a\n\nrecall that step 9", structural.dependency_depth) == 0.0
    assert metric(spark, "a\n\nb\n\nc", structural.branching_sparsity) == 0.0
    assert metric(spark, None, structural.dependency_depth) == 0.0
    assert metric(spark, "", structural.compression) is None


def test_gini_and_pagerank(spark):
    assert one(spark, [1.0, 1.0, 1.0], lambda c: structural.gini(F.col(c)), "array<double>") == pytest.approx(0)
    assert one(spark, [1.0], lambda c: structural.gini(F.col(c)), "array<double>") is None
    assert structural.gini_of([3.0, 1.0, 2.0]) == pytest.approx(one(spark, [3.0, 1.0, 2.0], lambda c: structural.gini(F.col(c)), "array<double>"))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 9), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20))
def test_pagerank_sums_to_one(n, links):
    links = [(min(a, b), max(a, b)) for a, b in links if a != b and max(a, b) < n]
    assert math.isclose(sum(structural.pagerank(n, links)), 1)


def test_regex_metrics_match_python(spark, sf):
    from tracemill.plans import catalog

    df = catalog.body(spark, sf).limit(60)
    got = df.select("reasoning", *(t.count_matches("reasoning", p).alias(f"p{i}") for i, p in enumerate((lx.CRITIQUE, lx.OVERTHROW, lx.LOGIC, lx.NOISE, lx.WORD, lx.DENSITY_B)))).collect()
    for r in got:
        for i, p in enumerate((lx.CRITIQUE, lx.OVERTHROW, lx.LOGIC, lx.NOISE, lx.WORD, lx.DENSITY_B)):
            assert sum(1 for _ in re.finditer(p, r.reasoning)) == r[f"p{i}"]


def test_case_and_space_do_not_matter(spark):
    base = "wait, this is wrong\n\ntherefore x\n\nrecall that y\n\noverall z"
    for make in (structural.branching_sparsity, structural.dependency_depth, lambda: structural.topology()[0]):
        assert metric(spark, base, make) == metric(spark, base.upper().replace("\n\n", "\n \t\n\n"), make)


def diffs(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos int, d int")


def test_signed_rank_ties(spark):
    df = diffs(spark, [1, -1, 1, -1, 1, -1, 2, -2])
    for ties, want in (("negative_first", (23, 13)), ("input", (16, 20)), ("average", (18, 18))):
        r = stats.signed_rank(df, "d", ties=ties, order="pos").first()
        assert (r.w_plus, r.w_minus) == want
    assert stats.signed_rank(diffs(spark, [1, 2, 3, 4, 5]), "d").first().w_plus is None
    assert stats.signed_rank(diffs(spark, [1, 2, 3, 4, 5]), "d", least=5).first().w_plus == 15


def test_cliffs_delta(spark):
    df = spark.createDataFrame([(True, 3), (True, 1), (False, 2), (False, 1)], "a boolean, v int")
    d = stats.cliffs_delta(df, "v", F.col("a")).first().delta
    assert d == 0.25
    assert stats.cliffs_delta(df, "v", ~F.col("a")).first().delta == -d
    assert stats.cliffs_delta(df.where("not a"), "v", F.col("a")).first().delta == 0


def test_medians_and_correlations(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (10, 1.0)], "v int, w double")
    assert df.agg(stats.upper_median("v").alias("m")).first().m == 3
    assert df.agg(stats.pearson(F.col("v"), F.col("w")).alias("r")).first().r is None
    assert df.limit(3).agg(stats.pearson(F.col("v"), F.col("v")).alias("r")).first().r is None
    assert df.agg(stats.pearson(F.col("v"), F.col("v")).alias("r")).first().r == pytest.approx(1)
    assert stats.spearman(df.limit(1), "v", "w", mode="ordinal", order="v").first().rho is None


def test_kappa(spark):
    same = spark.createDataFrame([(0, 0), (1, 1), (4, 4)], "a int, b int")
    assert same.agg(stats.weighted_kappa("a", "b").alias("k")).first().k == pytest.approx(1)
    assert same.limit(1).agg(stats.weighted_kappa("a", "b").alias("k")).first().k is None


def test_mutual_information(spark):
    rows = [(a, b) for a in (0, 1) for b in (0, 1)] * 2
    df = spark.createDataFrame(rows, "x int, y int")
    assert df.agg(stats.mutual_information("x", "y").alias("m")).first().m == pytest.approx(0)
    assert df.limit(7).agg(stats.mutual_information("x", "y").alias("m")).first().m is None
    assert df.agg(stats.mutual_information("x", "x").alias("m")).first().m == pytest.approx(1)


def test_parse_and_problems(spark):
    texts = {'```json\n{"ccr_closure": 3, "reasoning_topology": "loop"}\n```': 3, 'so {"ccr_closure": true} done': 1, '{"ccr_closure": 2.5}': None, "{bad": None, None: None, "[1]": None}
    for text, want in texts.items():
        assert one(spark, text, lambda c: judging.integer_field(judging.parse(c), "ccr_closure")) == want
    assert one(spark, "none", lambda c: judging.problems(judging.parse(c))) == ["no object"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, reasoning string, dataset string, uid string, ccr_closure int, judge string, reasoning_chars int, domain string, problem string")
    assert structural.all_metrics(empty).count() == 0
    assert reports.panel_agreement(empty, ["doc_id"]).count() == 0
    assert sampling.stratified(empty, 5).count() == 0
    assert pairing.pair_manifest(empty, empty, "doc_id").count() == 0
    assert stats.signed_rank(empty.withColumn("d", F.col("ccr_closure")), "d").first().w_plus is None
