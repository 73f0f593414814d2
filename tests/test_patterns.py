"""The faster forms of patterns, folding and coupling against the plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill import lexicons as lx
from tracemill.functions import text as t
from tracemill.operators import structural

PATTERNS = {k: p for k, p in vars(lx).items() if k.isupper() and isinstance(p, str) and k not in ("THINK",)} | lx.ACTIONS | {k: p for k, p in lx.FORMATS.items()}


def plain(pattern):
    return "(?U)(?d)" + re.sub(r"^\(\?i(s?)\)", lambda m: "(?s)" if m[1] else "", pattern)


def texts(pattern, n=150):
    """Texts of the pattern's own pieces, whole and cut, with odd characters between them."""
    r = random.Random(pattern)
    pieces = [x for x in re.split(r"[|()\[\]?*+{}.\\]|\d+,\d+", pattern.lower()) if x] + list("1 2 step 3|$=≠+-;`{}".split(" "))
    odd = [" ", "", "a", "_", "9", "é", "é", "́", "\n", "\n\n", "。", "不", "'", "-", "‍", "😀", "\x85", ".", " x "]
    return ["".join(p if r.random() < 0.8 else p[: r.randrange(len(p) + 1)] for _ in range(12) for p in (r.choice(pieces), r.choice(odd))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_guarded_pattern_matches_the_same(spark, name):
    df = spark.createDataFrame([(x,) for x in texts(PATTERNS[name])], "x string")
    both = (F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (lx.java(PATTERNS[name]), plain(PATTERNS[name])))
    got = df.select("x", *(c.alias(k) for c, k in zip(both, "ab", strict=True))).collect()
    assert all(r.a == r.b for r in got)
    if name != "PARAGRAPH_BREAK":
        assert any(r.a for r in got)


@pytest.mark.parametrize("name", ["OVERTHROW", "LOGIC", "NOISE", "CRITIQUE", "DENSITY_B", "CALCULATE", "math"])
def test_alternatives_look_ahead_first(name):
    assert re.match(r"\(\?U\)\(\?d\)(\(\?s\))?\(\?=\[", lx.java(PATTERNS[name]))


def test_folding_looks_no_character_up(spark):
    df = spark.createDataFrame([("ſtraße WAIT ſ İ",), ("",), (None,)], "x string").select(t.folded(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["straße wait s i̇", "", None]
    assert "translate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_what_the_pattern_takes(spark):
    every = [chr(c) for c in range(0x3100) if c]
    df = spark.createDataFrame([(f"{c}{c}a {c} b\n{c}",) for c in every] + [("".join(every[8:40]),), (" \t\n",), ("",), (None,)], "x string")
    got = df.select("x", t.strip(F.col("x")).alias("a"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert all(r.a == r.b for r in got)


@pytest.mark.parametrize(("name", "pattern"), [("oed", lx.CHUNK), ("ce", lx.WORD), ("nrr", lx.WORD), ("pearson_metric_ccr", lx.WORD), ("pearson_metric_ccr", lx.CHUNK), ("ci_index", lx.CHUNK)])
def test_words_are_counted_once(spark, sf, name, pattern):
    from tracemill.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {lx.java(pattern)}, ") == 1


def brute(paras, critique):
    """critique_coupling by its definition."""
    if len(paras) < 4:
        return None
    sets = [set(p) for p in paras]
    like = lambda a, b: len(a & b) / max(len(a | b), 1)
    hits = [j for j, c in enumerate(critique) if c and j and sets[j]]
    if not hits:
        return None
    near = [like(sets[j], x) for j in hits for x in sets[max(0, j - structural.WINDOW) : j]]
    far = [sum(like(sets[j], x) for i, x in enumerate(sets) if i != j) / (len(sets) - 1) for j in hits]
    return sum(near) / len(near) / max(sum(far) / len(far), 0.001)


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_coupling_in_pieces(monkeypatch, at_once):
    import pyarrow as pa

    monkeypatch.setattr(structural, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(structural, "SHARED_AT_ONCE", at_once)
    r = random.Random(3)
    docs = [[[r.choice("abcdefghij") for _ in range(r.randrange(7))] for _ in range(r.choice((4, 5, 9, 30)))] for _ in range(40)]
    flags = [[r.random() < 0.4 for _ in d] for d in docs]
    docs[5] = flags[5] = None
    got = structural._coupling.func(pa.array(docs, pa.list_(pa.list_(pa.string()))), pa.array(flags, pa.list_(pa.bool_()))).to_pylist()
    want = [None if d is None else brute(d, f) for d, f in zip(docs, flags, strict=True)]
    assert [g is None for g in got] == [w is None for w in want]
    assert all(g is None or abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True))


def test_coupling_of_odd_texts(spark):
    texts = [None, "", "wait", "a\n\nwait a\n\nb\n\nc", "wait\n\na\n\nb\n\nc", "a b\n\n!!\n\nwait b\n\n不对\n\nbut a b\n\n...\n\noops wait b"]
    df = structural.with_marks(spark.createDataFrame(list(enumerate(texts)), "i int, reasoning string"), only=["critique"])
    rows = df.select("i", "paras", F.transform("marks", lambda m: m["critique"]).alias("c"), structural.critique_coupling().alias("v")).orderBy("i").collect()
    want = [brute([re.findall(r"\w+", p.lower()) for p in r.paras], r.c) for r in rows]
    assert [r.v for r in rows] == pytest.approx(want) and want[3] and want[5]


def test_coupling_compares_no_pairs_of_arrays(spark, sf):
    from tracemill.plans.registry import QUERIES

    assert "array_intersect" not in QUERIES["ccs_exact"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
