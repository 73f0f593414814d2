"""Structural text metrics of reasoning traces.

``with_marks`` cuts a text into paragraphs and marks each once; the metrics are column
expressions over these marks, so they cost no shuffle and share one pass over the text.
Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as lx
from ..functions import text as t

FLAGS = {"critique": lx.CRITIQUE, "assertion": lx.ASSERTION, "backref": lx.BACKREF, "causal": lx.CAUSAL, "branch": lx.BRANCH, "merge": lx.MERGE}
STEP_BACK = 3
WINDOW = 5
DRAWS = 5


MARKS = (*FLAGS, "step", "action", "format")


def with_marks(df: DataFrame, column: str = "reasoning", only: Sequence[str] = MARKS) -> DataFrame:
    """``df`` with ``paras`` and ``marks``: of each paragraph a struct of flags, step, action and format, or of ``only`` some."""

    def mark(p: Column) -> Column:
        def of(low: Column) -> Column:
            fields = {k: t.matches(p, x, low) for k, x in FLAGS.items()}
            fields["step"] = F.nullif(F.regexp_extract(low, lx.java(lx.STEP), 1), F.lit("")).try_cast("int")
            fields["action"] = t.first_match(p, lx.ACTIONS, "OTHER", low)
            fields["format"] = t.first_match(p, lx.FORMATS, "prose", low)
            return F.struct(*(fields[k].alias(k) for k in MARKS if k in only))

        return t.let(t.folded(p), of)

    return df.withColumn("paras", t.paragraphs(column)).withColumn("marks", F.transform("paras", mark))


def _n() -> Column:
    return F.size("paras")


def _mean(values: Column) -> Column:
    """Mean of an array of doubles, null if empty."""
    return t.let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _count(marks: Column, f) -> Column:  # noqa: ANN001
    return F.size(F.filter(marks, f))


def dependency_depth() -> Column:
    def depth(m: Column, j: Column) -> Column:
        d = F.when(m["step"].isNull(), F.lit(STEP_BACK)).otherwise(j - m["step"])
        return F.when(m["backref"] & (d > 0), d.cast("double"))

    return F.coalesce(_mean(F.array_compact(F.transform("marks", depth))), F.lit(0.0))


def inertia_slope() -> Column:
    third = F.floor(_n() / F.lit(3)).cast("int")

    def words(begin: Column, size: Column) -> Column:
        return F.array_distinct(t.all_matches(F.lower(F.array_join(F.slice("paras", begin, size), " ")), lx.LONG_WORD))

    # Whether the first third has a word at all; it needs no list of them.
    first = F.when(F.lower(F.array_join(F.slice("paras", F.lit(1), third), " ")).rlike(lx.java(lx.LONG_WORD)), F.lit(1.0)).otherwise(F.lit(0.0))
    # The union of the first two thirds' words is that of their joined text.
    seen = words(F.lit(1), 2 * third)
    new = t.let(words(2 * third + 1, _n()), lambda c: F.size(F.array_except(c, seen)) / F.greatest(F.size(c), F.lit(1)).cast("double"))
    return F.when(_n() >= 6, new - first)


def early_assertion_rate() -> Column:
    cut = F.greatest(F.lit(1), F.floor(_n() / F.lit(5)).cast("int"))
    return F.when(_n() >= 5, _count(F.slice("marks", F.lit(1), cut), lambda m: m["assertion"]) / cut.cast("double"))


def overthrow_density(column: str = "reasoning") -> Column:
    hits = t.count_matches(column, lx.OVERTHROW)
    return t.let(t.count_matches(column, lx.CHUNK), lambda n: F.when(n >= 100, F.lit(1000.0) * hits / n))


def topology() -> tuple[Column, Column, Column]:
    """(density, branch-merge ratio, back-reference depth)."""
    one = lambda c: F.when(c, 1).otherwise(0)
    edges = F.aggregate(F.transform("marks", lambda m, j: one(m["causal"] & (j > 0)) + one(m["backref"]) + one(m["branch"]) + one(m["merge"])), F.lit(0), lambda s, x: s + x)
    merges = F.greatest(_count(F.col("marks"), lambda m: m["merge"]), F.lit(1)).cast("double")
    enough = _n() >= 3
    depth = F.when(enough & F.exists("marks", lambda m: m["backref"]), F.lit(float(STEP_BACK))).otherwise(F.lit(0.0))
    return F.when(enough, edges / _n().cast("double")), F.when(enough, _count(F.col("marks"), lambda m: m["branch"]) / merges), depth


def _bigrams() -> Column:
    """Bigrams of the actions, repeats in a row left out; null below five paragraphs or three bigrams."""

    def of(actions: Column) -> Column:
        run = F.filter(F.transform(actions, lambda a, i: F.when((i == 0) | (a != F.get(actions, i - 1)), a)), lambda a: a.isNotNull())
        return t.let(run, lambda r: F.when(F.size(r) >= 4, F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.concat_ws(">", F.get(r, i), F.get(r, i + 1)))))

    return F.when(_n() >= 5, t.let(F.transform("marks", lambda m: m["action"]), of))


def action_bigrams() -> tuple[Column, Column, Column]:
    """(entropy, routinization, share of the three commonest) of the bigrams of actions."""
    sorted_counts = t.let(_bigrams(), lambda p: F.reverse(F.array_sort(F.transform(F.array_distinct(p), lambda b: F.size(F.filter(p, lambda x: x == b)).cast("double")))))

    def figures(counts: Column) -> Column:
        return t.let(_sum(counts), lambda n: F.struct(
            (-F.aggregate(counts, F.lit(0.0), lambda s, c: s + c / n * F.log2(c / n))).alias("entropy"),
            F.log2(F.least(n, F.lit(36.0))).alias("most"),
            (_sum(F.slice(counts, 1, 3)) / n).alias("top"),
        ))

    f = F.when(sorted_counts.isNotNull(), t.let(sorted_counts, figures))
    routine = t.let(f, lambda x: 1 - x["entropy"] / F.when(x["most"] > 0, x["most"]).otherwise(F.lit(1.0)))
    return f["entropy"], routine, f["top"]


def format_switch_density() -> Column:
    switches = _count(F.transform(F.sequence(F.lit(1), _n() - 1), lambda i: F.get("marks", i)["format"] != F.get("marks", i - 1)["format"]), lambda x: x)
    return F.when(_n() >= 3, switches / (_n() - 1).cast("double"))


def inertia_index(ear: Column, oed: Column, slope: Column) -> Column:
    return ear / (oed + F.lit(0.01)) * slope


def compression(column: str = "reasoning", words: str | None = None) -> Column:
    """``words`` names a column with the count of words, if there is one."""
    hits = t.count_matches(column, lx.LOGIC)
    return t.let(F.col(words) if words else t.count_matches(column, lx.WORD), lambda n: F.when(n > 0, hits / n.cast("double")))


def noise_ratio(column: str = "reasoning", words: str | None = None) -> Column:
    """``words`` as in compression."""
    hits = t.count_matches(column, lx.NOISE)
    return t.let(F.col(words) if words else t.count_matches(column, lx.WORD), lambda n: F.when(n > 0, F.lit(1000.0) * hits / n))


def edges() -> Column:
    """array of (src, dst) of the dependency graph, in order of dst; several of the same stay."""

    def of(m: Column, j: Column) -> Column:
        back = F.coalesce(m["step"], F.greatest(j - STEP_BACK, F.lit(0)))
        near = F.when((j > 0) & (m["causal"] | m["branch"] | m["merge"]), F.struct((j - 1).cast("int").alias("src"), j.cast("int").alias("dst")))
        far = F.when(m["backref"] & (back >= 0) & (back < j), F.struct(back.cast("int").alias("src"), j.cast("int").alias("dst")))
        return F.array_compact(F.array(near, far))

    return F.flatten(F.transform("marks", of))


def branching_sparsity() -> Column:
    """Mean out-degree of all but the last paragraph; the last one has no edges out."""
    return F.when(_n() >= 3, F.size(edges()) / (_n() - 1).cast("double"))


def pagerank(n: int, links: list[tuple[int, int]], damping: float = 0.85, rounds: int = 40) -> list[float]:
    """Ranks after a fixed number of rounds; nodes without links out give to all alike."""
    rank, out = [1.0 / n] * n, [0] * n
    for a, _ in links:
        out[a] += 1
    for _ in range(rounds):
        loose = sum(r for r, d in zip(rank, out, strict=True) if not d)
        new = [(1 - damping) / n + damping * loose / n] * n
        for a, b in links:
            new[b] += damping * rank[a] / out[a]
        rank = new
    return rank


def gini(values: Column) -> Column:
    """Gini coefficient of an array of doubles; null below two values, zero if they sum up to zero."""

    def of(v: Column) -> Column:
        n, total = F.size(v).cast("double"), _sum(v)
        rank_sum = _sum(F.transform(v, lambda x, i: (i + 1) * x))
        return F.when(n >= 2, F.when(total == 0, F.lit(0.0)).otherwise(2 * rank_sum / (n * total) - (n + 1) / n))

    return t.let(F.array_sort(values), of)


def gini_of(values: list[float]) -> float | None:
    """What gini is for arrays, for one list."""
    v, n, total = sorted(values), len(values), sum(values)
    if n < 2:
        return None
    return 2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * total) - (n + 1) / n if total else 0.0


@F.pandas_udf(T.StructType([T.StructField("pagerank", T.ArrayType(T.DoubleType())), T.StructField("ici", T.DoubleType())]))
def _ranks(n: pd.Series, links: pd.Series) -> pd.DataFrame:
    ranks = [pagerank(k, [(e["src"], e["dst"]) for e in x]) if k >= 4 else None for k, x in zip(n, links, strict=True)]
    return pd.DataFrame({"pagerank": ranks, "ici": [gini_of(r) if r else None for r in ranks]})


def concentration(df: DataFrame) -> DataFrame:
    """``df`` with ``pagerank`` and ``ici``, the Gini coefficient of the ranks; needs marks. Graphs are one text's.

    Null below four paragraphs.
    """
    return df.withColumn("__r", _ranks(_n(), edges())).withColumns({"pagerank": F.col("__r.pagerank"), "ici": F.col("__r.ici")}).drop("__r")


#: Words of texts, and shared words of critiques with other paragraphs, that ``_coupling`` holds at a time (one text or critique at least).
WORDS_AT_ONCE = 1 << 19
SHARED_AT_ONCE = 1 << 20


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most`` at most, or of one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - _starts(lengths)[:-1], lengths)


def _coupled(n: np.ndarray, per_para: np.ndarray, words: np.ndarray, critique: np.ndarray) -> np.ndarray:
    """Coupling of texts of ``n`` paragraphs each, these of ``per_para`` words each; NaN without critiques."""
    first, total, many = _starts(n), n.sum(), words.max(initial=0) + 1
    text = np.repeat(np.arange(len(n)), n)
    # (text, word, paragraph), each once: the list of each text's word's paragraphs.
    para = np.repeat(np.arange(total), per_para)
    key, para = np.divmod(np.unique((text[para] * many + words) * max(total, 1) + para), max(total, 1))
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
    counts = np.diff(np.append(begins, len(key)))
    size = np.bincount(para, minlength=total)
    by_para = np.argsort(para, kind="stable")
    own = _starts(size)
    place = np.arange(total) - first[text]
    critiques = np.flatnonzero(critique & (place > 0) & (size > 0))
    meets = np.bincount(para, weights=counts[group], minlength=total)[critiques] + n[text[critiques]]
    near_sum, near_n, far_sum, far_n = (np.zeros(len(n)) for _ in range(4))
    for a, b in _slices(meets, SHARED_AT_ONCE):
        c = critiques[a:b]
        t = text[c]
        at = _starts(n[t])
        mine = by_para[_places(own[c], size[c])]
        g = group[mine]
        who = np.repeat(np.repeat(np.arange(len(c)), size[c]), counts[g])
        other = para[_places(begins[g], counts[g])]
        shared = np.bincount(at[who] + other - first[t][who], minlength=at[-1])
        who, other = np.repeat(np.arange(len(c)), n[t]), _places(first[t], n[t])
        like = shared / np.maximum(size[c][who] + size[other] - shared, 1)
        like[other == c[who]] = 0
        close = (other < c[who]) & (other >= c[who] - WINDOW)
        np.add.at(near_sum, t[who[close]], like[close])
        near_n += np.bincount(t[who[close]], minlength=len(n))
        np.add.at(far_sum, t, np.bincount(who, weights=like, minlength=len(c)) / (n[t] - 1))
        far_n += np.bincount(t, minlength=len(n))
    with np.errstate(invalid="ignore"):
        return near_sum / near_n / np.maximum(far_sum / far_n, 0.001)


@F.arrow_udf(T.DoubleType())
def _coupling(words: pa.Array, critique: pa.Array) -> pa.Array:
    """critique_coupling of the words of each paragraph, in any order and number, and of whether it is a critique. The words go through Arrow as they lie, and count as numbers of a dictionary."""
    out = np.full(len(words), np.nan)
    rows = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
    words, critique = words.drop_null(), critique.filter(words.is_valid())
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    paras, flags = words.flatten(), critique.flatten().to_numpy(zero_copy_only=False).astype(bool)
    per_para = paras.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, to_para, to_word = paras.flatten(), _starts(n), _starts(per_para)
    for a, b in _slices(np.diff(to_word[to_para]), WORDS_AT_ONCE):
        p, q = to_para[a], to_para[b]
        ids = flat[to_word[p] : to_word[q]].dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out[rows[a:b]] = _coupled(n[a:b], per_para[p:q], ids, flags[p:q])
    return pa.array(out, from_pandas=True)


def critique_coupling() -> Column:
    """Likeness of critiques to the paragraphs before them, over that to all other paragraphs (the expectation of random ones).

    Comparing is quadratic in a text's paragraphs: it goes through lists of each word's paragraphs, in bounded pieces.
    """
    critique = F.transform("marks", lambda m: m["critique"])
    wanted = (_n() >= 4) & F.exists(F.slice(critique, F.lit(2), F.greatest(_n() - 1, F.lit(0))), lambda c: c)
    words = F.transform("paras", lambda p: t.all_matches(F.lower(p), lx.WORD))
    return _coupling(F.when(wanted, words), F.when(wanted, critique))


def critique_coupling_sampled(key: str = "doc_id") -> Column:
    """critique_coupling against DRAWS paragraphs drawn for each critique by a hash of the text's key, the critique's place and the draw; a draw of the critique itself counts for nothing."""

    def tied(s: Column) -> Column:
        def of(m: Column, j: Column) -> Column:
            def against(own: Column) -> Column:
                near = F.transform(F.slice(s, F.greatest(j - WINDOW, F.lit(0)) + 1, F.least(j, F.lit(WINDOW))), lambda x: t.jaccard(own, x))
                drawn = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda k: _drawn(key, j, k))
                far = F.transform(F.filter(drawn, lambda d: d != j), lambda d: t.jaccard(own, F.get(s, d)))
                return F.when(F.size(own) > 0, F.struct(near.alias("near"), far.alias("far")))

            return F.when(m["critique"] & (j > 0), t.let(F.get(s, j), against))

        def ratio(hits: Column) -> Column:
            near = _mean(F.flatten(F.transform(hits, lambda h: h["near"])))
            far = _mean(F.flatten(F.transform(hits, lambda h: h["far"])))
            return near / F.greatest(far, F.lit(0.001))

        return t.let(F.array_compact(F.transform("marks", of)), ratio)

    return F.when(_n() >= 4, t.let(F.transform("paras", t.token_set), tied))


def _drawn(key: str, j: Column, k: Column) -> Column:
    """A place among the paragraphs from the MD5 of key, place and draw."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), j.cast("string"), k.cast("string")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), _n()).cast("int")


def all_metrics(df: DataFrame, column: str = "reasoning", digits: int | None = 3) -> DataFrame:
    """``df`` with every metric rounded to ``digits``, or exact; ``ci`` is made of inputs of three digits, ``ci_exact`` of exact ones."""
    m = with_marks(df, column).withColumn("__words", t.count_matches(column, lx.WORD))
    density, ratio, depth = topology()
    entropy, routine, top = action_bigrams()
    cols = {
        "ccs": critique_coupling(), "pdd": dependency_depth(), "inertia_slope": inertia_slope(), "ear": early_assertion_rate(),
        "oed": overthrow_density(column), "rt_topology_density": density, "rt_branch_merge_ratio": ratio, "rt_back_ref_depth": depth,
        "rae_bigram_entropy": entropy, "rae_routinization": routine, "rae_dominant_bigram_ratio": top, "fsd": format_switch_density(),
        "ce": compression(column, "__words"), "nrr": noise_ratio(column, "__words"), "bsd": branching_sparsity(),
    }
    m = concentration(m.withColumns(cols))
    r = lambda c: F.round(F.col(c), 3)
    m = m.withColumn("ci", inertia_index(r("ear"), r("oed"), r("inertia_slope"))).withColumn("ci_exact", inertia_index(F.col("ear"), F.col("oed"), F.col("inertia_slope"))).drop("paras", "marks", "pagerank", "__words")
    return m if digits is None else m.withColumns({c: F.round(F.col(c), digits) for c in (*METRICS, "ci_exact", "rae_dominant_bigram_ratio")})


METRICS = (
    "ccs", "pdd", "inertia_slope", "ear", "oed", "rt_topology_density", "rt_branch_merge_ratio", "rt_back_ref_depth",
    "rae_bigram_entropy", "rae_routinization", "fsd", "ci", "ce", "nrr", "bsd", "ici",
)
