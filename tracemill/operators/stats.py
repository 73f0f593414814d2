"""Rank tests, effect sizes, agreement and correlation over grouped tables.

Each takes a table and grouping columns ``by`` and returns a row for each group. Scores
have few levels, so ranks and pair comparisons go through counts of distinct values, which
shuffle a few rows for each task however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 5
#: Ranges that distinct values are cut into for running sums.
RANGES = 32


#: Terms of the series of the error function and the incomplete gamma function.
TERMS = 220


def two_sided_p(z: Column | str) -> Column:
    """Two-sided p of a standard normal score, 1 - erf(|z| / sqrt 2) by the series of positive terms; 0 beyond 8.

    The absolute error is some 1e-15.
    """
    x = F.abs(F.col(z) if isinstance(z, str) else z).cast("double") / math.sqrt(2)
    zero = F.struct(x.alias("term"), x.alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    erf = F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda s: s["sum"])
    return F.when(x.isNotNull(), F.when(x > 8 / math.sqrt(2), F.lit(0.0)).otherwise(F.greatest(1 - erf, F.lit(0.0))))


def chi2_p(x: Column, k: Column) -> Column:
    """Upper tail of chi-squared with k degrees of freedom, by the series of the incomplete gamma function; 0 beyond 80 k + 80."""
    a, h = k.cast("double") / 2, x.cast("double") / 2
    # gamma(a + 1) = a (a - 1) ... down to 1 or 1/2, the latter's value being sqrt pi
    steps = F.filter(F.sequence(F.lit(0), F.lit(400)), lambda i: a - i > 0.25)
    log_gamma = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log(a - i)) + F.when(F.pmod(k.cast("long"), F.lit(2)) == 1, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    first = F.exp(a * F.log(h) - h - log_gamma)
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * h / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    lower = F.aggregate(F.sequence(F.lit(1), F.lit(4 * TERMS)), zero, step, lambda s: s["sum"])
    return F.when(h <= 0, F.lit(1.0)).when(x > 80 * k + 80, F.lit(0.0)).otherwise(F.greatest(1 - lower, F.lit(0.0)))


def upper_median(c: str) -> Column:
    """The element at place n // 2 of the sorted values."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -({c}))")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column, least: int = 4) -> Column:
    """Correlation over rows where both are numbers; null below ``least`` rows or without variance."""
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
    a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.when(F.count_if(ok) >= least, r)


def signed_rank(df: DataFrame, diff: str, by: Sequence[str] = (), ties: str = "average", order: str | None = None, least: int = 6) -> DataFrame:
    """Wilcoxon signed-rank sums: by, n_nonzero, w_plus, w_minus, z (two_sided_p gives p of any of them); null sums below ``least`` nonzero differences.

    ``ties``: "average" gives equal sizes their mean rank and corrects the variance; "negative_first"
    ranks the negative ones of equal size below the positive; "input" ranks them by ``order``.
    """
    by = list(by)
    rows = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("__size", F.abs(F.col(diff)).cast("double"))
    sizes = rows.groupBy(*by, "__size").agg(F.count_if(F.col(diff) > 0).alias("p"), F.count_if(F.col(diff) < 0).alias("m"))
    sizes = counted_below(sizes, by, "__size", F.col("p") + F.col("m"), "s")
    p, m, s, t = F.col("p"), F.col("m"), F.col("s"), F.col("p") + F.col("m")
    if ties == "average":
        plus, minus = p * (s + (t + 1) / 2), m * (s + (t + 1) / 2)
    elif ties == "negative_first":
        plus, minus = p * (s + m) + p * (p + 1) / 2, m * s + m * (m + 1) / 2
    elif ties == "input":
        place = F.row_number().over(Window.partitionBy(*by, "__size").orderBy(order))
        own = rows.withColumn("r", place).groupBy(*by, "__size").agg(F.sum(F.when(F.col(diff) > 0, F.col("r")).otherwise(0)).alias("rp"), F.sum(F.when(F.col(diff) < 0, F.col("r")).otherwise(0)).alias("rm"))
        sizes = sizes.join(own, [*by, "__size"])
        plus, minus = p * s + F.col("rp"), m * s + F.col("rm")
    else:
        raise ValueError(f"unknown ties: {ties}")
    out = sizes.groupBy(*by).agg(F.sum(t).alias("n_nonzero"), F.sum(plus).cast("double").alias("w_plus"), F.sum(minus).cast("double").alias("w_minus"), F.sum(t * t * t - t).alias("__t"))
    n = F.col("n_nonzero").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - (F.col("__t") / 48.0 if ties == "average" else F.lit(0.0))
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(variance))
    enough = n >= least
    return out.select(*by, "n_nonzero", F.when(enough, F.col("w_plus")).alias("w_plus"), F.when(enough, F.col("w_minus")).alias("w_minus"), F.when(enough, z).alias("z"))


def cliffs_delta(df: DataFrame, value: str, side: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, delta, effect): (#a > b - #a < b) / (n_a n_b), ``side`` true for a and false for b; 0 if either is empty."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).withColumn("__a", side).where(F.col("__a").isNotNull())
    levels = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count_if("__a").alias("a"), F.count_if(~F.col("__a")).alias("b"))
    w = Window.partitionBy(*by)
    below = F.sum("b").over(w.orderBy("__v")) - F.col("b")
    levels = levels.withColumns({"below": below, "n_b": F.sum("b").over(w)})
    out = levels.groupBy(*by).agg(F.sum("a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum(F.col("a") * (F.col("below") - (F.col("n_b") - F.col("below") - F.col("b")))).alias("more"))
    delta = F.coalesce(ratio(F.col("more"), F.col("n_a") * F.col("n_b")), F.lit(0.0))
    return out.select(*by, delta.alias("delta")).withColumn("effect", effect_size(F.col("delta")))


def effect_size(delta: Column) -> Column:
    a = F.abs(delta)
    return F.when(a > 0.474, "large").when(a > 0.33, "medium").when(a > 0.147, "small").otherwise("negligible")


def agreement(a: str, b: str) -> dict[str, Column]:
    """n, exact_pct, within1_pct, mean_abs_diff and qwk of two integer scores, as aggregates."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    gap = F.when(both, F.abs(x - y))
    n = F.count(gap)
    return {"n": n, "exact_pct": ratio(100 * F.count_if(gap == 0), n), "within1_pct": ratio(100 * F.count_if(gap <= 1), n), "mean_abs_diff": F.avg(gap), "qwk": weighted_kappa(a, b)}


def weighted_kappa(a: str, b: str, levels: int = LEVELS, least: int = 1) -> Column:
    """Quadratic weighted kappa; pairs out of range count in n alone; null without expected disagreement or below ``least`` pairs."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    inside = both & x.between(0, levels - 1) & y.between(0, levels - 1)
    s = lambda e: F.sum(F.when(inside, e))
    k, n = F.count_if(inside).cast("double"), F.count_if(both).cast("double")
    expected = (s(x * x) * k + s(y * y) * k - 2 * s(x) * s(y)) / n
    kappa = 1 - F.try_divide(s((x - y) * (x - y)), F.nullif(expected, F.lit(0.0)))
    return F.when(n >= least, kappa)


def with_range(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``__part``: which of RANGES ranges of about equal counts a number falls into; 0 for values of other types.

    The cuts come from a scalar subquery, so they are found within the same job.
    """
    kind = dict(df.dtypes)[value]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        return df.withColumn("__part", F.lit(0))
    number = F.col(value).cast("double")
    cuts = df.agg(F.percentile_approx(number, [i / RANGES for i in range(1, RANGES)], 1000)).scalar()
    below = F.size(F.filter("__cuts", lambda c: c < number))
    return df.withColumn("__cuts", cuts).withColumn("__part", F.greatest(below, F.lit(0))).drop("__cuts")


def counted_below(levels: DataFrame, by: Sequence[str], value: str, count: Column, name: str) -> DataFrame:
    """``levels`` (one row for each ``value`` of a group) with ``name``: the counts of all lesser values of the group.

    Values are cut into ranges; sums of whole ranges come from a small table, and only sums within a
    range are running ones, so no task sorts a whole group of numbers. Values of other types stay
    in one range for each group.
    """
    by = list(by)
    levels = with_range(levels, value).withColumn("__count", count)
    ranges = levels.groupBy(*by, "__part").agg(F.sum("__count").alias("__all"))
    before = F.coalesce(F.sum("__all").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__p"), before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = F.coalesce(F.sum("__count").over(Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = levels.withColumn("__inside", inside).join(ranges, same)
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__count", "__inside", "__p", "__before", *(f"__by_{c}" for c in by))


def places(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its row number, from 0, in ``order`` within each group.

    The first column of ``order``, if it is a number, is cut into ranges that are counted one by one, so
    a group is spread over tasks however few groups there are.
    """
    by = list(by)
    ranged = with_range(df, order[0])
    sizes = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__part").alias("__p"), before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(offsets, same).withColumn(name, F.col("__before") + F.col("__inside")).select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), mode: str = "average", order: str | None = None) -> DataFrame:
    """(by, n, rho): "average" correlates mean ranks of ties; "ordinal" ranks ties by ``order`` and uses the rank differences. Null below two rows.

    Mean ranks go through counts of distinct values. Ordinal ranks need the place of every row, so rows
    are dealt out by ranges of their values; rows that share a value stay together.
    """
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if mode == "ordinal":
        ranked = rows.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(order).alias("__o"))
        for c, r in (("__x", "r0"), ("__y", "r1")):
            ranked = places(ranked, by, [c, "__o"], r)
        n, d = F.count(F.lit(1)).cast("double"), F.col("r0") - F.col("r1")
        rho = F.when(n >= 2, 1 - F.try_divide(6 * F.sum((d * d).cast("double")), n * (n * n - 1)))
        return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))
    ranked = rows.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = ranked.groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    weighted = ranked
    for c, r in (("__x", "r0"), ("__y", "r1")):
        levels = ranked.groupBy(*by, c).agg(F.sum("__n").alias("__t"))
        levels = counted_below(levels, by, c, F.col("__t"), "__s")
        levels = levels.select(*(F.col(b).alias(f"__k_{b}") for b in by), F.col(c).alias("__v"), (F.col("__s") + (F.col("__t") + 1) / 2).alias(r))
        same = F.col(c) == F.col("__v")
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
        weighted = weighted.join(levels, same).drop("__v", *(f"__k_{b}" for b in by))
    n = F.sum("__n").cast("double")
    s = lambda e: F.sum(F.col("__n") * e)
    mean = (n + 1) / 2  # of ranks
    a, b = F.col("r0"), F.col("r1")
    cov, va, vb = s(a * b) / n - mean * mean, s(a * a) / n - mean * mean, s(b * b) / n - mean * mean
    rho = F.when((n >= 2) & (va > 1e-12) & (vb > 1e-12), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    return weighted.groupBy(*by).agg(n.cast("long").alias("n"), rho.alias("rho"))


def mutual_information(x: str, y: str, least: int = 8) -> Column:
    """Bits shared by two 0/1 columns, over rows where both are set; null below ``least`` rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count_if(both).cast("double")
    at = lambda c: F.count_if(both & c).cast("double")
    total = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            joint, a, b = at((F.col(x) == i) & (F.col(y) == j)), at(F.col(x) == i), at(F.col(y) == j)
            total = total + F.when(joint > 0, joint / n * F.log2(F.try_divide(joint * n, a * b))).otherwise(0.0)
    return F.when(n >= least, total)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n, groups, h, p): H over mean ranks, corrected for ties, and its p by chi-squared."""
    rows = df.where(F.col(value).isNotNull())
    levels = rows.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("t"))
    levels = counted_below(levels, [], "__v", F.col("t"), "__s").withColumn("r", F.col("__s") + (F.col("t") + 1) / 2).drop("__s")
    tie = levels.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"), F.sum("t").alias("n"))
    sums = rows.groupBy(group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("c")).join(levels, "__v").groupBy(group).agg(F.sum(F.col("c") * F.col("r")).alias("rs"), F.sum("c").cast("double").alias("k"))
    h = sums.agg(F.sum(F.col("rs") * F.col("rs") / F.col("k")).alias("q"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n")
    out = h.withColumn("__one", F.lit(1)).join(tie.withColumn("__one", F.lit(1)), "__one")
    out = out.select(n.cast("long").alias("n"), "groups", F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("tie") / (n * n * n - n)).alias("h"))
    return out.withColumn("p", chi2_p(F.col("h"), F.col("groups") - 1))


def mann_whitney(df: DataFrame, value: str, side: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_a, n_b, u, z, p): rank-sum test of a (``side`` true) against b, mean ranks, variance corrected for ties; null z without both sides."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).withColumn("__a", side).where(F.col("__a").isNotNull())
    levels = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count_if("__a").alias("a"), F.count(F.lit(1)).alias("t"))
    levels = counted_below(levels, by, "__v", F.col("t"), "__s")
    t, a = F.col("t").cast("double"), F.col("a").cast("double")
    sums = levels.groupBy(*by).agg(F.sum("a").alias("n_a"), (F.sum("t") - F.sum("a")).alias("n_b"), F.sum(a * (F.col("__s") + (t + 1) / 2)).alias("r"), F.sum(t * t * t - t).alias("tie"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, u = na + nb, F.col("r") - na * (na + 1) / 2
    variance = na * nb / 12 * (n + 1 - F.try_divide(F.col("tie"), n * (n - 1)))
    z = F.when(variance > 0, (u - na * nb / 2) / F.sqrt(variance))
    return sums.select(*by, "n_a", "n_b", u.alias("u"), z.alias("z")).withColumn("p", two_sided_p("z"))


def chi_squared(df: DataFrame, row: str, column: str) -> DataFrame:
    """(n, dof, chi2, p) of the table of two categories, over rows where both are set."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    rows, cols = (cells.groupBy(x).agg(F.sum("k").alias(f"n_{x}")) for x in ("r", "c"))
    # sum (k - e)^2 / e over all cells, empty ones too, is n (sum k^2 / (n_r n_c) - 1)
    out = cells.join(rows, "r").join(cols, "c").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k") / (F.col("n_r") * F.col("n_c"))).alias("q"), ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("dof"))
    chi2 = F.when(F.col("dof") > 0, F.greatest(F.col("n") * (F.col("q") - 1), F.lit(0.0)))
    return out.select(F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), "dof", chi2.alias("chi2")).withColumn("p", F.when(F.col("chi2").isNotNull(), chi2_p(F.col("chi2"), F.col("dof"))))


def mcnemar(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, only_a, only_b, chi2, p) of paired 0/1 columns, with continuity correction; null chi2 without discordant pairs."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = df.where(both).groupBy(*by).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    out = out.withColumn("chi2", F.try_divide(gap * gap, (F.col("only_a") + F.col("only_b")).cast("double")))
    return out.withColumn("p", F.when(F.col("chi2").isNotNull(), chi2_p(F.col("chi2"), F.lit(1))))


def quartiles(c: str) -> dict[str, Column]:
    """Median and interquartile range, interpolated."""
    q = [F.expr(f"percentile({c}, {p})") for p in (0.25, 0.5, 0.75)]
    return {f"{c}_median": q[1], f"{c}_iqr": q[2] - q[0]}


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, kappa): unweighted agreement of two categories beyond chance; null if chance agrees wholly."""
    by = list(by)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.col("__a").cast("string").alias("v"), F.col("k").alias("x"), F.lit(0).alias("y")), F.struct(F.col("__b").cast("string").alias("v"), F.lit(0).alias("x"), F.col("k").alias("y"))))
    chance = cells.select(*by, sides.alias("s")).groupBy(*by, "s.v").agg(F.sum("s.x").cast("double").alias("x"), F.sum("s.y").cast("double").alias("y"))
    chance = chance.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    seen = cells.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("__a") == F.col("__b"), F.col("k")).otherwise(0)).cast("double").alias("same"))
    out = seen.join(chance, by) if by else seen.withColumn("__one", F.lit(1)).join(chance.withColumn("__one", F.lit(1)), "__one")
    n = F.col("n").cast("double")
    return out.select(*by, "n", F.try_divide(F.col("same") / n - F.col("e") / (n * n), F.nullif(1 - F.col("e") / (n * n), F.lit(0.0))).alias("kappa"))


def bootstrap_mean(df: DataFrame, value: str, key: str, by: Sequence[str] = (), rounds: int = 200, level: float = 0.95) -> DataFrame:
    """(by, n, mean, low, high): the percentile interval of the mean over ``rounds`` resamples.

    Each row stands in a resample as often as a Poisson draw with mean one says, taken from a hash of
    its key and the round, so resamples need neither a shuffle of rows nor a generator's state.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]

    def drawn(r: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), r.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
        return sum((F.when(u >= b, 1).otherwise(0) for b in below), F.lit(0))

    parts = rows.select(*by, F.col(value).cast("double").alias("__x"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), drawn)).alias("__r", "__k"))
    means = parts.groupBy(*by, "__r").agg(F.try_divide(F.sum(F.col("__x") * F.col("__k")), F.sum("__k").cast("double")).alias("m")).groupBy(*by)
    tail = (1 - level) / 2
    means = means.agg(F.expr(f"percentile(m, {tail})").alias("low"), F.expr(f"percentile(m, {1 - tail})").alias("high"))
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return own.join(means, by) if by else own.withColumn("__one", F.lit(1)).join(means.withColumn("__one", F.lit(1)), "__one").drop("__one")


def mean_and_spread(c: str, empty: float | None = 0.0) -> dict[str, Column]:
    """mean, median, sample deviation (0 for one row) and count; ``empty`` where there is no row."""
    x, none = F.col(c).cast("double"), F.lit(empty).cast("double")
    spread = F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0)).otherwise(none)
    return {f"{c}_mean": F.coalesce(F.avg(x), none), f"{c}_median": F.coalesce(F.median(x), none), f"{c}_std": spread, f"{c}_n": F.count(x)}
