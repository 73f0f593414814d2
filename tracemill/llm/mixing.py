"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked until their sums over each
margin meet the targets; the ratio of a cell's raked to its own weight, relative to the
largest or scaled to a budget of tokens, is the probability with which each of its documents
is kept.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, inner_prefix

MARGINS = ("source", "lang", "topic")
#: Topics of documents by their tokens, a stand-in for tables that name no topic.
SHORT, LONG = 150, 1000
#: Raking ends when a round changes no cell by more than this share, or after so many rounds, with a warning that names the residuals.
TOLERANCE, ROUNDS = 1e-11, 30
#: Targets are the observed margins tempered by this power; 1 leaves them as they are, 0 levels them.
TEMPER = 0.85
#: Cells that are broadcast at most, some 10 MB.
BROADCAST_CELLS = 100_000


def n_tokens(text: Column) -> Column:
    """White-space separated tokens; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(tokens: Column) -> Column:
    return F.when(tokens < SHORT, F.lit("note")).when(tokens < LONG, F.lit("article")).otherwise(F.lit("essay"))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) of the MD5 of the id as text; a null id counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def cells_of(docs: DataFrame) -> DataFrame:
    """Token weight and documents of each cell; null margins form cells of their own, as ``(none)``."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("weight"), F.count(F.lit(1)).alias("docs"))


def tempered_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(margin, target): shares of the tokens, tempered and summing up to one."""
    sums = cells.groupBy(margin).agg(F.sum("weight").alias("w")).where("w > 0")
    powered = sums.select(margin, F.pow("w", F.lit(temper)).alias("p"))
    total = powered.agg(F.sum("p")).first()[0] or 1.0
    return powered.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``raked``: weights whose sums over each margin's values meet its targets.

    A round scales to every margin in turn, by sums that are combined before they are shuffled.
    Rounds go on until none of the cells changes by more than ``tolerance`` of itself or the
    whole; each is written to a checkpoint. Cells whose margin value has no target, or target
    zero, get weight zero. Targets that exclude each other never settle: after ``rounds`` the
    result stands, with a warning that names how far each margin is from its targets, as
    ``residuals`` tells of any result.
    """
    few = cells.count() <= BROADCAST_CELLS
    small = F.broadcast if few else lambda df: df
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    now = cells.withColumn("raked", F.col("weight") / F.lit(total))
    for margin, target in targets.items():
        now = now.join(small(target.select(margin, F.col("target").alias(f"target_{margin}"))), margin, "left")
    now = checkpointed(now)
    for _ in range(rounds):
        before = now.withColumn("before", F.col("raked"))
        for margin in targets:
            sums = before.groupBy(margin).agg(F.sum("raked").alias("s"))
            before = before.join(small(sums), margin)
            factor = F.when(F.col("s") > 0, F.coalesce(F.col(f"target_{margin}"), F.lit(0.0)) / F.col("s")).otherwise(F.lit(0.0))
            before = before.withColumn("raked", F.col("raked") * factor).drop("s")
        step = checkpointed(before)
        change = F.abs(F.col("raked") - F.col("before")) / F.greatest("raked", "before", F.lit(1e-12))
        moved = step.agg(F.max(change)).first()[0] or 0.0
        now = step.drop("before")
        if moved <= tolerance:
            break
    else:
        left = {r.margin: r.residual for r in residuals(now, targets).collect()}
        warnings.warn(f"after {rounds} rounds of raking, largest distances from targets: {left}", stacklevel=2)
    return now.drop(*(f"target_{m}" for m in targets))


def residuals(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, residual): the largest distance of a raked margin sum from its target, as a share of all weight."""
    out = []
    for margin, target in targets.items():
        sums = raked.groupBy(margin).agg(F.sum("raked").alias("s")).join(target, margin, "full")
        apart = F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))
        out.append(sums.agg(F.coalesce(F.max(apart), F.lit(0.0)).alias("residual")).select(F.lit(margin).alias("margin"), "residual"))
    return reduce(DataFrame.union, out)


def budget_scale(ratios: DataFrame, budget: float) -> float:
    """The factor c for which the sum of weight * min(1, c * ratio) is the budget; without end if all tokens are no more than that.

    A grid of factors is summed up in one pass over the cells, and narrowed three times.
    """
    facts = ratios.where("ratio > 0").agg(F.sum("weight"), F.min("ratio")).first()
    if facts[0] is None or facts[0] <= budget:
        return float("inf")
    low, high = 0.0, 1.0 / facts[1]
    for _ in range(4):
        grid = [low + (high - low) * i / 64 for i in range(65)]
        sums = ratios.agg(*(F.sum(F.col("weight") * F.least(F.lit(1.0), F.col("ratio") * F.lit(c))).alias(f"s{i}") for i, c in enumerate(grid))).first()
        at = max(i for i in range(65) if sums[i] <= budget)
        low, high = grid[at], grid[min(at + 1, 64)]
    return low


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with tokens and clear margins."""
    rows = docs.withColumn("tokens", n_tokens(F.col("text").cast("string")))
    none = F.lit("(none)")
    topic = F.coalesce(F.col("topic").cast("string"), none) if "topic" in docs.columns else topic_of(F.col("tokens"))
    return rows.withColumns({"source": F.coalesce(F.col("source").cast("string"), none), "lang": F.coalesce(F.col("lang").cast("string"), none), "topic": topic})


def chances(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """(source, lang, topic, probability) of each cell of ``rows``, as returned by with_cells.

    Without a ``budget`` of tokens the cell that its targets raise most has probability 1; with
    one, probabilities are scaled, up to 1, until the expected tokens meet it.
    """
    cells = checkpointed(cells_of(rows))
    targets = targets or {m: tempered_targets(cells, m) for m in MARGINS}
    raked = rake(cells, targets)
    raked = raked.withColumn("ratio", F.when(F.col("weight") > 0, F.col("raked") / F.col("weight")).otherwise(F.lit(0.0)))
    if budget is None:
        probability = F.col("ratio") / F.lit(raked.agg(F.max("ratio")).first()[0] or 1.0)
    else:
        scale = budget_scale(raked, budget)
        probability = F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)) if scale < float("inf") else (F.col("ratio") > 0).cast("double")
    return checkpointed(raked.select(*MARGINS, probability.alias("probability")))


def _small(cells: DataFrame) -> DataFrame:
    """``cells`` to be broadcast if they are few; Spark splits the large groups of a join otherwise."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every row of ``docs``.

    ``targets``: for each of source, lang and topic a table (margin, target) of shares; tempered
    observed shares where None. probability is 1 for the cell that its targets raise most, or
    scaled to a ``budget`` of tokens. A document without tokens weighs nothing in its cell but has the cell's probability; in a cell
    without any tokens that is 0. Null margins form cells of their own. Repeated rows stay and are
    kept alike; an empty table gives an empty result.
    """
    used = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    rows = checkpointed(with_cells(docs.select(used)).drop("text"))
    out = rows.join(_small(chances(rows, targets, budget)), list(MARGINS), "left")
    return out.select("doc_id", *MARGINS, "tokens", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` that mix keeps, with their own columns."""
    used = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    rows = checkpointed(with_cells(docs.select(used)).drop("text", "doc_id"))
    inner = inner_prefix(docs)
    chance = chances(rows, targets, budget).select(*(F.col(m).alias(inner + m) for m in MARGINS), F.col("probability").alias(inner + "p"))
    tokens = n_tokens(F.col("text").cast("string"))
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("(none)")) if "topic" in docs.columns else topic_of(tokens)
    keys = {m: F.coalesce(F.col(m).cast("string"), F.lit("(none)")) for m in MARGINS[:2]} | {"topic": topic}
    marked = docs.withColumns({inner + m: c for m, c in keys.items()})
    kept = marked.join(_small(chance), [inner + m for m in MARGINS]).where(uniform(F.col("doc_id")) < F.col(inner + "p"))
    return kept.select(docs.columns)
