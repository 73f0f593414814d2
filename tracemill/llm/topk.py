"""Exact top-k inner products over norm-sorted blocks of integer vectors.

Candidates are cut into zones by descending length. Each query first gets a bound from the
longest candidates: the k-th best score among them. Zones are then met from the longest on, in
waves that double: a block of queries meets only the zones whose longest vector can still
reach some query's bound (Cauchy-Schwarz), and after each wave every bound rises to the k-th
best score found so far. Inside a block the candidates come by descending length, a run at a
time, and a query is done at the first run that is too short for its running k-th best.
Vectors are rotated to the axes of the singular value decomposition: partial sums over ever
more leading axes plus the product of the residual lengths bound each score, and only pairs
whose bounds all reach the running k-th best are multiplied out exactly, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .vectors import finite, matrix

#: Candidates in a block, queries in a block, longest candidates for the first bounds, all at most.
BLOCK, QUERIES, LONGEST, QUANTILES = 4096, 256, 2048, 1024
#: Leading axes of the partial sums, and candidates of a run.
LEADS, RUN = (8, 24), 1024
NONE = np.iinfo(np.int64).min
#: Scores whose terms could exceed this aren't left to double precision.
EXACT = float(1 << 52)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact within 64 bits."""
    most = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _gram_batches(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = matrix(batch.column("v").slice(i, 4096), dim)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "s"])

    return run


def _bound_batches(k: int, dim: int, ids: np.ndarray, longest: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                own = part.column("vec_id").to_numpy()
                scores = _product(matrix(part.column("v"), dim, np.int64), longest)
                scores[own[:, None] == ids[None, :]] = NONE
                if len(ids) >= k:
                    bound = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    bound = np.full(len(own), NONE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bound)], names=[*part.schema.names, "bound"])

    return run


def search(k: int, qx: np.ndarray, qid: np.ndarray, bound: np.ndarray, cx: np.ndarray, cid: np.ndarray, axes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids, scores) of each query's candidates that can be among its k best, given its bound; k at most."""
    cut = np.unique([min(n, axes.shape[0]) for n in LEADS])
    order = np.argsort(-np.square(cx.astype(float)).sum(1), kind="stable")
    cx, cid = cx[order], cid[order]
    cy, qy = (x.astype(float) @ axes for x in (cx, qx))
    cn, qn = (np.sqrt(np.square(y).sum(1)) for y in (cy, qy))
    rest = [(np.sqrt(np.square(qy[:, n:]).sum(1)), np.sqrt(np.square(cy[:, n:]).sum(1))) for n in cut]
    none = np.empty(0, np.int64)
    ids, scores = [none] * len(qid), [none] * len(qid)
    bound = bound.astype(float)
    bound[bound == float(NONE)] = -np.inf
    for i in range(0, len(cid), RUN):
        run = slice(i, i + RUN)
        # lengths only fall from here on, so queries that this run can't serve are done
        slack = 1e-9 * qn * cn[i] + 1e-6 + 1e-12 * np.where(np.isfinite(bound), np.abs(bound), 0.0)
        live = np.flatnonzero(qn * cn[i] + slack >= bound)
        if not len(live):
            break
        part = np.zeros((len(live), len(cid[run])))
        hold, begin = qid[live][:, None] != cid[run][None, :], 0
        for n, (qr, cr) in zip(cut, rest, strict=True):
            part += qy[live, begin:n] @ cy[run, begin:n].T
            hold &= part + qr[live][:, None] * cr[run][None, :] + slack[live][:, None] >= bound[live][:, None]
            begin = n
            if not hold.any():
                break
        for r in np.flatnonzero(hold.any(1)):
            q, left = live[r], i + np.flatnonzero(hold[r])
            got = np.concatenate([scores[q], _product(qx[q : q + 1], cx[left])[0]])
            who = np.concatenate([ids[q], cid[left]])
            best = _best(k, got, who)
            ids[q], scores[q] = who[best], got[best]
            if len(best) == k:
                bound[q] = max(bound[q], float(got[best[-1]]))
    return ids, scores


def _search_batches(k: int, dim: int, axes: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                item = batch.slice(r, 1)
                c, q = item.column("cands").flatten(), item.column("queries").flatten()
                c = {f.name: c.field(n) for n, f in enumerate(c.type)}
                q = {f.name: q.field(n) for n, f in enumerate(q.type)}
                qid = q["vec_id"].to_numpy()
                ids, scores = search(k, matrix(q["v"], dim, np.int64), qid, q["bound"].to_numpy(), matrix(c["v"], dim, np.int64), c["vec_id"].to_numpy(), axes)
                if sum(map(len, ids)):
                    cols = (np.repeat(qid, [len(x) for x in ids]), np.concatenate(ids), np.concatenate(scores))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["query_id", "vec_id", "score"])

    return run


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a long; rows that take no part are left out."""
    rows = vectors.where(finite("embedding") & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _long_ones(rows: DataFrame, n: int) -> list[Row]:
    """At most LONGEST of the longest of ``n`` rows, for first bounds only: any rows give right bounds, longer ones better.

    Rows under a quantile of the lengths are left out before any task ranks its own, and one
    task gathers the rest: the driver gets LONGEST rows in all, not that many of each partition.
    """
    share = max(LONGEST / max(1, n), 2e-4)  # the quantile's own error is 1e-4
    if share < 1:
        rows = rows.where(F.col("norm") >= rows.select(F.percentile_approx("norm", 1 - share, 10000)).first()[0])
        many = math.ceil(rows.count() / (2 * LONGEST))
        if many > 2:  # equal lengths
            rows = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(many)) == 0)
    return rows.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).repartition(1).collect()


def top_k(vectors: DataFrame, k: int = 10, query_modulus: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of every query.

    ``vectors``: (vec_id, embedding). Queries: rows whose vec_id is divisible by
    ``query_modulus``; candidates: all rows with another vec_id. Ties go to the smaller
    vec_id; repeated rows are candidates of their own, and query rows with one id share one ranking. Vectors that are null or hold null
    or non-finite components, and rows without a vec_id, take no part; empty vectors are
    zero, shorter ones padded with zeros. Fewer candidates give fewer rows; an empty table
    none. Scores are exact while they fit 64 bits.
    """
    rows = checkpointed(integers(vectors).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim = facts[0], max(1, facts[1] or 1)
    gram = np.zeros(dim * dim)
    # dim^2 sums, whatever the number of rows is.
    for cell, s in rows.select("v").mapInArrow(_gram_batches(dim), "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        gram[cell] = s
    axes = np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()
    longest = _long_ones(rows, n)
    ids = np.array([r.vec_id for r in longest], np.int64)
    top = np.zeros((len(longest), dim), np.int64)
    for i, r in enumerate(longest):
        top[i, : len(r.v)] = r.v
    queries = rows.where(F.col("vec_id") % query_modulus == 0).select("vec_id", "v", "norm")
    queries = queries.mapInArrow(_bound_batches(k, dim, ids, top), "vec_id long, v array<long>, norm double, bound long")
    queries = checkpointed(queries)

    def needed(bound: Column, norm: Column) -> Column:
        """The least length of a candidate that can reach a query's bound."""
        return F.when((bound == NONE) | (norm <= 0), F.lit(0.0)).otherwise(F.greatest(bound / norm, F.lit(0.0)))

    def edges(df: DataFrame, by: str, count: int, size: int) -> list[float]:
        """Cuts of ``by`` into zones of about ``size`` rows."""
        parts = min(QUANTILES, max(1, count // size))
        if parts == 1:
            return []
        return sorted(set(df.select(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10000)).first()[0] or []))

    def zone(by: str, cuts: list[float]) -> Column:
        """Number of cuts below a value."""
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(by))) if cuts else F.lit(0)

    def dealt(df: DataFrame, by: str, cuts: list[float], size: int) -> DataFrame:
        """Blocks of about ``size`` rows: zones of near values, large ones dealt out by a hash."""
        df = df.withColumn("zone", zone(by, cuts))
        split = df.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("split"))
        df = df.join(F.broadcast(split), "zone")  # QUANTILES rows at most
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("split")).cast("int"))

    by_norm = edges(rows, "norm", n, BLOCK)
    cands = checkpointed(dealt(rows, "norm", by_norm, BLOCK).groupBy("zone", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("cands")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    high, wide, asking = len(by_norm), 1, queries.count()
    while asking and high >= 0:
        low = max(0, high - wide + 1)
        now = queries.withColumn("need", needed(F.col("bound"), F.col("norm")) * (1 - 1e-9))
        # Queries whose needed length lies over these zones, and so over all later ones, are done.
        now = now.where(zone("need", by_norm) <= high)
        by_need = edges(now, "need", asking, QUERIES)
        asked = dealt(now, "need", by_need, QUERIES).groupBy("zone", "part").agg(F.min("need").alias("least"), F.collect_list(F.struct("vec_id", "v", "bound")).alias("queries"))
        # A block of queries meets the zones from the one that holds the least length it needs on.
        first = F.greatest(zone("least", by_norm), F.lit(low))
        # Never broadcast: sizes are judged by the queries before they are repeated for each zone.
        met = asked.select("queries", F.explode(F.sequence(first, F.lit(high))).alias("zone")).join(cands.hint("merge"), "zone").select("cands", "queries")
        found = best.union(met.mapInArrow(_search_batches(k, dim, axes), "query_id long, vec_id long, score long"))
        best = checkpointed(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"))
        high, wide = low - 1, 2 * wide
        if high >= 0:
            reached = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
            # Repeated query rows share their results.
            raised = F.when(F.col("n") == k, F.greatest("bound", "least")).otherwise(F.col("bound"))
            queries = checkpointed(queries.join(reached, "vec_id", "left").select("vec_id", "v", "norm", raised.alias("bound")))
    ranked = best.withColumn("rank", F.row_number().over(w))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
