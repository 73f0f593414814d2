"""Toxicity by maximum-scoring segments of token log-odds.

Every token that enough toxic texts hold gets the log-odds of standing in toxic rather than
clean labelled texts, with a Dirichlet prior on its counts, shrunk by its own variance towards
none, less a small drift. A linear-time scan finds every maximal scoring segment of a text.
Segment scores are put on an extreme-value scale: with lambda the root of the background's
score equation, and K from the best segments of clean texts, E = K n exp(-lambda S) clean
segments that good are to be expected in n tokens. The E-values of a text's segments are
aggregated by a logistic fit. Background and fit see each text by the odds of the other folds.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, text_slices

#: Labelled texts of either class that are learned from at most, all of each; folds they are dealt to.
SAMPLE, FOLDS = 5000, 10
#: Pseudo-count of a token in texts of a class and outside, variance of log-odds a priori, cost of a token, least toxic texts with a scored one.
PRIOR, SPREAD, DRIFT, LEAST = 0.5, 4.0, 2.0, 3
#: A token without a score counts as its longest prefix of these lengths that has one.
PREFIXES = (7, 6, 5, 4)
SIGNIFICANT = 0.05
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def marks(words: list[str]) -> set[str]:
    """Distinct tokens of a text and their prefixes."""
    bag = set(words)
    return bag | {w[:k] + "*" for w in bag for k in PREFIXES if len(w) > k}


class Scores(dict):
    """Score of each token that has one; any other one falls back to prefixes, then to the drift."""

    def __missing__(self, token: str) -> float:
        for k in PREFIXES:
            if len(token) > k and (s := self.get(token[:k] + "*")) is not None:
                return s
        return -DRIFT


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by the linear-time scan of cumulative sums.

    Every candidate keeps the sum left of it and at its end; a new one joins to the latest
    candidate whose left sum is lower if that one's end sum is lower too.
    """
    sums = list(itertools.accumulate(scores, initial=0.0))
    kept: list[tuple[int, int, float, float]] = []
    before: list[int] = []  # for each candidate, the latest one with a lower left sum
    for i, s in enumerate(scores):
        if s <= 0:
            continue
        begin, left, right = i, sums[i], sums[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = before[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((begin, i + 1, left, right))
                before.append(j)
                break
            begin, left = kept[j][0], kept[j][2]
            del kept[j:], before[j:]
    return [(b, e, r - x) for b, e, x, r in kept]


@dataclass
class Model:
    scores: Scores = field(default_factory=Scores)
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0, 0.0]))

    def evidence(self, text: str | None) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """Segments as (begin, end, ln E) in tokens, and the features of the text."""
        words = tokens(text)
        found = segments(list(map(self.scores.__getitem__, words)))
        logs, x = self.features([s for _, _, s in found], len(words))
        return [(b, e, v) for (b, e, _), v in zip(found, logs, strict=True)], x

    def features(self, found: list[float], n: int) -> tuple[list[float], np.ndarray]:
        """ln E of each segment score in a text of ``n`` tokens; one, the best, the sum and the density of the significant ones."""
        base = self.log_k + math.log(max(1, n))
        logs = [base - self.rate * s for s in found]
        good = [-x for x in logs if x < math.log(SIGNIFICANT)]
        return logs, np.array([1.0, max(-5.0, min(-min(logs, default=base), 40.0)) / 10, math.log1p(sum(good)), math.log1p(1000.0 * len(good) / max(50, n))])

    def score(self, text: str | None) -> float:
        z = float(self.weights @ self.evidence(text)[1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Every significant passage of a text: (begin, end) in code points of the lower-cased text, and E."""
        places = [m.span() for m in WORD.finditer((text or "").lower())]
        return [(places[b][0], places[e - 1][1], math.exp(x)) for b, e, x in self.evidence(text)[0] if x < math.log(SIGNIFICANT)]


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Scores of tokens that y1 of n1 toxic and y0 of n0 clean texts hold."""
    a, b = y1 + PRIOR, y0 + PRIOR
    odds = np.log(a / (n1 + 2 * PRIOR - a)) - np.log(b / (n0 + 2 * PRIOR - b))
    return odds * SPREAD / (SPREAD + 1 / a + 1 / b) - DRIFT


@dataclass
class Counts:
    """Texts with each mark, by fold and class: (marks, FOLDS, 2), and texts of each fold and class."""

    marks: list[str]
    held: np.ndarray
    texts: np.ndarray

    def scores(self, without: int | None = None) -> Scores:
        """Scores from all folds, or from all but one."""
        held, n = self.held.sum(1), self.texts.sum(0)
        if without is not None:
            held, n = held - self.held[:, without], n - self.texts[without]
        kept = np.flatnonzero(held[:, 1] >= LEAST)
        odds = log_odds(held[kept, 1].astype(float), held[kept, 0].astype(float), float(n[1]), float(n[0]))
        return Scores(zip((self.marks[i] for i in kept), odds.tolist(), strict=True))


def rate_of(scores: dict[float, int]) -> float:
    """The positive root of mean(exp(rate * score)) = 1, for scores and how often they stand in clean texts."""
    values, n = np.array(list(scores), float), np.array(list(scores.values()), float)
    if not len(values) or values.max() <= 0 or (values * n).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: (n * np.exp(np.minimum(x * values, 700))).sum() / n.sum() - 1
    while f(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def log_k_of(best: np.ndarray, n: np.ndarray, rate: float) -> float:
    """ln K by the mean of a Gumbel distribution, from the best segment scores of clean texts of n > 0 tokens."""
    return float(np.mean(rate * best - np.log(n))) - 0.5772156649 if len(n) else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge fit by Newton steps, halved until the loss falls."""
    b, ridge = np.zeros(x.shape[1]), np.array([1e-3, *[0.1] * (x.shape[1] - 1)])
    loss = lambda b: (w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + (ridge * b * b).sum() / 2
    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * b)
        size = 1.0
        while size > 1e-9 and (new := loss(b + size * step)) > now:
            size /= 2
        if size <= 1e-9 or now - new < 1e-9:
            break
        b, now = b + size * step, new
    return b


def aggregated(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of the features, with toxic texts counted as a share of all."""
    now = y.mean()
    weight = np.where(y == 1, share / max(1e-9, now), (1 - share) / max(1e-9, 1 - now))
    return _logistic(x, y.astype(float), weight)


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """The model of labelled texts, dealt to folds in turn; ``share``: of toxic ones among all labelled, if the texts are dealt otherwise.

    With one class only, every text scores next to 0. ``train`` does the same on executors.
    """
    y, fold = np.array(toxic, int), np.arange(len(toxic)) % FOLDS
    if not len(y) or y.all() or not y.any():
        return Model()
    words, seen, n = [tokens(t) for t in texts], {}, np.zeros((FOLDS, 2), np.int64)
    np.add.at(n, (fold, y), 1)
    for w, f, k in zip(words, fold, y, strict=True):
        for m in marks(w):
            seen.setdefault(m, np.zeros((FOLDS, 2), np.int64))[f, k] += 1
    names = sorted(m for m, c in seen.items() if c[:, 1].sum() >= LEAST)
    counts = Counts(names, np.array([seen[m] for m in names]).reshape(-1, FOLDS, 2), n)
    other = [counts.scores(f) for f in range(FOLDS)]
    values = [list(map(other[f].__getitem__, w)) for w, f in zip(words, fold, strict=True)]
    found = [[s for _, _, s in segments(v)] for v in values]
    model = Model(counts.scores(), rate_of(Counter(round(x, 3) for v, k in zip(values, y, strict=True) if not k for x in v)))
    clean = [i for i in range(len(y)) if not y[i] and words[i]]
    model.log_k = log_k_of(np.array([max(found[i], default=0.0) for i in clean]), np.array([len(words[i]) for i in clean]), model.rate)
    x = np.array([model.features(s, len(w))[1] for s, w in zip(found, words, strict=True)])
    model.weights = aggregated(x, y, float(y.mean()) if share is None else share)
    return model


def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, cell, n): texts with each mark, by fold and class, summed up within a slice."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            seen: Counter[tuple[str, int]] = Counter()
            for t, f, k in zip(*(part.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
                seen.update((m, 2 * f + k) for m in marks(tokens(t)))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["mark", "cell", "n"])


def _segment_batches(held):  # noqa: ANN001, ANN202
    """(toxic, n, found, values, times): tokens and segment scores of each text; token scores of clean ones, rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other: dict[int, Scores] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for t, f, k in zip(*(part.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
                    if f not in other:
                        other[f] = held.value.scores(f)
                    scores = list(map(other[f].__getitem__, tokens(t)))
                    seen = Counter() if k else Counter(round(x, 3) for x in scores)
                    for to, x in zip(out, (k, len(scores), [s for _, _, s in segments(scores)], list(seen), list(seen.values())), strict=True):
                        to.append(x)
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["toxic", "n", "found", "values", "times"])

    return run


def _feature_batches(rate: float, log_k: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Model(rate=rate, log_k=log_k)
        for batch in batches:
            x = np.array([scale.features(s, n)[1] for s, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist(), strict=True)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, i].copy()) for i in range(1, 4))], names=["toxic", "x1", "x2", "x3"])

    return run


def train(docs: DataFrame, labelled: DataFrame) -> Model:
    """Fit on the whole texts of a bounded sample: the SAMPLE ids of either class of ``labelled`` (doc_id, toxic) with the least hashes.

    Texts are counted on executors; the driver gets the counts of marks that LEAST toxic texts
    hold, a histogram of rounded scores and four numbers for each text. An id with several labels
    counts as toxic if one of them says so; null labels, ids and texts say nothing; of several
    texts with one id the least counts. Without labels of both classes every text scores next to 0.
    """
    labels = labelled.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = bounded_sample(labels, "toxic", F.xxhash64("doc_id"), SAMPLE)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    # SAMPLE ids of either class, so they can be broadcast; their texts are written once and read three times.
    rows = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = checkpointed(rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.fold, r.toxic] = r.n
    if not sizes.sum(0).all():
        return Model()
    cells = texts.mapInArrow(_mark_batches, "mark string, cell int, n long").groupBy("mark")
    cells = cells.agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)))
    got = cells.where(sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS)), F.lit(0)) >= LEAST).orderBy("mark").toArrow()
    held = np.stack([got.column(f"c{c}").to_numpy() for c in range(2 * FOLDS)], 1).reshape(-1, FOLDS, 2)
    counts = Counts(got.column("mark").to_pylist(), held, sizes)
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # marks of the bounded sample
    found = checkpointed(texts.mapInArrow(_segment_batches(shared), "toxic int, n long, found array<double>, values array<double>, times array<long>"))
    pairs = found.select(F.explode(F.arrays_zip("values", "times")).alias("e")).groupBy("e.values").agg(F.sum("e.times").alias("k")).collect()
    model = Model(counts.scores(), rate_of({r[0]: r[1] for r in sorted(pairs)}))
    clean = found.where("toxic = 0 and n > 0").select(F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best"), "n").orderBy("n", "best").toArrow()
    model.log_k = log_k_of(clean.column("best").to_numpy(), clean.column("n").to_numpy(), model.rate)
    rows = found.mapInArrow(_feature_batches(model.rate, model.log_k), "toxic int, x1 double, x2 double, x3 double").orderBy("toxic", "x1", "x2", "x3").toArrow()
    x = np.stack([np.ones(rows.num_rows), *(rows.column(f"x{i}").to_numpy() for i in (1, 2, 3))], 1)
    model.weights = aggregated(x, rows.column("toxic").to_numpy(), n.get(1, 0) / max(1, sum(n.values())))
    return model


def assess(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, passages) of every row of ``docs`` (doc_id, text), whole texts.

    passages: (begin, end, e_value) of every significant passage, places in code points of the
    lower-cased text. Null and empty texts score like texts without any scored token; repeated
    rows stay; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most the tokens of the bounded sample
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores, spans = [], []
                for t in part.column("text").to_pylist():
                    found, x = held.value.evidence(t)
                    z = float(held.value.weights @ x)
                    scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                    good = any(e < math.log(SIGNIFICANT) for _, _, e in found)
                    spans.append([{"begin": b, "end": e, "e_value": v} for b, e, v in held.value.passages(t)] if good else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<begin:int,end:int,e_value:double>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
