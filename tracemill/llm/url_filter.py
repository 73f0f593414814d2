"""URL filter by the ratio of two character language models.

Rules accept or reject hosts and paths. All urls they decide train two smoothed
variable-order Markov models, one of accepted and one of rejected urls: the probability
of a character backs off from the longest context that was seen to shorter ones (Witten-
Bell interpolation). The other urls are judged by the difference of both models' log-
likelihoods per character, calibrated on a fifth of the decided urls, by models of the rest.

The models stay tables: a character and the ORDER bytes before it make a window, and the
counts of windows hold those of all shorter contexts. ``fit`` makes the same models from
lists of urls in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import counted_below, places
from .common import checkpointed, text_slices

#: (verdict, host, path): the longest that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Longest context in bytes.
ORDER = 5
#: Bounds of the urls that were once learned from. They cut nothing any more; tests name them.
SAMPLE, LONGEST = 5000, 4096
ALPHABET = 256
#: Urls and bytes of a block that is scored at once, and windows whose ratios are worked out at once, about.
BLOCK, BLOCK_BYTES, WINDOWS = 4096, 1 << 18, 1 << 19
#: Kinds of urls: accepted and rejected ones, learned or held out for the threshold, and those no rule decides.
ACCEPTED, ACCEPTED_HELD, REJECTED, REJECTED_HELD, UNDECIDED = range(5)


class Markov:
    """Counts of bytes by the contexts of up to ORDER bytes before them, as sorted arrays of packed keys."""

    def __init__(self, urls: list[bytes]) -> None:
        self.contexts, self.pairs = [], []
        for order in range(ORDER + 1):
            keys = np.concatenate([self.keys(u, order) for u in urls]) if urls else np.empty(0, np.uint64)
            pair, n = np.unique(keys, return_counts=True)
            context, first, types = np.unique(pair >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            self.pairs.append((pair, n.astype(float)))
            self.contexts.append((context, total.astype(float), types.astype(float)))

    @staticmethod
    def keys(url: bytes, order: int) -> np.ndarray:
        """The context and byte of every place: order + 1 bytes, packed; zero bytes stand before the url, one ends it."""
        data = np.frombuffer(b"\0" * order + url + b"\0", np.uint8).astype(np.uint64)
        out = np.zeros(len(url) + 1, np.uint64)
        for k in range(order + 1):
            out = (out << np.uint64(8)) | data[k : k + len(out)]
        return out

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log_likelihood(self, url: bytes) -> float:
        p = np.full(len(url) + 1, 1.0 / ALPHABET)
        for order in range(ORDER + 1):
            keys = self.keys(url, order)
            (context, total, types), (pair, n) = self.contexts[order], self.pairs[order]
            at, seen = self._find(context, keys >> np.uint64(8))
            if not seen.any():
                break
            i, has = self._find(pair, keys)
            count = np.where(has, n[i], 0.0)
            p = np.where(seen, (count + types[at] * p) / (total[at] + types[at]), p)
        return float(np.log(p).sum())


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def difference(self, url: str) -> float:
        """Log-likelihood ratio per character, high for accepted-like urls."""
        data = url.encode("utf-8", "surrogatepass")
        return (self.accepted.log_likelihood(data) - self.rejected.log_likelihood(data)) / (len(data) + 1)


def fit(accepted: list[str], rejected: list[str]) -> Model | None:
    """Models of both samples; every fifth url calibrates the threshold only. None if a verdict has no url.

    The threshold halves the gap at which the fewest calibration urls fall on the wrong side, both verdicts weighing the same.
    """
    if not accepted or not rejected:
        return None
    def encode(x: list[str]) -> list[bytes]:
        return [u.encode("utf-8", "surrogatepass") for u in x]

    part = Model(Markov(encode([u for i, u in enumerate(accepted) if i % 5])), Markov(encode([u for i, u in enumerate(rejected) if i % 5])))
    d = np.array([part.difference(u) for u in accepted[::5] + rejected[::5]])
    y = np.repeat([1.0, 0.0], [len(accepted[::5]), len(rejected[::5])])
    order = np.argsort(d, kind="stable")
    d, y = d[order], y[order]
    # accepted urls under each cut plus rejected ones from it on, times both numbers of urls
    wrong = np.append(0, np.cumsum(y)) * (1 - y).sum() + ((1 - y).sum() - np.append(0, np.cumsum(1 - y))) * y.sum()
    k = int(np.argmin(wrong))
    low, high = d[k - 1] if k else d[0] - 1, d[k] if k < len(d) else d[-1] + 1
    return Model(Markov(encode(accepted)), Markov(encode(rejected)), float((low + high) / 2))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of a host and path, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def windows(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows of all urls as ``Markov.keys`` packs them at ORDER, their number for each url)."""
    off = urls.offsets.to_numpy().astype(np.int64) if isinstance(urls, pa.LargeBinaryArray) else np.frombuffer(urls.buffers()[1], np.int32)[urls.offset : urls.offset + len(urls) + 1].astype(np.int64)
    data, sizes = np.frombuffer(urls.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], np.diff(off)
    start = (off[:-1] - off[0]) + np.arange(len(sizes)) * (ORDER + 1)
    padded = np.zeros(len(data) + len(sizes) * (ORDER + 1), np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * (ORDER + 1) + ORDER, sizes)] = data
    n = sizes + 1
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | padded[at + k]
    return out, n


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Urls with the number of their block."""
    block = TaskContext.get().partitionId() << 32
    for part in (part for whole in batches for part in text_slices(whole, "url", BLOCK_BYTES)):
        for i in range(0, part.num_rows, BLOCK):
            rows = part.slice(i, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), *rows.columns], names=["block", "url", "kind"])
            block += 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each window by the kind of url, 1 in the last if a score needs it."""
    for part in (part for whole in batches for part in text_slices(whole, "url")):
        found, n = windows(part.column("url"))
        kind = np.repeat(part.column("kind").to_numpy(), n)
        keys, at = np.unique(found, return_inverse=True)
        counts = [np.bincount(at[kind == k], minlength=len(keys)) for k in range(UNDECIDED + 1)]
        asked = (counts[ACCEPTED_HELD] + counts[REJECTED_HELD] + counts[UNDECIDED] > 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *counts[:UNDECIDED], asked)], names=["w", "c0", "c1", "c2", "c3", "asked"])


def _need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each block's urls, once for a batch."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                keys = np.unique(windows(batch.column("url").slice(i, j - i))[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), blocks[i])), pa.array(keys)], names=["block", "w"])


def _by_model(c: np.ndarray) -> np.ndarray:
    """Counts of the models that learned four fifths, accepted and rejected, and of those that learned all, from counts by kind."""
    return np.stack([c[:, ACCEPTED], c[:, REJECTED], c[:, ACCEPTED] + c[:, ACCEPTED_HELD], c[:, REJECTED] + c[:, REJECTED_HELD]], 1)


def _step(p: np.ndarray, pairs: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Probabilities one order on: ``pairs``, rising and with their counts by model, are whole contexts; ``which`` pair each row of ``p`` has."""
    context, first = np.unique(pairs >> 8, return_index=True)
    total, types = np.add.reduceat(counts, first), np.add.reduceat((counts > 0).astype(float), first)
    at = np.searchsorted(context, pairs[which] >> 8)
    total, types, n = total[at], types[at], counts[which]
    return np.where(total > 0, (n + types * p) / np.where(total > 0, total + types, 1), p)


def ratios(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last byte of asked windows, accepted less rejected: by models of four fifths, and of all.

    ``keys`` and ``counts`` hold all windows whose two bytes before the last agree with one of them,
    so contexts of two bytes or more are whole; shorter ones come from ``pairs``, the last two bytes
    of all windows, which have 2^16 values at most.
    """
    p = np.full((int(asked.sum()), 4), 1.0 / ALPHABET)
    ends, at = np.unique(pairs & 255, return_inverse=True)
    single = np.stack([np.bincount(at, pair_counts[:, m], len(ends)) for m in range(4)], 1)
    p = _step(p, ends, single, np.searchsorted(ends, keys[asked] & 255))
    p = _step(p, pairs, pair_counts, np.searchsorted(pairs, keys[asked] & 65535))
    for order in range(2, ORDER + 1):
        found, at = np.unique(keys & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        n = np.stack([np.bincount(at, counts[:, m], len(found)) for m in range(4)], 1)
        p = _step(p, found, n, at[asked])
    p = np.log(p)
    return np.stack([p[:, 0] - p[:, 1], p[:, 2] - p[:, 3]], 1)


def _ratio_batches(pairs: np.ndarray, pair_counts: np.ndarray):  # noqa: ANN202
    def work(rows: np.ndarray) -> pa.RecordBatch:
        asked = rows[:, 5] > 0
        got = ratios(rows[:, 0], _by_model(rows[:, 1:5].astype(float)), asked, pairs, pair_counts)
        return pa.RecordBatch.from_arrays([pa.array(rows[asked, 0]), pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["w", "part", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, WINDOWS
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("w", "c0", "c1", "c2", "c3", "asked")], 1))
            n += batch.num_rows
            if n >= due:
                rows = np.concatenate(held)
                group = (rows[:, 0] >> 8) & 65535
                cut = int(np.argmax(group == group[-1]))  # the last group may go on
                if cut:
                    yield work(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
                due = max(WINDOWS, 2 * n)
        if n:
            yield work(np.concatenate(held))

    return run


def _score(urls: pa.Table, found: pa.Table) -> pa.Table:
    """Differences of the urls of a block by the ratios of their windows."""
    urls = urls.combine_chunks()
    column = urls.column("url").chunk(0)
    keys, n = windows(column)
    known = found.column("w").to_numpy()
    order = np.argsort(known, kind="stable")
    at = order[np.searchsorted(known, keys, sorter=order)]
    kind, begin = urls.column("kind").to_numpy(), np.cumsum(n) - n
    part, whole = (np.add.reduceat(found.column(c).to_numpy()[at], begin) / n for c in ("part", "whole"))
    return pa.table({"url": column, "kind": kind, "difference": np.where(kind == UNDECIDED, whole, part)})


def differences(decided: DataFrame, others: DataFrame) -> DataFrame:
    """(url binary, kind, difference) of held-out decided urls, by models of the rest, and of the other urls, by models of all decided ones.

    ``decided``: distinct (ruled, url); every fifth of a verdict, in the order of a hash, is held out.
    ``others``: distinct urls. Urls are dealt into blocks, and a window reaches each block once, so those
    that all urls have don't make a hot key.
    """
    placed = places(decided.withColumn("h", F.xxhash64("url")), ["ruled"], ["h", "url"], "at")
    kind = F.when(F.col("ruled") == "allow", ACCEPTED).otherwise(REJECTED) + F.when(F.col("at") % 5 == 0, 1).otherwise(0)
    urls = placed.select(F.col("url").cast("binary").alias("url"), kind.cast("int").alias("kind")).union(others.select(F.col("url").cast("binary"), F.lit(UNDECIDED)))
    urls = checkpointed(urls.mapInArrow(_deal, "block long, url binary, kind int"))
    sums = [F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")]
    counts = urls.select("url", "kind").mapInArrow(_count, "w long, c0 long, c1 long, c2 long, c3 long, asked long").groupBy("w").agg(*sums, F.max("asked").alias("asked"))
    counts = checkpointed(counts)
    # 2^16 pairs of bytes at most.
    pairs = sorted(counts.groupBy(F.col("w").bitwiseAND(65535).alias("w")).agg(*sums).collect())
    table = np.array([tuple(r) for r in pairs], np.int64).reshape(-1, 5)
    group = F.shiftright("w", 8).bitwiseAND(65535)
    solved = counts.repartition(group).sortWithinPartitions(group).mapInArrow(_ratio_batches(table[:, 0], _by_model(table[:, 1:].astype(float))), "w long, part double, whole double")
    asked = urls.where(F.col("kind").isin(ACCEPTED_HELD, REJECTED_HELD, UNDECIDED))
    need = asked.select("block", "url").mapInArrow(_need, "block long, w long")
    found = need.join(solved, "w").select("block", "w", "part", "whole")
    return checkpointed(asked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score, "url binary, kind int, difference double"))


def threshold_of(held: DataFrame) -> float:
    """Half of the gap between differences at which the fewest held-out urls fall on the wrong side, both verdicts weighing the same; the lowest of equals."""
    good = F.col("kind") == ACCEPTED_HELD
    levels = checkpointed(held.groupBy("difference").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")))
    goods, bads = levels.agg(F.sum("good"), F.sum("bad")).first()
    # accepted urls under a cut plus rejected ones from it on, times both numbers, but for a constant
    weight = F.col("good").cast("decimal(38,0)") * F.lit(bads) - F.col("bad").cast("decimal(38,0)") * F.lit(goods)
    cut = counted_below(levels, [], "difference", weight.cast("decimal(28,0)"), "wrong").orderBy("wrong", "difference").first().difference
    below = levels.where(F.col("difference") < cut).agg(F.max("difference")).first()[0]
    return (cut - 1 + cut) / 2 if below is None else (below + cut) / 2


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) of every row of ``pages`` (page_id, url).

    The models learn from all distinct urls that a rule decides. A url
    without ``://`` or a null one has an empty host and path. It, and any url where one of
    the verdicts has no url to learn from, is judged like others by the models, and allowed
    without any. difference is null where a rule decides. Repeated rows stay; an empty table
    gives an empty result.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    decided, others = rows.where(F.col("ruled").isNotNull()), rows.where(F.col("ruled").isNull())
    nothing = F.lit(None).cast("double").alias("difference")
    known = decided.select("ruled", "url").distinct()
    if known.select("ruled").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), nothing)
    key = F.coalesce("url", F.lit("")).cast("binary")
    scored = differences(known, others.select(F.coalesce("url", F.lit("")).alias("url")).distinct())
    threshold = threshold_of(scored.where(F.col("kind") != UNDECIDED))
    scored = scored.where(F.col("kind") == UNDECIDED).select(F.col("url").alias("key"), "difference")
    judged = others.withColumn("key", key).join(scored, "key", "left")
    verdict = F.when(F.col("difference") >= threshold, "allow").otherwise("block").alias("verdict")
    return decided.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), nothing).union(judged.select("page_id", "host", "path", "rule", verdict, "difference"))
