"""SimHash near-dedup by tiled exact comparison of fingerprints.

Fingerprints are compared exactly: every pair of distinct fingerprints is either
compared with numpy exclusive-or and bit counts, or skipped because the bit counts
of their four 16-bit words differ by more than the radius in sum, which bounds the
number of differing bits from below. Equal fingerprints form one class, so copies
are never compared with each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_slices
from .components import connected_components
from .simhash_verified import keep_one

__all__ = ["fingerprint", "fingerprint_hex", "fingerprints", "keep_one", "links", "near_duplicates"]

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints in a tile at most, about.
TILE = 4096
#: Pairs compared at once.
BLOCK_PAIRS = 1 << 21


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of a whole text; zero for null, empty or blank texts.

    bytes.lower and bytes.split act on A-Z and on space and \\x09-\\x0D alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(words, words[1:], words[2:], strict=False) if len(words) >= SHINGLE else [words]
    hashes = (digest(join(w), SEED) for w in shingles)
    set_bits, total = np.zeros(64, np.int64), 0
    while len(block := np.fromiter(itertools.islice(hashes, 1 << 15), "<u8")):
        set_bits += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
        total += len(block)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            prints = np.array([fingerprint(t) for t in part.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``, whole texts; ids of any type that has an order."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_fingerprint_batches, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each value and the least value of its component among the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    rest = least != np.arange(len(nodes))
    return nodes[rest], nodes[least[rest]]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def result(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        x, y = _spanning(x, y) if len(x) else (x, y)
        return pa.RecordBatch.from_arrays([pa.array(x.view("<i8")), pa.array(y.view("<i8"))], names=["u", "v"])

    for batch in batches:
        sides = []
        for name in ("a", "b"):
            col = batch.column(name)
            off = col.offsets.to_numpy()
            sides.append((col.values.to_numpy().view("<u8"), off[:-1].astype(np.int64), np.diff(off).astype(np.int64)))
        (va, sa, na), (vb, sb, nb) = sides
        pairs, found = na * nb, []
        small = np.flatnonzero((pairs > 0) & (pairs <= BLOCK_PAIRS // 16))
        cuts = np.searchsorted(np.cumsum(pairs[small]), np.arange(BLOCK_PAIRS, pairs[small].sum() + BLOCK_PAIRS, BLOCK_PAIRS))
        for rows in np.split(small, np.unique(cuts)):
            if not len(rows):
                continue
            n = pairs[rows]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb[rows], n)
            x, y = va[np.repeat(sa[rows], n) + k // width], vb[np.repeat(sb[rows], n) + k % width]
            hit = _close(x, y) & (x != y)
            found.append((x[hit], y[hit]))
        for r in np.flatnonzero(pairs > BLOCK_PAIRS // 16):
            x, y = va[sa[r] : sa[r] + na[r]], vb[sb[r] : sb[r] + nb[r]]
            step = max(1, BLOCK_PAIRS // len(y))
            for i in range(0, len(x), step):
                p, q = np.nonzero(_close(x[i : i + step, None], y[None, :]))
                p, q = x[i : i + step][p], y[q]
                found.append(_spanning(p[p != q], q[p != q]))
        if found:
            yield result(found)


def _word(k: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))


def links(classes: DataFrame) -> DataFrame:
    """(u, v): links that join the same distinct fingerprints ``fp`` as all links within the radius.

    A cell holds the fingerprints with the same four bit counts; a cell with many is
    cut into tiles by a hash. A tile meets the tiles of the cells within the radius,
    each unordered pair of cells once.
    """
    span = range(-RADIUS, RADIUS + 1)
    offsets = [o for o in itertools.product(span, repeat=4) if sum(map(abs, o)) <= RADIUS and o >= (0, 0, 0, 0)]
    keys = ["w0", "w1", "w2", "w3"]
    cells = classes.select("fp", *(_word(k).alias(keys[k]) for k in range(4)))
    # 17^4 cells at most, so this table can be broadcast whatever the input is.
    tiles_of = cells.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("n_tiles")).where("n_tiles > 1")
    salt = F.pmod(F.xxhash64("fp"), F.coalesce("n_tiles", F.lit(1))).cast("int")
    tiles = (
        cells.join(F.broadcast(tiles_of), keys, "left")
        .groupBy(*keys, salt.alias("salt"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = checkpointed(tiles)
    shifted = tiles.select(
        F.col("fps").alias("a"),
        F.col("salt").alias("salt_a"),
        *(F.col(k).alias(f"{k}_a") for k in keys),
        F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(o))) for o in offsets))).alias("o"),
    ).select("a", "salt_a", *((F.col(f"{k}_a") + F.col(f"o.d{i}")).alias(k) for i, k in enumerate(keys)), (F.expr("o.d0 = 0 and o.d1 = 0 and o.d2 = 0 and o.d3 = 0")).alias("own"))
    met = shifted.where(" and ".join(f"{k} between 0 and 16" for k in keys)).join(tiles.withColumnRenamed("fps", "b"), keys)
    met = met.where(~F.col("own") | (F.col("salt_a") <= F.col("salt"))).select("a", "b")
    return met.mapInArrow(_compare_batches, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among the rows whose fingerprints are joined
    by a chain of links of at most RADIUS differing bits. Null, empty and blank texts
    have fingerprint zero and link like any other; repeated rows stay; a null doc_id
    gets the component of its text. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(classes), "u", "v").withColumnRenamed("node", "fp")
    joined = checkpointed(classes.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
