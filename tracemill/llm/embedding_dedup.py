"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Equal vectors form one class. Every class is hashed into TABLES tables; a table's
bucket is made of HASHES cross-polytope hashes (the signed axis nearest to the
pseudo-randomly rotated vector), and a class also probes the PROBES next buckets of
each table. All classes that meet in a bucket are verified by their cosine in double
precision, block against block, so only links at or over the threshold are kept and
none is lost that meets. A pair that meets in several buckets counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components, joined
from .vectors import finite, matrix

TABLES, HASHES, PROBES, ROUNDS, SEED = 6, 2, 3, 3, 20
#: Axes of each rotation that probes are drawn from.
NEAR = 3
#: Classes of one bucket that are verified against each other at once.
BLOCK = 4096
#: Rows of a tile multiplied, and pairs over the threshold looked up, at once.
ROWS, PAIRS = 512, 1 << 16
#: Vectors that are read into memory at once, at most the members of one tile more.
READ = 1 << 15


def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(TABLES, HASHES, ROUNDS, dim))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray) -> np.ndarray:
    """Buckets (rows, TABLES, 1 + PROBES) of unit vectors whose width is a power of two.

    The first of each table is the vector's own, the others are those whose axes
    fall short of the nearest ones by the least squares. Ties go to lower axes.
    """
    dim = x.shape[1]
    near = min(NEAR, dim)
    signs, out = _signs(dim), np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k in range(HASHES):
            y = x
            for r in range(ROUNDS):
                y = _hadamard(y * signs[t, k, r])
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            v = np.take_along_axis(y, axes, 1)
            axis = 2 * axes + (v < 0)
            short = (np.abs(v[:, :1]) - np.abs(v)) ** 2
            code = (code[:, :, None] * (2 * dim) + axis[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + PROBES]
        got = np.take_along_axis(code, order, 1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, -1:]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares within range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash_batches(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                b = buckets(_unit(matrix(part.column("embedding"), dim)))
                n = b[0].size if len(b) else 0
                row = np.repeat(np.arange(len(b)), n)
                t = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(b))
                key = np.stack([row, t, b.ravel()], 1)
                _, first = np.unique(key, axis=0, return_index=True)
                got = part.take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[first]), pa.array(b.ravel()[first]), *got.columns], names=["t", "bucket", *got.schema.names]
                )

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the least bucket in it, that rows of two bucket arrays share."""
    table, bucket = np.full(len(a), TABLES), np.full(len(a), np.iinfo(np.int64).max)
    for t in range(TABLES - 1, -1, -1):
        same = a[:, t, :, None] == b[:, t, None, :]
        least = np.where(same, a[:, t, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
        hit = same.any(axis=(1, 2))
        table[hit], bucket[hit] = t, least[hit]
    return table, bucket


def _verify_batches(dim: int, threshold: float):  # noqa: ANN202
    def tile(t: int, bucket: int, same: bool, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray):  # noqa: ANN202
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
        links, root, seen = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        codes: np.ndarray | None = None
        for i in range(0, len(a), ROWS):
            p, q = np.nonzero(x[a[i : i + ROWS]] @ x[b].T >= threshold)
            p, q = a[i : i + ROWS][p], b[q]
            keep = p < q if same else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            if codes is None:
                codes = buckets(x)
            for j in range(0, len(p), PAIRS):
                u, v = p[j : j + PAIRS], q[j : j + PAIRS]
                ft, fb = _first_shared(codes[u], codes[v])
                mine = (ft == t) & (fb == bucket)
                u, v = u[mine], v[mine]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                seen[u] = seen[v] = True
                root = joined(root, u, v)
        return ids[seen], links[seen], ids[root[seen]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = batch.column("members").offsets.to_numpy().astype(np.int64)
            tiles = list(zip(*(batch.column(c).to_numpy().tolist() for c in ("t", "bucket", "i", "j")), strict=True))
            begin = 0
            while begin < len(tiles):
                # as many tiles as hold READ members, one at least; their vectors are read at once
                end = max(begin + 1, int(np.searchsorted(off, off[begin] + READ, side="right")) - 1)
                rows = batch.column("members").slice(begin, end - begin).flatten()
                f = {x.name: rows.field(n) for n, x in enumerate(rows.type)}
                x = _unit(matrix(f["embedding"], dim))
                rep, copies, block = (f[c].to_numpy() for c in ("rep", "copies", "block"))
                out = []
                for k in range(begin, end):
                    t, bucket, i, j = tiles[k]
                    own = slice(off[k] - off[begin], off[k + 1] - off[begin])
                    found = tile(t, bucket, i == j, rep[own], copies[own], block[own] != i, x[own])
                    if len(found[0]):
                        out.append(found)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["rep", "links", "root"])
                begin = end

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links: other rows whose cosine is at least ``threshold``; component_id: smallest
    vec_id reachable by such links, the row's own included. Repeated rows are vectors of
    their own and link. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without a vec_id, link with nothing: n_links 0, component_id =
    vec_id. Shorter vectors count as padded with zeros. An empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = finite("embedding") & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    classes = checkpointed(rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    dim = 1 << max(0, width - 1).bit_length()
    kind = classes.schema["embedding"].dataType.simpleString()
    entries = classes.mapInArrow(_hash_batches(dim), f"t int, bucket long, embedding {kind}, rep long, copies long")
    key = ["t", "bucket"]
    large = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = large.select(*key, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = entries.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = met.groupBy(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list(F.struct("rep", "copies", "block", "embedding")).alias("members")
    )
    found = checkpointed(tiles.where(F.size("members") > 1).mapInArrow(_verify_batches(dim, threshold), "rep long, links long, root long"))
    roots = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, "rep", "left")
    of = classes.join(linked, "rep", "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    good = rows.where(usable).join(of, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
