"""SimHash near-dedup at a least Jaccard similarity of word shingles.

Texts with equal sets of shingles form one class. Classes get wide fingerprints (WORDS words
of 64 bits over their distinct shingles) that are compared tile against tile with numpy
exclusive-or and bit counts. A tile holds classes of about equal set sizes; tiles whose sizes
lie too far apart for the similarity never meet. Fingerprints within RADIUS join classes to
candidate groups, and inside those whole sets are verified: a pair links if its similarity is
at least ``least``, and pairs that are joined already are not looked at again. Links are
therefore never wrong; at a similarity of 0.8 fingerprints differ in 39 of 256 bits on average
(48 for four of five shingles), six (four) standard deviations within RADIUS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, inner_prefix, text_slices
from .components import connected_components, joined

SEED, SHINGLE, LEAST = 42, 5, (4, 5)
#: Words of a fingerprint, its radius in bits, and that of its first half.
WORDS, RADIUS, HALF = 4, 72, 46
#: Classes of a tile, about; rows and columns compared at once; shingles of a block that is verified in one task.
TILE, ROWS, COLUMNS, SETS = 1 << 15, 64, 4096, 1 << 22
FPS = [f"w{k}" for k in range(WORDS)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles of words; the whole text is one if it has fewer words, a blank one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else [words][: len(words)]
    return np.unique(np.fromiter((digest(join(w), SEED) for w in runs), "<u8"))


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """WORDS words: a bit is one if it is set in over half of the mixed hashes."""
    out = np.zeros(WORDS, "<u8")
    for k in range(WORDS if len(grams) else 0):
        set_bits = np.zeros(64, np.int64)
        for i in range(0, len(grams), 1 << 15):
            z = grams[i : i + (1 << 15)] + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            set_bits += np.unpackbits(z.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
        out[k] = np.packbits(2 * set_bits > len(grams), bitorder="little").view("<u8")[0]
    return out


def _class_batches(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                keys = pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary())
                prints = np.array([wide_fingerprint(g) for g in sets], "<u8").reshape(-1, WORDS).view("<i8")
                cols = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                cols += [keys, pa.array([len(g) for g in sets], pa.int64()), *(pa.array(prints[:, k].copy()) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "key", "n", *FPS])

    return run


def _set_batches(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = pa.array([shingles(t, size).view("<i8") for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), sets], names=[*names, "grams"])

    return run


def _fields(column: pa.Array, row: int) -> dict[str, np.ndarray]:
    held = column.slice(row, 1).flatten()
    return {f.name: held.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(held.type)}


def _compare_batches(least: tuple[int, int]):  # noqa: ANN202
    """(u, v): links that join the same ids of two tiles as all pairs within RADIUS do."""
    num, den = least

    def tile(a: dict[str, np.ndarray], b: dict[str, np.ndarray], own: bool) -> tuple[np.ndarray, np.ndarray]:
        a = {k: v[np.argsort(a["n"], kind="stable")] for k, v in a.items()}
        b = a if own else {k: v[np.argsort(b["n"], kind="stable")] for k, v in b.items()}
        ids = a["id"] if own else np.concatenate([a["id"], b["id"]])
        base, root = 0 if own else len(a["id"]), np.arange(len(ids))
        fa, fb = ([x[w].view("<u8") for w in FPS] for x in (a, b))
        for i in range(0, len(a["n"]), ROWS):
            rows = slice(i, min(i + ROWS, len(a["n"])))
            low = np.searchsorted(b["n"], -(-a["n"][rows][0] * num // den))
            high = np.searchsorted(b["n"], a["n"][rows][-1] * den // num, side="right")
            for j in range(max(low, i) if own else low, high, COLUMNS):
                cols = slice(j, min(j + COLUMNS, high))
                apart = np.bitwise_count(fa[0][rows, None] ^ fb[0][cols])
                for k in range(1, WORDS // 2):
                    apart += np.bitwise_count(fa[k][rows, None] ^ fb[k][cols])
                p, q = np.nonzero(apart <= HALF)
                total = apart[p, q].astype(np.int64)
                p, q = p + i, q + j
                if own:
                    keep = p < q
                    p, q, total = p[keep], q[keep], total[keep]
                for k in range(WORDS // 2, WORDS):
                    total += np.bitwise_count(fa[k][p] ^ fb[k][q])
                near = (total <= RADIUS) & (a["n"][p] * num <= b["n"][q] * den) & (b["n"][q] * num <= a["n"][p] * den)
                p, q = p[near], q[near] + base
                new = root[p] != root[q]
                if new.any():
                    root = joined(root, p[new], q[new])
        moved = root != np.arange(len(ids))
        return ids[moved], ids[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                u, v = tile(_fields(batch.column("a"), r), _fields(batch.column("b"), r), batch.column("own")[r].as_py())
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def candidates(classes: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(u, v): links that join classes (id, n, w0 ...) as all pairs of fitting sizes within RADIUS do.

    A band holds the sizes within the factor that the similarity allows, so a band meets itself
    and the next one alone; bands with many classes are cut into tiles by a hash.
    """
    num, den = least
    banded = classes.where("n > 0").withColumn("band", F.floor(F.log("n") / F.lit(math.log(den / num))).cast("int"))
    # The number of bands grows with the logarithm of the longest text, so this table can be broadcast.
    counts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    salt = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("salt")
    fields = F.struct("id", "n", *FPS)
    tiles = checkpointed(banded.join(F.broadcast(counts), "band").groupBy("band", "tiles", salt).agg(F.collect_list(fields).alias("b")))
    following = counts.select((F.col("band") - 1).alias("band"), F.col("tiles").alias("more"))
    met = tiles.withColumnRenamed("b", "a").join(F.broadcast(following), "band", "left")
    own = F.transform(F.sequence("salt", F.col("tiles") - 1), lambda s: F.struct(F.col("band").alias("band"), s.cast("int").alias("salt"), (s == F.col("salt")).alias("own")))
    upper = F.transform(F.sequence(F.lit(0), F.col("more") - 1), lambda s: F.struct((F.col("band") + 1).alias("band"), s.cast("int").alias("salt"), F.lit(False).alias("own")))
    other = F.when(F.col("more").isNull(), own).otherwise(F.concat(own, upper))
    met = met.select("a", F.explode(other).alias("o")).select("a", "o.*").hint("shuffle_hash")
    pairs = tiles.select("b", "band", "salt").join(met, ["band", "salt"]).select("a", "b", "own")
    return pairs.mapInArrow(_compare_batches(least), "u long, v long")


def verified(n: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, least: tuple[int, int]) -> np.ndarray:
    """The least place of each place's component by links of at least the similarity; between both sides only, where given."""
    num, den = least
    root, order = np.arange(len(n)), np.argsort(n, kind="stable")
    sizes = n[order]
    for at, i in enumerate(order[:-1]):
        rest = order[at + 1 : np.searchsorted(sizes, n[i] * den // num, side="right")]
        rest = rest[root[rest] != root[i]]
        if side is not None:
            rest = rest[side[rest] != side[i]]
        rest = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(1, dtype=np.int64) <= RADIUS]
        if not len(rest):
            continue
        flat = np.concatenate([sets[k] for k in rest])
        found = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        starts = np.cumsum(n[rest]) - n[rest]
        same = np.add.reduceat((sets[i][found] == flat).astype(np.int64), starts)
        hit = rest[same * (num + den) >= (n[rest] + n[i]) * num]
        if len(hit):
            root = joined(root, hit, np.full(len(hit), i))
    return root


def _verify_batches(least: tuple[int, int]):  # noqa: ANN202
    """Rows come sorted by (candidate group, i, j, n, id); those of one (group, i, j) are held at once."""

    def links(rows: list[tuple], i: int, j: int) -> pa.RecordBatch | None:
        rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]]  # repeated rows bring equal sets
        ids = np.array([r[0] for r in rows], np.int64)
        n = np.array([len(r[3]) for r in rows], np.int64)
        side = None if i == j else np.array([r[1] for r in rows]) == i
        root = verified(n, np.array([r[2] for r in rows], np.int64).view("<u8"), [r[3] for r in rows], side, least)
        moved = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"]) if moved.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j")), strict=True))
            ids, block = batch.column("id").to_pylist(), batch.column("block").to_pylist()
            prints = np.stack([batch.column(w).to_numpy() for w in FPS], 1)
            off, grams = batch.column("grams").offsets.to_numpy(), batch.column("grams").values.to_numpy().view("<u8")
            for r, k in enumerate(keys):
                if k != key:
                    if len(held) > 1 and (out := links(held, *key[1:])) is not None:
                        yield out
                    held, key = [], k
                held.append((ids[r], block[r], prints[r], grams[off[r] : off[r + 1]]))
        if len(held) > 1 and (out := links(held, *key[1:])) is not None:
            yield out

    return run


def _identity(docs: DataFrame, inner: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two hashes of all its columns, which rows share only if they are the same."""
    cols = [F.col(c) for c in docs.columns]
    names = [inner + "h1", inner + "h2"]
    return docs.withColumns({names[0]: F.xxhash64(*cols), names[1]: F.xxhash64(F.lit(SEED), *cols)}), names


def similar(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(key, first, root): each class of equal shingle sets of ``docs`` (doc_id, text, h1, h2), the identity
    (no_id, doc_id, h1, h2) of its first row, and the class id that all classes linked to it share.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select("doc_id", "h1", "h2", text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{w} long" for w in FPS)
    rows = checkpointed(rows.mapInArrow(_class_batches(shingle), f"doc_id {kind}, h1 long, h2 long, key binary, n long, {fields}"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    classes = rows.groupBy("key").agg(first, F.first("n").alias("n"), *(F.first(w).alias(w) for w in FPS))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    groups = connected_components(candidates(classes, least), "u", "v").select(F.col("node").alias("id"), F.col("component").alias("grp"))
    members = checkpointed(classes.join(groups, "id").select("id", "grp", "n", "first.h1", "first.h2", *FPS))
    large = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(SETS)).cast("int").alias("blocks")).where("blocks > 1")
    placed = members.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Only texts of candidate groups move, one of each class; adaptive execution broadcasts the members if they are few.
    texts = docs.select("h1", "h2", text).join(placed, ["h1", "h2"]).select("id", "grp", "n", "blocks", "block", *FPS, "text")
    sets = texts.mapInArrow(_set_batches(shingle), f"id long, grp long, n long, blocks int, block int, {fields}, grams array<long>")
    met = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "n", "block", *FPS, "grams")
    dealt = met.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "n", "id")
    links = dealt.mapInArrow(_verify_batches(least), "u long, v long")
    roots = connected_components(links, "u", "v").select(F.col("node").alias("id"), F.col("component").alias("root"))
    return classes.join(roots, "id", "left").select("key", "first", F.coalesce("root", "id").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of each group of near-duplicate texts of ``docs`` (doc_id, text, ...), all its columns kept.

    Texts link at a similarity of ``least`` or more of their word shingles; a group is all that
    is reached by links. The row with the smallest doc_id stays; a row without one stays only if
    its group has no doc_id. Rows that share the doc_id but hold other texts are rows of their
    own, in the groups of their texts; of several rows of one group with that doc_id the one with
    the least hash of all columns stays, and of rows that are the same in all columns one. Null,
    empty and blank texts are one group. An empty table gives an empty result.
    """
    inner = inner_prefix(docs)
    marked, (h1, h2) = _identity(docs, inner)
    found = similar(marked.select("doc_id", "text", F.col(h1).alias("h1"), F.col(h2).alias("h2")), shingle, least)
    keep = found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.h1").alias(h1), F.col("first.h2").alias(h2))
    kept = marked.join(keep, [h1, h2], "left_semi")
    return kept.dropDuplicates([h1, h2]).select(docs.columns)

