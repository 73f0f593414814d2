"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

Texts are cut into words by the tokenizer's pattern. A fold over the bytes of each distinct
word joins the adjacent pair of lowest rank, leftmost first, until no pair has a rank; the
words' ids are then set in for their occurrences. Decoding concatenates the ids' binary pieces.

The fold comes in two forms that give the same ids. ``higher_order`` is a Spark higher-order
function over literal rank arrays (a perfect hash, so a look-up costs the same at any size of
the vocabulary): blocks of texts, their new words and the words' ids flow through one stage in
order. ``python``, the default, folds in the Python workers, which keep a bounded table of
words; it takes about a tenth of the CPU time (see the README).
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Characters of text in a block, distinct words that a partition remembers, at most, about.
BLOCK, WORDS = 4 << 20, 1 << 19
NO_RANK = 2147483647
#: Bytes from which on a word is merged by a heap.
LONG = 200


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slots): key i is at slots[(h >> 20 + displacements[h % D]) % S], h its XXH64 with seed 42 as a signed long."""
    h = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64).view(np.int64)
    n_d = 1 << max(4, (len(keys) // 2).bit_length())
    for n_s in range(2 * len(keys) + 17, 2 * len(keys) + 2017, 2):
        bucket, base = h % n_d, (h >> 20) % n_s
        order = np.argsort(-np.bincount(bucket, minlength=n_d)[bucket] * n_d + bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        slots, moved, good = np.full(n_s, -1, np.int64), np.zeros(n_d, np.int64), True
        for group in np.split(order, cuts):
            own = base[group]
            if len(np.unique(own)) < len(own):
                good = False
                break
            d = next((d for d in range(n_s) if (slots[(own + d) % n_s] < 0).all()), None)
            if d is None:
                good = False
                break
            slots[(own + d) % n_s], moved[bucket[group[0]]] = group, d
        if good:
            return moved, slots
    raise ValueError("no perfect hash of these keys")


def _literal(values: list, kind: str) -> Column:
    """A literal array: the split of a literal string is folded to one by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def encode_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of a binary ``word`` as array<int>; an empty word has none."""
    keys = list(ranks)
    moved, slots = perfect_hash(keys)
    by_slot = [ranks[keys[i]] if i >= 0 else -1 for i in slots]
    spelt = [""] * (max(ranks.values()) + 1)
    for k, r in ranks.items():
        spelt[r] = k.hex().upper()
    table = F.array(F.struct(_literal(moved.tolist(), "int").alias("moved"), _literal(by_slot, "int").alias("slots"), _literal(spelt, "string").alias("spelt")))

    def with_table(t: Column) -> Column:
        def rank(piece: Column) -> Column:
            h = F.xxhash64(piece)
            d = F.element_at(t["moved"], (F.pmod(h, F.lit(len(moved))) + 1).cast("int"))
            at = F.element_at(t["slots"], (F.pmod(F.pmod(F.shiftright(h, 20), F.lit(len(slots))) + d, F.lit(len(slots))) + 1).cast("int"))
            return F.when((at >= 0) & (F.element_at(t["spelt"], at + 1) == F.hex(piece)), at).otherwise(F.lit(NO_RANK))

        n = F.length(word)
        none = F.array().cast("array<int>")
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))).otherwise(none)

        def merge(s: Column, _: Column) -> Column:
            def at_least(best: Column) -> Column:
                i = F.array_position(s["ranks"], best).cast("int")

                def joined(piece: Column) -> Column:
                    left = F.when(i > 1, F.array(rank(F.concat(F.get(s["parts"], i - 2), piece)))).otherwise(none)
                    right = F.when(i < F.size(s["ranks"]), F.array(rank(F.concat(piece, F.get(s["parts"], i + 1))))).otherwise(none)
                    new = F.concat(F.slice(s["parts"], F.lit(1), i - 1), F.array(piece), F.slice(s["parts"], i + 2, n))
                    pairs = F.concat(F.slice(s["ranks"], F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(s["ranks"], i + 2, n))
                    return F.struct(new.alias("parts"), pairs.alias("ranks"))

                return F.when(best < NO_RANK, _let(F.concat(F.get(s["parts"], i - 1), F.get(s["parts"], i)), joined)).otherwise(s)

            return _let(F.coalesce(F.array_min(s["ranks"]), F.lit(NO_RANK)), at_least)

        start = F.struct(parts.alias("parts"), pairs.alias("ranks"))
        folded = F.aggregate(F.sequence(F.lit(1), n), start, merge, lambda s: F.transform(s["parts"], rank))
        return F.when(n == 0, none).otherwise(_let(rank(word), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(folded)))

    return _let_in(table, with_table)


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value evaluated once."""
    return _let_in(F.array(value), f)


def _let_in(one: Column, f) -> Column:  # noqa: ANN001
    return F.get(F.transform(one, f), F.lit(0))


def _block_batches(pattern: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern).findall
        places: dict[str, int] = {}
        number = 0
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                fresh = len(places) > WORDS
                if fresh:
                    places = {}
                had, sizes, index = len(places), [], []
                put = places.setdefault
                for t in part.column("text").to_pylist():
                    words = cut(t or "")
                    index += [put(w, len(places)) for w in words]
                    sizes.append(len(words))
                new = [w.encode() for w in list(places)[had:]]
                values = [[number], [fresh or number == 0], [part.column("doc_id").to_pylist()], [sizes], [np.array(index, np.int32)], [new]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.bool_(), pa.list_(part.column("doc_id").type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())), strict=True)], names=["number", "fresh", "doc_ids", "sizes", "index", "words"])
                number += 1

    return run


def _text_batches(pieces: list[bytes]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = 0
        starts, ids = np.zeros(1, np.int64), np.empty(0, np.int32)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                number, fresh = row.column("number")[0].as_py(), row.column("fresh")[0].as_py()
                if number != expected:
                    raise RuntimeError("blocks of a partition came out of order")
                expected += 1
                if fresh:
                    starts, ids = np.zeros(1, np.int64), np.empty(0, np.int32)
                new = row.column("ids").flatten()
                lengths = np.diff(new.offsets.to_numpy())
                starts = np.concatenate([starts, starts[-1] + np.cumsum(lengths)])
                ids = np.concatenate([ids, new.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
                index = row.column("index").flatten().to_numpy(zero_copy_only=False)
                n = starts[index + 1] - starts[index]
                ends = np.cumsum(n)
                flat = ids[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                cuts = np.append(0, np.cumsum(row.column("sizes").flatten().to_numpy(zero_copy_only=False)))
                bounds = np.append(0, ends)[cuts]
                packed, decoded = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = flat[a:b]
                    packed.append(own.astype("<u4").tobytes())
                    decoded.append(b"".join([pieces[i] for i in own.tolist()]))
                cols = [row.column("doc_ids").flatten(), pa.array(np.diff(bounds)), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != NO_RANK:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap, for words of any length."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                new = parts[k] + parts[after[k]]
                if (r := ranks.get(new)) is not None:
                    heapq.heappush(heap, (r, k, new))
    return [ranks[p] for p in parts if p is not None]


class Words(dict):
    """Packed ids of the words of up to LONG bytes met so far; emptied when it holds WORDS of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        ids = merge_word(data, self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(data) <= LONG:
            if len(self) >= WORDS:
                self.clear()
            self[word] = packed
        return packed


_words: dict[str, Words] = {}


def _encode_batches(held, name: str, pattern: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pieces = held.value
        words = _words.setdefault(name, Words(ranks))
        cut, known, piece = regex.compile(pattern).findall, words.__getitem__, pieces.__getitem__
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                packed = [b"".join(map(known, cut(t))) if t else b"" for t in part.column("text").to_pylist()]
                decoded = [b"".join(map(piece, np.frombuffer(p, "<u4").tolist())) for p in packed]
                cols = [part.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, fold: str = "python") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs`` (doc_id, text), whole texts.

    ``ids``: token ids packed as little-endian unsigned 32-bit integers; ``decoded``: the bytes
    of their pieces. ``rank_file``: a tiktoken rank file that the driver can read; no special
    tokens. Null and empty texts have no ids; repeated rows and null ids stay; an empty table
    gives an empty result.
    """
    ranks = read_ranks(rank_file)
    pieces = [b""] * (max(ranks.values()) + 1)
    for k, r in ranks.items():
        pieces[r] = k
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    if fold == "python":
        held = docs.sparkSession.sparkContext.broadcast((ranks, pieces))  # the rank file, whatever the input is
        return kept.mapInArrow(_encode_batches(held, rank_file, pattern), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
    blocks = kept.mapInArrow(_block_batches(pattern), f"number long, fresh boolean, doc_ids array<{kind}>, sizes array<int>, index array<int>, words array<binary>")
    coded = blocks.select("number", "fresh", "doc_ids", "sizes", "index", F.transform("words", lambda w: encode_word(w, ranks)).alias("ids"))
    return coded.mapInArrow(_text_batches(pieces), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
