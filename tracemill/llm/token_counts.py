"""Token counts by a compiled finite-state tokenizer.

The splitting pattern and the byte-pair merges of a byte-level tokenizer file become a
deterministic transducer over bytes. Its transitions carry the number of tokens that
reading a byte adds to the encoding of the word read so far (it can be negative when
tokens merge), so the counts of a text's transitions sum up to its tokens.

A state holds what the encodings of all longer words depend on: the suffixes of the
word that begin a vocabulary token, and for each the last token before it and the count
of tokens there. A vocabulary token ends the encoding of a prefix just if it and the last
token before it encode to themselves, so a transition needs the state and a byte alone.
States are determinised when first met and kept in a bounded table.

Texts are cut into chunks at fixed places, and all chunks are read in step. At a word
boundary every state goes to the start, so behind its first boundary a chunk's state map is
constant. Before it, the chunk is read from each state that can be live at the cut: those in
which the chunk before ends from any of its own. The maps (state to state and count) compose
in a prefix scan of logarithmic depth, which tells every chunk's true state and head count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Bytes of a chunk; transitions that are kept at most; rounds in which states of chunks without a boundary are foreseen.
CHUNK, TRANSITIONS, FORESEEN = 256, 1 << 21, 5
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
#: White_Space of Unicode besides the space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    out[WHITE], out[0x20] = BLANK, SPACE
    return out


def boundaries(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin, for code points and the marks of each text's first one.

    Evaluates the splitter 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    at all places at once; what it does at a place depends on a few neighbours alone.
    """
    n = len(cps)
    kind = classes()[cps]
    white = kind >= SPACE
    before, after = np.roll(kind, 1), np.roll(white, -1)
    last = np.roll(first, -1)
    if n:
        last[-1] = True
    white_before = (before >= SPACE) & ~first
    start = np.where(white, ~white_before | (~after & ~last), np.where(white_before, before == BLANK, kind != before))
    start |= first
    at = np.flatnonzero((cps == 0x27) & start & ~(white_before & (before == SPACE)))
    ahead = lambda k: np.where((at + k < n), cps[np.minimum(at + k, n - 1)], 0)
    inside = lambda k: (at + k < n) & ~first[np.minimum(at + k, n - 1)]
    a, b = ahead(1), ahead(2)
    one = inside(1) & np.isin(a, [ord(c) for c in "stmd"])
    two = inside(1) & inside(2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    start[at[one | two] + 1] = False
    start[at[two] + 2] = False
    for ends in (at[one] + 2, at[two] + 3):
        start[ends[ends < n]] = True
    return start


def refuse_others(spec: dict) -> None:
    """Raise for a tokenizer file that this module doesn't compile."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    wrong = [k for k, v in plain.items() if (model.get(k) or v) != v]
    wrong += ["normalizer"] * bool(spec.get("normalizer")) + ["model.type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True))
    wrong += [f"added token {t['content']}" for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Transducer:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        refuse_others(spec)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        # leftmost, then longest
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        self.ranks = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((raw(a), raw(b)), r)
        self.prefixes = {t[:k] for t in self.vocab for k in range(1, len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((0, -1, 0),))
        self.states, self.ids = [start], {start: 0}
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys, self.next, self.emits = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.size, self.shift, self.used = size, 64 - (size.bit_length() - 1), 0

    def encode(self, word: bytes) -> list[bytes]:
        """The merges, lowest rank first and leftmost of equal ones."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, u: int, t: int) -> bool:
        if (got := self.fits.get((u, t))) is None:
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            pair = [self.bytes_of[x] for x in (u, t) if x >= 0]
            got = self.fits[u, t] = self.encode(b"".join(pair)) == pair
        return got

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, live = self.states[state]
        grown, new, picked = suffix + bytes([byte]), [], None
        for length, u, rel in live:
            piece = grown[len(grown) - length - 1 :]
            if picked is None and (t := self.vocab.get(piece)) is not None and self._fit(u, t):
                picked = (t, rel + 1)
            if piece in self.prefixes:
                new.append((length + 1, u, rel))
        token, emitted = picked  # the bytes themselves are tokens, so there is one
        new = [(length, u, rel - emitted) for length, u, rel in new] + [(0, token, 0)]
        key = (grown[len(grown) - new[0][0] :], tuple(new))
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or the free slot where it belongs."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        found = self.keys[at]
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & (self.size - 1)
            found = self.keys[at[rest]]
            rest = rest[(found != keys[rest]) & (found != -1)]
        return at

    def _insert(self, key: int, to: int, emitted: int) -> None:
        at = int(self._slots(np.array([key], np.int64))[0])
        self.keys[at], self.next[at], self.emits[at] = key, to, emitted
        self.used += 1
        if 2 * self.used > self.size:
            held = np.flatnonzero(self.keys >= 0)
            k, t, e = self.keys[held], self.next[held], self.emits[held]
            self._table(2 * self.size)
            for i in range(len(k)):
                at = int(self._slots(k[i : i + 1])[0])
                self.keys[at], self.next[at], self.emits[at] = k[i], t[i], e[i]
            self.used = len(k)

    def _read(self, data: np.ndarray, start: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """End state and tokens of each lane: ``size`` bytes from ``begin``, read from ``state``; tokens at each byte go to ``out``."""
        order = np.argsort(-size, kind="stable")
        lanes, sizes, state, total = begin[order], size[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        most = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(most), side="left")
        for j in range(most):
            n = active[j]
            at = lanes[:n] + j
            keys = (np.where(start[at], 0, state[:n]) << 8) | data[at]
            slot = self._slots(keys)
            missing = self.keys[slot] != keys
            if missing.any():
                for key in np.unique(keys[missing]).tolist():
                    self._insert(key, *self._step(key >> 8, key & 255))
                slot = self._slots(keys)
            state[:n] = self.next[slot]
            emitted = self.emits[slot]
            total[:n] += emitted
            if out is not None:
                out[at] = emitted
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def run(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte, those of a chunk's head at its first byte, for bytes and the marks of the words' first ones."""
        out = np.zeros(len(data), np.int64)
        if not len(data):
            return out
        if self.used > TRANSITIONS:
            self.clear()
        words = np.append(np.flatnonzero(start), len(data))
        cuts = np.arange(0, len(data), CHUNK)
        ends = np.minimum(cuts + CHUNK, len(data))
        first = np.minimum(words[np.searchsorted(words, cuts)], ends)
        inner, head = first < ends, first > cuts
        last = np.full(len(cuts), -1)  # the state in which a chunk with a boundary ends
        at = np.flatnonzero(inner)
        last[at], _ = self._read(data, start, first[at], (ends - first)[at], np.zeros(len(at), np.int64), out)
        if head.any():
            out[cuts[head]] = self._heads(data, start, cuts, first, last, head)[head]
        return out

    def _heads(self, data: np.ndarray, start: np.ndarray, cuts: np.ndarray, first: np.ndarray, last: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Tokens of each chunk's head. ``last``: the end state of chunks with a boundary, -1 for open ones."""
        n = len(cuts)
        is_open = last < 0
        live = np.full((n, 1), -1)  # states that a chunk's head was read from
        goal, tokens = np.full((n, 1), -1), np.zeros((n, 1), np.int64)

        def add(chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Read heads from states that they weren't read from yet; what the chunks behind open ones need then."""
            nonlocal live, goal, tokens
            new = ~(live[chunk] == state[:, None]).any(1)
            pair = np.unique(np.stack([chunk[new], state[new]], 1), axis=0)
            if not len(pair):
                return pair[:, 0], pair[:, 1]
            chunk, state = pair[:, 0], pair[:, 1]
            end, total = self._read(data, start, cuts[chunk], (first - cuts)[chunk], state)
            slot = (live[chunk] >= 0).sum(1) + np.arange(len(chunk)) - np.searchsorted(chunk, chunk)
            if (grow := int(slot.max()) + 1 - live.shape[1]) > 0:
                live, goal, tokens = (np.pad(x, ((0, 0), (0, grow)), constant_values=v) for x, v in ((live, -1), (goal, -1), (tokens, 0)))
            live[chunk, slot], goal[chunk, slot], tokens[chunk, slot] = state, end, total
            on = is_open[chunk] & (chunk + 1 < n)
            on[on] = head[chunk[on] + 1]
            return chunk[on] + 1, end[on]

        behind = np.flatnonzero(head)
        known = behind[~is_open[behind - 1]]
        deep = behind[is_open[behind - 1] & is_open[behind]]
        chunk, state = add(np.concatenate([known, deep]), np.concatenate([last[known - 1], np.zeros(len(deep), np.int64)]))
        for _ in range(FORESEEN):
            if not len(chunk):
                break
            chunk, state = add(chunk, state)
        while True:
            # maps from a chunk's live states to those of the next one; -1 where that state wasn't foreseen
            ends = np.where(is_open[:, None], goal, last[:, None])[:-1]
            same = (ends[:, :, None] == live[1:, None, :]) & (ends[:, :, None] >= 0)
            to = np.where(same.any(2), same.argmax(2), -1)
            to[~head[1:]] = 0
            step = 1
            while step < len(to):
                before, after = to[:-step], to[step:]
                through = np.take_along_axis(after, np.maximum(before, 0), 1)
                to = np.concatenate([to[:step], np.where(before < 0, -1, through)])
                step *= 2
            at = np.append(0, to[:, 0])
            lost = np.flatnonzero(at < 0)
            lost = lost[at[lost - 1] >= 0]
            if not len(lost):
                return tokens[np.arange(n), at]
            before = lost - 1
            add(lost, np.where(is_open[before], goal[before, at[before]], last[before]))

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(UTF-8 bytes, tokens) of each text; null counts as empty."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.special.split(t or "") if self.special else [t or ""]
            extra[i] += len(parts) - 1
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(i)
        tokens = extra
        joined = "".join(pieces)
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if len(cps):
            first = np.zeros(len(cps), bool)
            first[np.cumsum([0, *map(len, pieces[:-1])])] = True
            starts = boundaries(cps, first)
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            place = np.cumsum(width) - width
            data = np.frombuffer(joined.encode(), np.uint8)
            mark = np.zeros(len(data), bool)
            mark[place[starts]] = True
            sums = np.append(0, np.cumsum(self.run(data, mark)))
            begins = np.append(place[first], len(data))
            np.add.at(tokens, owner, sums[begins[1:]] - sums[begins[:-1]])
        return [len((t or "").encode()) for t in texts], tokens.tolist()


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _count_batches(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                n_bytes, n_tokens = machine.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), whole texts.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library, readable on all
    executors; files with another splitter, a normalizer or other settings raise ValueError. Counts are those of encode(text, add_special_tokens=False): special strings in
    a text are one token each. Null and empty texts have no bytes and tokens; repeated rows
    stay; an empty table gives an empty result.
    """
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    counts = kept.mapInArrow(_count_batches(tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
