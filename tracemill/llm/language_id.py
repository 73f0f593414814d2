"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over byte
n-grams tells the languages whose bit is one from the others; it is a smoothed
log-likelihood ratio of n-gram counts, averaged over the text. Decoding takes the codeword
with the least loss, where each bit's loss is weighted by how well its classifier knows
that language's training texts. Losses become shares of belief by a sharpness that grows
with the length of the text, fitted on texts and short pieces of them, each read by the
classifiers of the other half. A text whose two best shares are close is ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, text_slices

UNKNOWN = "und"
#: Texts of each language that the classifiers are fitted on at most, all of each; parts they are dealt to.
SAMPLE, PARTS = 600, 2
#: Characters of the pieces that the sharpness is fitted on, besides whole texts.
PIECES = (4, 8, 16, 32, 64)
ORDERS, TABLE = (2, 3, 5), 1 << 15
SMOOTH, AMBIGUOUS = 0.5, 0.15
BLOCK = 1 << 20


def code_matrix(n: int) -> np.ndarray:
    """Codewords (n, bits) of +-1: all splits of up to seven languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        rows = [b for b in itertools.product((1.0, -1.0), repeat=n) if b[0] > 0 and min(b) < 0]
        return np.array(rows).T
    rng, best, width = np.random.default_rng(1), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width))
        m = m[:, np.abs(m.sum(0)) < n]
        apart = (m.shape[1] - (m @ m.T)[np.triu_indices(n, 1)].max()) / 2
        if best is None or apart > best[0]:
            best = (apart, m)
    return best[1]


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams that end at each byte from ``order`` - 1 on, into the part of the table of that order."""
    if len(data) < order:
        return np.empty(0, np.int64)
    h = np.zeros(len(data) - order + 1, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) + data[k : len(data) - order + 1 + k]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    return h.astype(np.int64) + ORDERS.index(order) * TABLE


def normalised(text: str) -> bytes:
    """Lower case, white space folded to single spaces, a space at both ends."""
    return (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages, bits
    weights: np.ndarray  # table, bits
    scale: np.ndarray  # bits
    shift: np.ndarray  # bits
    trust: np.ndarray  # languages, bits
    sharp: tuple[float, float]  # ln of the sharpness for one n-gram, and its growth with ln of their number

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        """Mean weight of the n-grams for each bit, and their number."""
        return margins_of(self.weights, text)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss (texts, languages) of each codeword."""
        f = margins * self.scale + self.shift
        loss = np.logaddexp(0, -f[:, None, :] * self.codes[None]) * self.trust[None]
        return loss.sum(2) / np.maximum(self.trust.sum(1), 1e-9)[None]

    def decode(self, margins: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Shares of belief (texts, languages)."""
        return _belief(self.losses(margins), n, self.sharp)


def margins_of(weights: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    data, total, n = np.frombuffer(normalised(text), np.uint8), np.zeros(weights.shape[1]), 0
    for i in range(0, len(data), BLOCK):
        for order in ORDERS:
            codes = gram_codes(data[max(0, i - order + 1) : i + BLOCK], order)
            total += weights[codes].sum(0, dtype=np.float64)
            n += len(codes)
    return total / max(1, n), n


def _belief(loss: np.ndarray, n: np.ndarray, sharp: tuple[float, float]) -> np.ndarray:
    s = np.exp(np.clip(sharp[0] + sharp[1] * np.log(np.maximum(n, 1)), -20, 20))
    e = np.exp(-s[:, None] * (loss - loss.min(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def weights_of(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each n-gram for each bit, from counts (languages, table); languages weigh alike."""
    weights = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    mass = counts.sum() / max(1, len(counts))
    for b in range(codes.shape[1]):
        one, zero = (codes[:, b] > 0), (codes[:, b] < 0)
        if one.any() and zero.any():
            p = shares[one].mean(0) * mass + SMOOTH
            q = shares[zero].mean(0) * mass + SMOOTH
            weights[:, b] = np.clip(np.log(p / p.sum()) - np.log(q / q.sum()), -8, 8)
    return weights


def calibrated(model: Model, margins: np.ndarray, n: np.ndarray, at: np.ndarray, whole: np.ndarray) -> Model:
    """``model`` with scale, shift and trust from whole texts and the sharpness from all rows of (margins, n-grams, language)."""
    m, k = margins[whole], at[whole]
    for b in range(model.codes.shape[1]):
        y = model.codes[k, b]
        one, zero = m[y > 0, b], m[y < 0, b]
        if len(one) and len(zero):
            middle, apart = (one.mean() + zero.mean()) / 2, max(one.mean() - zero.mean(), 1e-9)
            model.scale[b], model.shift[b] = 8 / apart, -8 * middle / apart
    f = m * model.scale + model.shift
    for i in range(len(model.languages)):
        right = ((f[k == i] * model.codes[i]) > 0).mean(0) if (k == i).any() else np.ones(model.codes.shape[1])
        model.trust[i] = np.maximum(right - 0.5, 0.01)
    loss = model.losses(margins)

    def cost(sharp: tuple[float, float]) -> float:
        # a weak prior keeps the sharpness finite where all texts are told apart
        belief = _belief(loss, n, sharp)[np.arange(len(at)), at]
        return float(-np.log(np.maximum(belief, 1e-12)).sum() + 0.05 * (sharp[0] ** 2 + sharp[1] ** 2))

    best, width = (0.0, 0.0), (4.0, 1.0)
    for _ in range(8):  # grids around the best point, each a third as wide
        grid = [(best[0] + width[0] * i / 4, best[1] + width[1] * j / 4) for i in range(-4, 5) for j in range(-4, 5)]
        best = min(grid, key=cost)
        width = (width[0] / 3, width[1] / 3)
    model.sharp = best
    return model


def piece_of(text: str, number: int) -> str:
    """A piece of a text, its length and place picked by a number."""
    size = PIECES[number % len(PIECES)]
    at = (number // len(PIECES)) % max(1, len(text) - size + 1)
    return text[at : at + size]


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    lang, score, ambiguous = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if known:
        m, n = zip(*(model.margins(texts[i]) for i in known), strict=True)
        belief = model.decode(np.array(m), np.array(n))
        for i, b in zip(known, belief, strict=True):
            k = int(b.argmax())
            lang[i], score[i] = model.languages[k], float(b[k])
            ambiguous[i] = len(b) > 1 and float(b[k] - np.partition(b, -2)[-2]) < AMBIGUOUS
    return lang, score, ambiguous


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part, cell, n): n-grams of the texts, summed up within a slice."""
    for batch in batches:
        for piece in text_slices(batch, "text"):
            found: dict[tuple[str, int], np.ndarray] = {}
            for t, lang, part in zip(*(piece.column(c).to_pylist() for c in ("text", "lang", "part")), strict=True):
                if has_letter(t):
                    total = found.setdefault((lang, part), np.zeros(TABLE * len(ORDERS), np.int64))
                    data = np.frombuffer(normalised(t), np.uint8)
                    for order in ORDERS:
                        total += np.bincount(gram_codes(data, order), minlength=len(total))
            for (lang, part), total in found.items():
                cell = np.flatnonzero(total)
                cols = [pa.array([lang] * len(cell), pa.string()), pa.array([part] * len(cell), pa.int32()), pa.array(cell.astype(np.int32)), pa.array(total[cell])]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "part", "cell", "n"])


def _margin_batches(held):  # noqa: ANN001, ANN202
    """(lang, whole, n, margins) of each text and a piece of it, by the weights of the other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                out: list[list] = [[], [], [], []]
                for t, lang, part, number in zip(*(piece.column(c).to_pylist() for c in ("text", "lang", "part", "number")), strict=True):
                    for whole, x in ((True, t), (False, piece_of(t, number))):
                        if has_letter(x):
                            m, n = margins_of(held.value[part], x)
                            for to, v in zip(out, (lang, whole, n, m.tolist()), strict=True):
                                to.append(v)
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["lang", "whole", "n", "margins"])

    return run


def train(labelled: DataFrame) -> Model | None:
    """Fit on whole texts of a bounded sample of ``labelled`` (doc_id, text, lang): the SAMPLE ids of each lang with the least hashes.

    N-grams are counted on executors; the driver gets counts of a table of fixed size for each
    language, and one row of margins for each sampled text and piece. Null texts, langs and ids
    and texts without a letter say nothing; of several texts with one id and lang the least
    counts. None without any text.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # Ids are ranked without their texts; SAMPLE of each language are left, so they can be broadcast.
    picked = bounded_sample(rows.select("doc_id", "lang").distinct(), "lang", F.xxhash64("doc_id"), SAMPLE)
    rows = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    number = F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.lit(1 << 40))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int")
    texts = checkpointed(rows.select(F.col("lang").cast("string").alias("lang"), "text", part.alias("part"), number.alias("number")))
    got = texts.mapInArrow(_gram_batches, "lang string, part int, cell int, n long").groupBy("lang", "part", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return None
    codes, size = code_matrix(len(languages)), TABLE * len(ORDERS)
    counts = np.zeros((PARTS, len(languages), size))
    lang = np.searchsorted(np.array(languages, object), np.array(got.column("lang").to_pylist(), object))
    counts[got.column("part").to_numpy(), lang, got.column("cell").to_numpy()] = got.column("n").to_numpy()
    weights = weights_of(counts.sum(0), codes)
    other = [w if (w := weights_of(counts.sum(0) - counts[p], codes)).any() else weights for p in range(PARTS)]
    shared = texts.sparkSession.sparkContext.broadcast(other)  # tables of fixed size
    found = texts.mapInArrow(_margin_batches(shared), "lang string, whole boolean, n long, margins array<double>").orderBy("lang", "whole", "n", "margins").toArrow()
    margins = np.array(found.column("margins").to_pylist()).reshape(-1, codes.shape[1])
    at = np.searchsorted(np.array(languages, object), np.array(found.column("lang").to_pylist(), object))
    model = Model(languages, codes, weights, np.ones(codes.shape[1]), np.zeros(codes.shape[1]), np.ones_like(codes), (0.0, 0.0))
    return calibrated(model, margins, found.column("n").to_numpy(), at, np.array(found.column("whole").to_pylist(), bool))


def identify(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, each after ``prefix``; columns of these names are replaced.

    Whole texts are read, in blocks. A null text, or one without a letter, is `und` with score
    0, as is every text when no labelled row was there to learn from. Repeated rows stay; an
    empty table gives an empty result.
    """
    out = [prefix + c for c in ("lang_pred", "score", "ambiguous")]
    names = [c for c in docs.columns if c not in out]
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang, score, ambiguous = predict(held.value, part.column("text").to_pylist())
                cols = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *out])

    schema = docs.select(names).schema.add(out[0], "string").add(out[1], "double").add(out[2], "boolean")
    return docs.select(names).mapInArrow(run, schema)
