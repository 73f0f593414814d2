"""Embedding and SimHash near-dedup, top-k, mixing and the pipeline against brute force and odd inputs."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.compare import connect, rows
from tests.llm.conftest import ODD

from tracemill.llm import components, embedding_dedup, mixing, queries, simhash, topk


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = roots(1061, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def planted(n=400, dim=64, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 100, 4):
        noise = rng.normal(size=dim)
        x[i + 1] = x[i] + noise * np.linalg.norm(x[i]) / np.linalg.norm(noise) * rng.uniform(0.2, 0.5)
    x[n - 90 : n - 50] = x[n - 90] + rng.normal(size=(40, dim)) * 0.1  # a large group
    x[n - 40 : n - 20] = x[n - 40]  # copies
    return x.astype(np.float32)


def test_embedding_near_dedup(spark):
    x = planted()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    from tracemill.session import ship

    ship(spark)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = sum(r.n_links for r in got.values())
    assert links == near.sum()
    assert all(got[i].n_links == near[i].sum() for i in got)
    assert [got[i].component_id for i in range(len(x))] == roots(len(x), zip(*np.nonzero(near), strict=True))


@pytest.mark.parametrize(("dim", "least"), [(16, 0.995), (64, 0.995), (256, 0.98)])
def test_recall_of_buckets_at_the_threshold(dim, least):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)  # cosine 0.9 to the digit
    table, _ = embedding_dedup._first_shared(embedding_dedup.buckets(a), embedding_dedup.buckets(b))
    assert (table < embedding_dedup.TABLES).mean() >= least


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    test_embedding_near_dedup(spark)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    return spark.createDataFrame([(i, v, "x") for i, v in rows_], "vec_id long, embedding array<double>, rep string")


def test_embedding_odd(spark):
    df = odd_vectors(spark)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 3, 7), (7, 3, 7), (8, 3, 7), (9, 3, 7), (10, 0, 10)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("rows_", "pairs"), [(2, 1 << 16), (512, 3), (1, 1)])
def test_embedding_chains_over_chunks(monkeypatch, rows_, pairs):
    monkeypatch.setattr(embedding_dedup, "ROWS", rows_)
    monkeypatch.setattr(embedding_dedup, "PAIRS", pairs, raising=False)
    monkeypatch.setattr(embedding_dedup, "buckets", lambda x: np.zeros((len(x), embedding_dedup.TABLES, 1), np.int64))
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n, angle = 40, np.deg2rad(20)  # neighbours on a chain have a cosine over 0.9, others don't
        chain = np.repeat(np.arange(4), 10)
        x = np.zeros((n, 8))
        x[np.arange(n), 2 * chain], x[np.arange(n), 2 * chain + 1] = np.cos(np.arange(n) % 10 * angle), np.sin(np.arange(n) % 10 * angle)
        x, ids = x[rng.permutation(n)], rng.permutation(n)
        near = (x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)
        members = [{"rep": int(i), "copies": 1, "block": 0, "embedding": v.tolist()} for i, v in zip(ids, x, strict=True)]
        kind = pa.list_(pa.struct([("rep", pa.int64()), ("copies", pa.int64()), ("block", pa.int32()), ("embedding", pa.list_(pa.float64()))]))
        batch = pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([members], kind)], names=["t", "bucket", "i", "j", "members"]
        )
        (got,) = embedding_dedup._verify_batches(8, 0.9)(iter([batch]))
        assert dict(zip(got["rep"].to_pylist(), got["links"].to_pylist(), strict=True)) == {int(i): int(k) for i, k in zip(ids, near.sum(1), strict=True) if k}
        want = roots(n, [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near), strict=True)])
        assert roots(n, zip(got["rep"].to_pylist(), got["root"].to_pylist(), strict=True)) == want


def best(x, ids, k, modulus):
    out = []
    for q in np.flatnonzero(ids % modulus == 0):
        s = [(-int(x[q] @ x[c]), int(ids[c])) for c in range(len(x)) if ids[c] != ids[q]]
        out += [(int(ids[q]), r + 1, i, -v) for r, (v, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [0, 64])
def test_topk(spark, monkeypatch, size):
    if size:  # many small blocks
        for name in ("BLOCK", "QUERIES", "LONGEST"):
            monkeypatch.setattr(topk, name, size if name != "QUERIES" else 3)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(600, 16)) * rng.lognormal(size=(600, 1)), 1)
    v[100:130] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, 10, 20).collect())
    assert got == best(np.floor(1024 * v).astype(np.int64), np.arange(600), 10, 20)


@pytest.mark.parametrize("equal", [False, True])
def test_topk_sends_the_driver_no_more_from_more_partitions(spark, equal):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(40_000, 16)), 2)
    if equal:
        v = np.sign(v) + (v == 0)
    ids = np.arange(40_000)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(v.tolist())})).repartition(16)
    conf = spark.sparkContext._jsc.sc().conf()
    held = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")  # 16 times 2,048 rows take 5 MB
    try:
        got = sorted(tuple(r) for r in topk.top_k(df, 10, 10_000).collect())
    finally:
        conf.set("spark.driver.maxResultSize", held)
    assert got == best(np.floor(1024 * v).astype(np.int64), ids, 10, 10_000)


def test_topk_prunes(monkeypatch):
    rng, multiplied = np.random.default_rng(5), []
    product = topk._product
    monkeypatch.setattr(topk, "_product", lambda q, c: multiplied.append(len(q) * len(c)) or product(q, c))
    monkeypatch.setattr(topk, "RUN", 64)
    x = np.floor(1024 * rng.normal(size=(3000, 16)) * rng.lognormal(sigma=1.5, size=(3000, 1)) * np.linspace(3, 0.1, 16)).astype(np.int64)
    axes = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1].copy()
    ids = np.arange(3000)
    got, scores = topk.search(5, x[:40], ids[:40], np.full(40, topk.NONE), x, ids, axes)
    for q in range(40):
        want = sorted(((-int(x[q] @ x[c]), c) for c in range(3000) if c != q))[:5]
        assert [(-s, i) for s, i in zip(scores[q].tolist(), got[q].tolist(), strict=True)] == want
    assert sum(multiplied) < 0.2 * 40 * 3000


def test_topk_odd(spark):
    df = odd_vectors(spark)
    got = sorted(tuple(r) for r in topk.top_k(df, 3, 7).collect())
    assert [g[2:] for g in got if g[0] == 7][:1] == [(8, 2 << 20)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 10"), 3, 5).count() == 0


def test_topk_query_against_sql(spark, sf):
    assert rows(queries.op6_exact_topk(spark, sf).toPandas()) == rows(connect(sf).sql(queries.oracle_sql()["op6_exact_topk"]).df())


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(docs, column="doc_id"):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = np.array([fingerprint(t) for _, t in texts], np.uint64)
    root = roots(len(texts), zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3), strict=True))
    ids = {}
    for (i, _), r in zip(texts, root, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted((repr(i), f"{int(p):016x}", repr(ids.get(r))) for (i, _), p, r in zip(texts, prints, root, strict=True))
    assert sorted((repr(r.doc_id), r.f, repr(r.component_id)) for r in got) == want


def test_simhash(documents, odd, none, without_ids):
    for docs in (documents, odd, without_ids):
        check_simhash(docs)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_of_close_prints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60)
    prints = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce([1 << rng.integers(0, 63, len(base)) for _ in range(k)]) for k in (1, 2, 3, 4, 5)]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    got = components.connected_components(simhash.links(spark.createDataFrame([(int(p),) for p in prints], "fp long")), "u", "v")
    root = roots(len(prints), zip(*np.nonzero(near), strict=True))
    want = {int(prints[i]): int(prints[root[i]]) for i in range(len(prints)) if near[i].sum() > 1}
    assert {r.node: r.component for r in got.collect()} == want


def test_keep_one(spark, odd):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (2, "A b c d"), (3, "z y x w v"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(docs).collect()) == [0, 1, 3]
    assert simhash.keep_one(odd).columns == odd.columns


def test_keep_one_of_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven", "quite another text that shares no words"
    rows_ = [(3, a), (5, a), (5, b), (None, b), (None, "alone here"), (None, "alone here"), (7, "same id"), (7, "same ID"), (7, "other words"), (8, None), (9, ""), (None, " ")]
    for order in (1, -1):
        docs = spark.createDataFrame(rows_[::order], "doc_id long, text string")
        got = sorted(((r.doc_id or 0), r.text) for r in simhash.keep_one(docs).collect() if r.doc_id != 7 and r.text is not None)
        assert got == [(0, "alone here"), (3, a), (5, b)]
        assert sorted((r.text or "").lower() for r in simhash.keep_one(docs).collect() if r.doc_id in (7, 8)) == ["", "other words", "same id"]
    text_ids = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert simhash.keep_one(text_ids).count() == 6


def test_similar_texts_in_small_tiles_and_blocks(spark, documents, monkeypatch):
    from tracemill.llm import simhash_verified

    for name, size in (("TILE", 16), ("ROWS", 5), ("COLUMNS", 7), ("SETS", 400)):
        monkeypatch.setattr(simhash_verified, name, size)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 100)]
    made = [(10_000 + k, " ".join("x" if rng.random() < k / 1500 else w for w in base)) for k in range(60)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == kept_by_jaccard(docs.orderBy("doc_id").collect())


def test_wide_fingerprints_of_similar_sets_lie_within_the_radius():
    from tracemill.llm.simhash_verified import HALF, RADIUS, wide_fingerprint

    rng, near = np.random.default_rng(10), []
    for common, a, b in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (20, 5, 0), (40, 5, 5), (400, 100, 0), (400, 50, 50)):
        for _ in range(300):
            x = rng.integers(0, 1 << 63, common + a + b, np.uint64)
            p, q = wide_fingerprint(x[: common + a]), wide_fingerprint(np.concatenate([x[:common], x[common + a :]]))
            apart = np.bitwise_count(p ^ q)
            near.append(apart.sum() <= RADIUS and apart[: len(apart) // 2].sum() <= HALF)
    assert np.mean(near) > 0.999
    far = np.array([wide_fingerprint(rng.integers(0, 1 << 63, 50, np.uint64)) for _ in range(300)])
    assert np.bitwise_count(far[:, None] ^ far[None, :]).sum(2)[np.triu_indices(300, 1)].min() > RADIUS


def shingles_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_jaccard(docs):
    sets = [shingles_of(r.text) for r in docs]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    root = roots(len(docs), near)
    return [r.doc_id for i, r in enumerate(docs) if root[i] == i]


@pytest.mark.parametrize("group", [1, 60])
def test_pipeline_keeps_one_of_similar_texts(spark, documents, group):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = [" ".join("x" if rng.random() < k / 200 else w for w in base) for _ in range(group) for k in (0, 2, 4, 6, 9)]
    made = [(10_000 + i, t) for i, t in enumerate(texts)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == kept_by_jaccard(docs.orderBy("doc_id").collect())


# Mixing


def test_raking_meets_targets(spark, documents):
    cells = mixing.cells_of(mixing.with_cells(documents))
    targets = {m: mixing.tempered_targets(cells, m, 0.5) for m in mixing.MARGINS}
    raked = mixing.rake(cells, targets, 1e-8).toPandas()
    for m, t in targets.items():
        want = t.toPandas().set_index(m).target
        assert np.allclose(raked.groupby(m).raked.sum()[want.index], want, atol=1e-6)


def test_residuals_and_budget(documents, monkeypatch):
    rows_ = mixing.with_cells(documents)
    cells = mixing.cells_of(rows_)
    targets = {m: mixing.tempered_targets(cells, m) for m in mixing.MARGINS}
    assert all(r.residual < 1e-9 for r in mixing.residuals(mixing.rake(cells, targets), targets).collect())
    total = cells.toPandas().weight.sum()
    monkeypatch.setattr(mixing, "rake", lambda *a, raked=mixing.rake(cells, targets).cache(): raked)
    for budget in (0.01 * total, 0.9 * total, 2 * total):
        got = rows_.join(mixing.chances(rows_, None, budget), list(mixing.MARGINS)).toPandas()
        assert got.probability.between(0, 1).all()
        assert (got.tokens * got.probability).sum() == pytest.approx(min(budget, total), rel=1e-3)


def test_targets_that_exclude_each_other_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "t", 1.0, 1), ("b", "x", "t", 1.0, 1), ("b", "y", "t", 1.0, 1)], "source string, lang string, topic string, weight double, docs long")
    table = lambda name, d: spark.createDataFrame(list(d.items()), f"{name} string, target double")
    targets = {"source": table("source", {"a": 0.8, "b": 0.2}), "lang": table("lang", {"x": 0.5, "y": 0.5})}
    with pytest.warns(UserWarning, match="largest distances"):
        mixing.rake(cells, targets, rounds=3)


def test_given_targets(spark, documents):
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double")}
    got = mixing.mix(documents, targets).toPandas()
    assert (got[~got.lang.isin(["en", "de"])].probability == 0).all()
    share = (got.tokens * got.probability).groupby(got.lang).sum()
    assert share["en"] == pytest.approx(share["de"])


def test_mixing_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.probability <= 1 for r in got)
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


def test_sample_keeps_what_mix_keeps(documents):
    kept = sorted(r.doc_id for r in mixing.mix(documents).where("kept").collect())
    assert sorted(r.doc_id for r in mixing.sample(documents).collect()) == kept


def test_mixing_query_against_sql(spark, sf):
    assert rows(queries.op5_mixing(spark, sf).toPandas()) == rows(connect(sf).sql(queries.oracle_sql()["op5_mixing"]).df())


# Pipeline


def test_stages_on_odd_input(spark, odd, none, sf):
    import corpus_pipeline

    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, none, odd.select(base), none.select(base)):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()


def test_pipeline_against_brute_force(spark, sf, documents):
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken
    from tests.llm.test_text_operators import base_spans
    from tracemill.llm import byte_bpe

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = documents.orderBy("doc_id").collect()
    told = set(kept_by_jaccard(docs))
    left = [r for r in docs if r.doc_id in told]

    def redacted(text):
        out, at = "", 0
        for s in filter(None, base_spans(text).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        return out + text[at:]

    clean = spark.createDataFrame([(r.doc_id, redacted(r.text), r.lang, r.source) for r in left], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in mixing.mix(clean).where("kept").collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(got) == kept
    for r in left:
        if r.doc_id in kept:
            assert byte_bpe.unpack(bytes(got[r.doc_id].ids)) == enc.encode_ordinary(redacted(r.text))
