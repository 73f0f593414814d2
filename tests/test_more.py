"""Reading order, judge backends, SQL functions, reports on small tables, statistics against closed forms, and the command line."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill import lexicons as lx
from tracemill.functions import text as t
from tracemill.operators import judging, pairing, reports, stats
from tracemill.sources import layouts


def test_reading_in_file_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": f"{name}{i}", "input": "p"}) for i in range(30)))
    got = layouts.read_traces(spark, str(tmp_path), "glm").orderBy("src_file", "src_pos").collect()
    want = [f"{n}{i}" for n in "ab" for i in range(30)]
    assert [r.uid for r in got] == want
    assert [r.uid for r in layouts.read_traces(spark, str(tmp_path), "glm", limit=33).orderBy("src_file", "src_pos").collect()] == want[:33]
    assert layouts.read_traces(spark, str(tmp_path), "glm", ["a.js", "zzz"]).count() == 30


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def chat(script, n=2, **options):
    """A backend whose endpoints answer by ``script``, a list of results for each call in order."""
    clock, calls = Clock(), []

    def transport(endpoint, request):
        calls.append(endpoint.key)
        got = script[len(calls) - 1]
        if isinstance(got, Exception):
            raise got
        return {"choices": [{"message": {"content": got}}]}

    return judging.Chat([judging.Endpoint("http://judge", "m", f"k{i}") for i in range(n)], transport, clock=clock, sleep=clock.sleep, **options), calls, clock


def test_chat_takes_endpoints_in_turn():
    ask, calls, clock = chat(["a", "b", "c"])
    assert [ask("p") for _ in range(3)] == ["a", "b", "c"] and calls == ["k0", "k1", "k0"] and not clock.slept


def test_busy_endpoints_rest_ever_longer():
    busy = judging.Busy()
    ask, calls, clock = chat([busy, "a", "b", busy, busy, "c"], cooldown=10)
    assert ask("p") == "a" and calls == ["k0", "k1"]
    assert ask("p") == "b" and calls[-1] == "k1"  # the first one rests
    assert ask("p") == "c"
    assert calls == ["k0", "k1", "k1", "k1", "k0", "k1"] and clock.slept == [10, 0.0] or sum(clock.slept) >= 10


def test_retry_after_and_errors():
    ask, calls, clock = chat([judging.Busy(after=7), "a"], n=1)
    assert ask("p") == "a" and clock.slept == [7]
    ask, calls, _ = chat([ValueError("x"), "a"])
    assert ask("p") == "a" and calls == ["k0", "k1"]
    ask, _, _ = chat([ValueError("x")] * 3, tries=3)
    with pytest.raises(ValueError, match="x"):
        ask("p")


def test_errors_stay_with_their_rows(spark):
    judging.file_backend("nothing", {})
    traces = spark.createDataFrame([("d", "u", "p", "r", "a")], "dataset string, uid string, problem string, reasoning string, answer string")
    (row,) = judging.call(traces, "nothing").collect()
    assert row.content is None and row.error.startswith("KeyError")
    assert judging.judge(traces, "nothing").first().status == "error"


def test_sql_functions(spark):
    t.register_sql(spark)
    df = spark.createDataFrame([("  Ｐroblem  One\n",), ("wait, let me check",), (None,), ("",)], "x string")
    got = df.selectExpr("normalize_problem(x) a", "problem_hash(x) b", "derived_uid(x) c", "critique_density(x) d").collect()
    want = df.select(t.normalize_problem("x").alias("a"), t.problem_hash("x").alias("b"), t.derived_uid("x").alias("c"), t.density("x", lx.DENSITY_B).alias("d")).collect()
    assert got == want


def test_commonest_and_top_five(spark):
    rows = [("d", x) for x, n in (("a", 1), ("b", 3), ("c", 2), ("e", 2), ("f", 5), ("g", 1), ("h", 1)) for _ in range(n)] + [("d", None), ("e", "z")]
    df = spark.createDataFrame(rows, "dataset string, failure_type string")
    top = {(r.dataset, r.failure_type): r["rank"] for r in reports.histogram(df, "dataset", "failure_type", 5).collect()}
    assert top == {("d", "f"): 1, ("d", "b"): 2, ("d", "c"): 3, ("d", "e"): 4, ("d", "a"): 5, ("e", "z"): 1}
    got = {r.dataset: r.failure_type for r in reports.commonest(df, "dataset", "failure_type", 5).collect()}
    assert got == {"d": "f:5,b:3,c:2,e:2,a:1", "e": "z:1"}


def test_the_last_row_of_a_pair_counts_whole(spark):
    rows = [(1, "a", 1, 5, "x"), (1, "a", 2, 1, None), (1, "b", 3, 2, "y"), (2, "a", 4, 2, "z")]
    df = spark.createDataFrame(rows, "k long, dataset string, pos long, score int, topo string")
    assert [tuple(r) for r in reports.paired(df, "k", "a", "b", ["score", "topo"], "pos").collect()] == [(1, 1, 2, None, "y")]


def test_missing_places_of_a_panel(spark):
    items = spark.createDataFrame([("f", i, f"u{i}") for i in range(3)] + [("g", 0, "v")], "file string, pos int, uid string")
    a = spark.createDataFrame([("f", 0, 1), ("f", 1, None), ("f", 2, 3), ("g", 0, 2)], "file string, pos int, ccr_closure int")
    b = a.where("file = 'g'")
    rows = lambda strict: sorted((r.uid, r.a, r.b) for r in pairing.panel(items, {"a": a, "b": b}, strict=strict).collect())
    assert rows(False) == [("u0", 1, None), ("u1", None, None), ("u2", 3, None), ("v", 2, 2)]
    assert rows(True) == [("v", 2, 2)]
    assert {r.file: r.complete for r in pairing.judged_files(items, a).collect()} == {"f": False, "g": True}


def test_lookup_takes_the_last(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "uid string, pos int")
    assert [(r.uid, r.pos) for r in pairing.lookup(df, df.where("uid = 'a'"), last="pos").collect()] == [("a", 3)]


def test_tails_of_distributions(spark):
    zs = [0.0, 0.3, -1.0, 1.96, 4.0, 7.0, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(stats.two_sided_p("z")).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=1e-12)
    # two degrees of freedom: exp(-x / 2); one: that of a normal score
    xs = [0.0, 0.5, 3.0, 20.0, 60.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(stats.chi2_p(F.col("x"), F.lit(2)), stats.chi2_p(F.col("x"), F.lit(1))).collect()
    assert [r[0] for r in got] == pytest.approx([math.exp(-x / 2) for x in xs], abs=1e-12)
    assert [r[1] for r in got] == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in xs], abs=1e-12)


@pytest.mark.parametrize("values", [[3.5] * 40, [0.1 * i for i in range(200)], [1, 1, 2, 2, 2, 9]])
def test_counts_below(spark, values):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in values] + [(None, 1.0)], "g string, v double")
    levels = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
    got = {(r.g, r.v): r.s for r in stats.counted_below(levels, ["g"], "v", F.col("k"), "s").collect()}
    assert got == {(g, float(v)): sum(x < v for x in values) for g in "ab" for v in values} | {(None, 1.0): 0}


def test_places_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(g, i) for g, n in (("a", 500), ("b", 3)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(7)
    assert all(r.place == r.i for r in stats.places(df, ["g"], ["i"], "place").collect())


PATTERNS = {k: v for k, v in vars(lx).items() if k.isupper() and isinstance(v, str)} | {f"action {k}": v for k, v in lx.ACTIONS.items()} | {f"format {k}": v for k, v in lx.FORMATS.items()}


def words_of(pattern):
    return re.findall(r"[A-Za-z]{3,}|[一-鿿]+", re.sub(r"\\[a-zA-Z]", " ", pattern))


def test_all_patterns_mean_what_they_mean_in_python(spark):
    rng = random.Random(2)
    pool = sorted({w for p in PATTERNS.values() for w in words_of(p)}) + ["é", "ſ", "K", "1.", "2)", "- ", "|", "x = 3", "```", "\n", " ", ".", ",", "$a$", "step 4", "equation 12", "naïve", "<think>", "</think>", " "]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice(pool).capitalize() for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").coalesce(1)
    cols = [t.count_matches("x", p).alias(f"c{k}") for k, p in enumerate(PATTERNS.values())]
    got = df.select("i", *cols).orderBy("i").collect()
    for k, (name, p) in enumerate(PATTERNS.items()):
        mine, want = [r[k + 1] for r in got], [len(re.findall(p, x)) for x in texts]
        assert mine == want, (name, [x for x, a, b in zip(texts, mine, want, strict=True) if a != b][:2])


def test_command_line(spark, tmp_path):
    from tracemill.__main__ import main

    src, path = tmp_path / "src", lambda x: str(tmp_path / x)
    src.mkdir()
    lines = [json.dumps({"id": f"u{i}", "input": f"problem {i}", "output": f"<think>{'wait, that is wrong. ' * 20}</think>{i}"}) for i in range(12)]
    (src / "a.jsonl").write_text("\n".join(lines))
    main(["traces", "--dataset", "glm", "--path", str(src), "--out", path("traces")])
    main(["metrics", "--traces", path("traces"), "--out", path("metrics")])
    main(["sample", "--traces", path("traces"), "--n", "7", "--out", path("sample")])
    main(["batches", "--traces", path("sample"), "--out", path("batches")])
    main(["judge", "--traces", path("sample"), "--out", path("judged")])
    main(["judge", "--traces", path("traces"), "--done", path("judged"), "--out", path("judged")])
    main(["report", "--judged", path("judged"), "--out", path("report")])
    main(["pair", "--small", path("traces"), "--large", path("traces"), "--out", path("pairs")])
    main(["index", "--traces", path("traces"), "--files", "2", "--out", path("index")])
    assert spark.read.parquet(path("metrics")).where("oed > 0").count() <= 12
    assert spark.read.json(path("batches")).select("batch_id").distinct().count() == 2
    judged = spark.read.json(path("judged"))
    assert judged.count() == 12 and judged.select("uid").distinct().count() == 12
    assert spark.read.json(path("report")).first().n_judged == 12
    assert spark.read.parquet(path("pairs")).count() == 12 and spark.read.parquet(path("index")).count() == 12
