"""Layouts, sinks and the incremental ingest on small files."""

import json

from pyspark.sql import functions as F

from tracemill.operators import sampling
from tracemill.sources import layouts
from tracemill.streaming import ingest

RECORDS = {
    "glm": {"id": "1", "input": "p", "output": "<think>r</think>a", "domain": "d", "meta": {"teacher_model": "m"}},
    "claude46_ti": {"id": "1", "input": "p", "inverted_reasoning": " r ", "output": "a"},
    "gemini": {"original_input": {"text": "p", "domain": "d", "difficulty": "x"}, "model_thoughts": "r", "model_response": "a"},
    "nohurry_opus": {"hash": "h", "problem": "p", "thinking": "r", "solution": "a", "category": "d", "difficulty": "x"},
    "angrygiraffe": {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "<think>r</think>a"}]},
    "roman_claude": {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}], "metadata": {"model": "m"}},
}


def put(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def test_layouts(spark, tmp_path):
    for dataset, record in RECORDS.items():
        folder = tmp_path / dataset
        put(folder, "a.jsonl", [json.dumps(record), "", "{broken", "null"])
        got = layouts.read_traces(spark, str(folder), dataset).where("problem <> ''").collect()
        assert [(r.problem, r.reasoning) for r in got] == [("p", "r")], dataset


def test_missing_fields_are_empty(spark, tmp_path):
    put(tmp_path, "a.jsonl", ["{}", '{"messages": [{"role": "user", "content": [1]}, {"role": "user", "content": "later"}]}'])
    for dataset in RECORDS:
        for r in layouts.read_traces(spark, str(tmp_path), dataset).collect():
            assert r.problem == "" and r.reasoning_chars == 0


def test_file_filter(spark, tmp_path):
    put(tmp_path, "keep.jsonl", ['{"input": "a"}'])
    put(tmp_path, "other.jsonl", ['{"input": "b"}'])
    assert [r.problem for r in layouts.read_traces(spark, str(tmp_path), "glm", "keep").collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", "d", i) for i in range(12)], "uid string, dataset string, doc_id int")
    layouts.write_batches(sampling.batches(df, ["doc_id"]), str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert back.groupBy("batch_id").count().count() == 3
    for _ in range(2):
        layouts.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 24
    layouts.index_by_uid(df, str(tmp_path / "ix"), 2)
    assert spark.read.parquet(str(tmp_path / "ix")).where(F.col("uid") == "u3").count() == 1


def test_score_arrays(spark, tmp_path):
    put(tmp_path / "s", "a.json", ['[{"uid": "x", "ccr_closure": 1}, {"uid": "y", "ccr_closure": null}]'])
    put(tmp_path / "s", "b.json", ["oops"])
    got = layouts.read_score_arrays(spark, str(tmp_path / "s"), "uid string, ccr_closure int").collect()
    assert [(r.file, r.pos, r.uid) for r in got if r.uid] == [("a.json", 0, "x"), ("a.json", 1, "y")]


def test_incremental_ingest(spark, tmp_path):
    small = spark.createDataFrame([("s1", "P  1", 1), ("s2", "p 1", 2)], "uid string, problem string, pos int")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    put(tmp_path / "src", "1.jsonl", ['{"id": "a", "input": "p 1"}', '{"id": "b", "input": "zzz"}'])
    run = lambda: ingest.run_available(ingest.pair_stream(ingest.trace_stream(spark, src, "glm"), small, "pos"), out, ck)
    run()
    put(tmp_path / "src", "2.jsonl", ['{"id": "c", "input": "P 1"}'])
    run()
    got = spark.read.parquet(out).collect()
    assert sorted((r.ds_id, r.glm_id) for r in got) == [("s2", "a"), ("s2", "c")]
