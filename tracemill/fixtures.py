"""Test inputs derived from the raw tables, as SQL text that Spark and DuckDB both run.

The raw texts have neither paragraphs nor marker words; these views give them both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_body": """
SELECT doc_id, lang, source,
  replace(replace(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  replace(replace(replace(replace(replace(
  replace(text, chr(10), chr(10) || chr(10)),
  ' is ', ' import '), ' it ', ' of course '), ' to ', ' oops '), ' der ', ' suppose '), ' en ', ' clearly '),
  ' that ', ' therefore '), ' with ', ' wait '), ' for ', ' alternatively '), ' by ', ' overall '),
  ' this ', ' recall that '), ' are ', ' let me check '), ' was ', ' substituting '),
  ' at ', ' earlier this was wrong '), ' on ', ' the answer is '), ' be ', ' step 2 '),
  ' as ', ' hold on '), chr(10) || 'The ', chr(10) || '1. The ') AS body,
  cast(floor(doc_id / 2) AS bigint) AS k
FROM documents
""",
    "fx_trace": """
SELECT doc_id, k, lang AS domain, body AS reasoning, cast(length(body) AS int) AS reasoning_chars,
  CASE WHEN k % 3 = 0 AND doc_id % 2 = 0 THEN 'deepseek'
       WHEN k % 3 = 0 THEN 'glm'
       WHEN k % 8 = 0 THEN 'claude46_ti'  WHEN k % 8 = 1 THEN 'claude47_ti'
       WHEN k % 8 = 2 THEN 'nohurry_opus' WHEN k % 8 = 3 THEN 'gemini'
       WHEN k % 8 = 4 THEN 'kimi'         WHEN k % 8 = 5 THEN 'qwen'
       WHEN k % 8 = 6 THEN 'angrygiraffe' ELSE 'roman_claude' END AS dataset,
  CASE WHEN k % 3 = 0 AND k % 10 <> 9 THEN concat('p', cast(k AS varchar(20)))
       ELSE concat('d', cast(doc_id AS varchar(20))) END AS uid,
  CASE WHEN doc_id % 2 = 0 THEN concat('Problem  ', cast(k AS varchar(20)), chr(10), 'Find IT ')
       ELSE concat(' problem ', cast(k AS varchar(20)), ' find  it') END AS problem,
  CASE WHEN doc_id % 10 = 9 THEN body
       WHEN doc_id % 10 = 8 THEN concat('<THINKING>', chr(10), body, chr(10), '</thinking> Answer ', cast(doc_id AS varchar(20)))
       WHEN doc_id % 10 = 7 THEN concat('pre <think>', body)
       WHEN doc_id % 10 = 6 THEN concat('pre <think>', body, '</think> mid </think> end')
       ELSE concat('<think>', body, '</think>', chr(10), 'Answer ', cast(doc_id AS varchar(20))) END AS output
FROM fx_body
""",
    "fx_judgment": """
SELECT doc_id, k, dataset, uid, judge,
  CASE WHEN ccr IS NULL THEN 'error' ELSE 'judged' END AS status, ccr AS ccr_closure,
  CASE WHEN ccr IS NULL THEN NULL WHEN ccr > 0 OR doc_id % 4 = 0 THEN 1 ELSE 0 END AS critique_present,
  CASE WHEN ccr IS NOT NULL THEN least(3, ccr) END AS monitoring_control_coupling,
  CASE WHEN ccr >= 4 THEN 2 WHEN ccr >= 2 THEN 1 WHEN ccr IS NOT NULL THEN 0 END AS causal_depth_of_critique,
  CASE WHEN ccr IS NULL THEN NULL WHEN ccr >= 4 THEN 'final' WHEN ccr >= 2 THEN 'intermediate' ELSE 'none' END AS answer_change,
  CASE WHEN ccr IS NULL THEN NULL WHEN doc_id % 5 = 0 THEN 'tree' WHEN doc_id % 7 = 0 THEN 'loop' WHEN doc_id % 11 = 0 THEN 'drift' ELSE 'chain' END AS reasoning_topology,
  CASE WHEN ccr IS NULL OR ccr >= 3 THEN NULL WHEN doc_id % 3 = 0 THEN 'surface_marker_only'
       WHEN doc_id % 3 = 1 THEN 'local_patch_only' ELSE 'no_answer_change' END AS failure_type,
  CASE WHEN ccr IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS early_assertion,
  CASE WHEN ccr IS NULL THEN NULL WHEN ccr >= 3 AND doc_id % 2 = 1 THEN 1 ELSE 0 END AS overthrow_present,
  CASE WHEN ccr IS NULL THEN NULL WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS templated_divergence
FROM (
  SELECT t.doc_id, t.k, t.dataset, t.uid, j.judge,
    CASE WHEN t.doc_id % 50 = 49 AND j.shift <> 0 THEN NULL
         ELSE cast(least(4, greatest(0, (t.k * 7 + 3) % 5 + CASE WHEN t.dataset = 'glm' THEN t.doc_id % 3
              WHEN t.dataset = 'deepseek' AND t.k % 7 = 0 THEN 2 ELSE 0 END
              + j.shift * (t.doc_id % 3 - 1))) AS int) END AS ccr
  FROM fx_trace t CROSS JOIN (SELECT 'a' AS judge, 0 AS shift UNION ALL SELECT 'b', 1 UNION ALL SELECT 'c', -1) j
) q
""",
    "fx_judge_raw": """
SELECT doc_id,
  CASE WHEN doc_id % 4 = 0 THEN concat('```json', chr(10), '{"ccr_closure": ', cast(doc_id % 6 AS varchar(20)), ', "reasoning_topology": "chain"}', chr(10), '```')
       WHEN doc_id % 4 = 1 THEN concat('{"ccr_closure": ', cast(doc_id % 6 AS varchar(20)), ', "reasoning_topology": "star"}')
       WHEN doc_id % 4 = 2 THEN concat('Sure: {"ccr_closure": ', cast(doc_id % 6 AS varchar(20)), '} done')
       ELSE 'no object here' END AS content
FROM fx_body
""",
    "fx_conv": """
SELECT conv_id,
  min_by(text, turn) FILTER (WHERE role = 'user') AS problem,
  min_by(text, turn) FILTER (WHERE role = 'assistant') AS assistant
FROM conversations GROUP BY conv_id
""",
}
NEEDS = {"fx_trace": ("fx_body",), "fx_judgment": ("fx_body", "fx_trace"), "fx_judge_raw": ("fx_body",)}
RAW = ("documents", "conversations", "labels", "benchmark")


def ctes(*names: str) -> str:
    """``name AS (...)`` of the views and all they need."""
    order = [v for v in VIEWS if v in names or any(v in NEEDS.get(n, ()) for n in names)]
    return ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are cores: then it is small, or lies in row groups that one task reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RAW}
    # Views of our own names, so that those of the caller stay as they are.
    for t, df in tables.items():
        (spread(df) if t == "documents" else df).createOrReplaceTempView(f"fx_raw_{t}")
    raw = ", ".join(f"{t} AS (SELECT * FROM fx_raw_{t})" for t in RAW)
    return spark.sql(f"WITH {raw}, {ctes(name)} SELECT * FROM {name}")
