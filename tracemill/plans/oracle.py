"""DuckDB forms of the registered queries, written apart from the Spark plans: metrics go
through one row for each paragraph here, where Spark folds arrays."""

from __future__ import annotations

from .. import lexicons as lx
from ..fixtures import ctes

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{4,}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(pattern: str, c: str = "p") -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def count(pattern: str, c: str = "reasoning") -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def case(patterns: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(p)} THEN '{k}'" for k, p in patterns.items()) + f" ELSE '{otherwise}' END"


FX = f"WITH {ctes('fx_trace')}"
FJ = f"WITH {ctes('fx_trace', 'fx_judgment')}"
PARAS = f"list_filter(list_transform(regexp_split_to_array(reasoning, '\\n\\s*\\n'), lambda x: {strip('x')}), lambda x: x <> '')"
MARKS = f"""
doc AS (SELECT *, {PARAS} AS ps FROM fx_trace),
para AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS j, len(ps) AS n FROM doc),
mark AS (SELECT *, {hit(lx.CRITIQUE)} AS critique, {hit(lx.ASSERTION)} AS assertion, {hit(lx.BACKREF)} AS backref, {hit(lx.CAUSAL)} AS causal,
  {hit(lx.BRANCH)} AS branch, {hit(lx.MERGE)} AS merge, TRY_CAST(nullif(regexp_extract(p, {q(lx.STEP)}, 1), '') AS INT) AS step,
  {case(lx.ACTIONS, "OTHER")} AS action, {case(lx.FORMATS, "prose")} AS format FROM para)
"""
FM = f"{FX}, {MARKS}"
BY_DOC = "FROM doc d LEFT JOIN ({}) x USING (doc_id)"
EDGES = """
edge AS (SELECT doc_id, j - 1 AS src, j AS dst FROM mark WHERE j > 0 AND (causal OR branch OR merge)
  UNION ALL SELECT doc_id, coalesce(step, greatest(j - 3, 0)) AS src, j AS dst FROM mark WHERE backref AND coalesce(step, greatest(j - 3, 0)) BETWEEN 0 AND j - 1)
"""


def density(pattern: str) -> str:
    return f"1000.0 * {count(pattern)} / greatest(length(reasoning) / 4.0, 1.0)"


PDD = "SELECT doc_id, avg(CASE WHEN step IS NULL THEN 3 ELSE j - step END) AS v FROM mark WHERE backref AND (step IS NULL OR j - step > 0) GROUP BY doc_id"
EAR = "SELECT doc_id, avg(CASE WHEN assertion THEN 1.0 ELSE 0.0 END) AS v FROM mark WHERE n >= 5 AND j < greatest(1, n // 5) GROUP BY doc_id"
TOPO = """SELECT doc_id, CASE WHEN any_value(n) >= 3 THEN sum((causal AND j > 0)::INT + backref::INT + branch::INT + merge::INT)::DOUBLE / any_value(n) END AS density,
  CASE WHEN any_value(n) >= 3 THEN sum(branch::INT)::DOUBLE / greatest(sum(merge::INT), 1) END AS ratio,
  CASE WHEN any_value(n) >= 3 AND bool_or(backref) THEN 3.0 ELSE 0.0 END AS depth FROM mark GROUP BY doc_id"""
OED = f"CASE WHEN {count(lx.CHUNK)} >= 100 THEN 1000.0 * {count(lx.OVERTHROW)} / {count(lx.CHUNK)} END"
CE = f"CASE WHEN {count(WORD)} > 0 THEN {count(lx.LOGIC)}::DOUBLE / {count(WORD)} END"
NRR = f"CASE WHEN {count(WORD)} > 0 THEN 1000.0 * {count(lx.NOISE)} / {count(WORD)} END"
BSD = "SELECT d.doc_id, CASE WHEN len(d.ps) >= 3 THEN count(e.dst)::DOUBLE / (len(d.ps) - 1) END AS v FROM doc d LEFT JOIN edge e USING (doc_id) GROUP BY d.doc_id, d.ps"
WORDS3 = f"""
part AS (SELECT doc_id, n, CASE WHEN j < n // 3 THEN 1 WHEN j < 2 * (n // 3) THEN 2 ELSE 3 END AS s, p, j FROM para WHERE n >= 6),
joined AS (SELECT doc_id, s, list_distinct(regexp_extract_all(lower(string_agg(p, ' ' ORDER BY j)), '{LONG_WORD}')) AS w FROM part GROUP BY doc_id, s),
slope AS (SELECT a.doc_id, len(list_filter(c.w, lambda x: NOT list_contains(a.w, x) AND NOT list_contains(b.w, x)))::DOUBLE / greatest(len(c.w), 1) - CASE WHEN len(a.w) > 0 THEN 1 ELSE 0 END AS v
  FROM joined a JOIN joined b ON a.doc_id = b.doc_id AND b.s = 2 JOIN joined c ON a.doc_id = c.doc_id AND c.s = 3 WHERE a.s = 1)
"""
PAIRED = f"""{FJ}, s AS (SELECT j.*, {density(lx.DENSITY_B)} AS density, domain, reasoning_chars FROM fx_judgment j JOIN fx_trace t USING (doc_id) WHERE judge = 'a'),
pair AS (SELECT k, a.ccr_closure AS a, b.ccr_closure AS b, a.reasoning_topology AS ta, b.reasoning_topology AS tb, a.overthrow_present AS oa, b.overthrow_present AS ob, a.density AS da, b.density AS db
  FROM s a JOIN s b USING (k) WHERE a.dataset = 'deepseek' AND b.dataset = 'glm'), d AS (SELECT k, b - a AS d FROM pair)"""
SCORED = f"{FJ}, s AS (SELECT j.*, {density(lx.DENSITY_B)} AS density, domain, reasoning_chars FROM fx_judgment j JOIN fx_trace t USING (doc_id) WHERE judge = 'a')"
WIDE = f"{FJ}, w AS (SELECT doc_id, dataset, max(ccr_closure) FILTER (WHERE judge = 'a') AS a, max(ccr_closure) FILTER (WHERE judge = 'b') AS b, max(ccr_closure) FILTER (WHERE judge = 'c') AS c FROM fx_judgment GROUP BY doc_id, dataset)"


def ranks(order: str, least: int) -> str:
    return f"""{PAIRED}, r AS (SELECT d, row_number() OVER (ORDER BY {order}) AS r FROM d WHERE d <> 0)
SELECT count(*) AS n_nonzero, CASE WHEN count(*) >= {least} THEN sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE END AS w_plus,
  CASE WHEN count(*) >= {least} THEN sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE END AS w_minus,
  CASE WHEN count(*) >= {least} THEN round((least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) - count(*) * (count(*) + 1) / 4.0)
    / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) END AS z FROM r"""


AVERAGE = f"""{PAIRED}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0),
x AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS m, sum(t * t - 1)::DOUBLE AS tie FROM r)
SELECT n::BIGINT AS n_nonzero, p AS w_plus, m AS w_minus, round((least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM x"""


def corr(x: str, y: str, least: int = 4) -> str:
    return f"CASE WHEN count({x}) FILTER (WHERE {y} IS NOT NULL) >= {least} AND var_pop({x}) FILTER (WHERE {y} IS NOT NULL) > 0 AND var_pop({y}) FILTER (WHERE {x} IS NOT NULL) > 0 THEN covar_pop({x}, {y}) / (sqrt(var_pop({x}) FILTER (WHERE {y} IS NOT NULL)) * sqrt(var_pop({y}) FILTER (WHERE {x} IS NOT NULL))) END"


def kappa(a: str, b: str, least: int = 1) -> str:
    """Through the matrix of levels."""
    w = f"sum(({a} - {b}) * ({a} - {b}))"
    rows = [f"count(*) FILTER (WHERE {a} = {i})" for i in range(5)]
    cols = [f"count(*) FILTER (WHERE {b} = {i})" for i in range(5)]
    expected = " + ".join(f"{(i - j) ** 2}.0 * {rows[i]} * {cols[j]}" for i in range(5) for j in range(5) if i != j)
    return f"CASE WHEN count(*) >= {least} AND ({expected}) > 0 THEN 1 - {w}::DOUBLE / (({expected}) / count(*)) END"


def mutual(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    n = f"(count(*) FILTER (WHERE {both}))"
    terms = []
    for i in (0, 1):
        for j in (0, 1):
            joint, a, b = (f"(count(*) FILTER (WHERE {both} AND {c}))" for c in (f"{x} = {i} AND {y} = {j}", f"{x} = {i}", f"{y} = {j}"))
            terms.append(f"CASE WHEN {joint} > 0 THEN {joint}::DOUBLE / {n} * log2({joint}::DOUBLE * {n} / ({a}::DOUBLE * {b})) ELSE 0 END")
    return f"CASE WHEN {n} >= 8 THEN {' + '.join(terms)} END"


MANIFEST = """
keyed AS (SELECT doc_id, dataset, uid, domain, trim(regexp_replace(lower(problem), '\\s+', ' ', 'g')) AS norm FROM fx_trace),
hashed AS (SELECT *, sha1(norm) AS h FROM keyed WHERE norm <> ''),
build AS (SELECT h, arg_max(uid, doc_id) AS ds_id, arg_max(domain, doc_id) AS domain FROM hashed WHERE dataset = 'deepseek' GROUP BY h),
manifest AS (SELECT p.h AS ds_hash, b.ds_id, p.uid AS glm_id, b.domain, p.doc_id AS pos FROM hashed p JOIN build b USING (h) WHERE p.dataset = 'glm')
"""
FILES = """
item AS (SELECT dataset || '_' || ((row_number() OVER w - 1) // 5) AS file, (row_number() OVER w - 1) // 5 AS batch_id, (row_number() OVER w - 1) % 5 AS pos, uid, doc_id, dataset
  FROM fx_trace WINDOW w AS (PARTITION BY dataset ORDER BY doc_id)),
score AS (SELECT file, CASE WHEN batch_id % 3 = 0 THEN pos - 1 ELSE pos END AS pos, i.uid, ccr_closure FROM item i JOIN fx_judgment j USING (doc_id) WHERE judge = 'a' AND NOT (batch_id % 3 = 0 AND pos = 0))
"""
SIMPLE = f"""
vals AS (SELECT d.doc_id, coalesce(a.v, 0) AS pdd, b.v AS ear, {OED} AS oed, t.density AS rt_topology_density, {CE} AS ce, {NRR} AS nrr, e.v AS bsd
  FROM doc d LEFT JOIN ({PDD}) a USING (doc_id) LEFT JOIN ({EAR}) b USING (doc_id) LEFT JOIN ({TOPO}) t USING (doc_id) LEFT JOIN ({BSD}) e USING (doc_id)),
met AS (SELECT * FROM vals JOIN (SELECT doc_id, dataset, ccr_closure FROM fx_judgment WHERE judge = 'a') j USING (doc_id))
"""
FMJ = f"{FJ}, {MARKS}, {EDGES}, {SIMPLE}"
NAMES = ("pdd", "ear", "oed", "rt_topology_density", "ce", "nrr", "bsd")
PROMPT = "length(problem[1:2000]) + CASE WHEN length(reasoning) <= 2400 THEN length(reasoning) ELSE 2400 + length('\n\n[... ' || (length(reasoning) - 2400) || ' chars elided ...]\n\n') + {note} END + length(output[1:2000]) + {fixed}"
PROMPT = PROMPT.format(
    note=len("\n[NOTE: only the head and the tail of the reasoning are shown; judge what is visible with lower confidence.]"),
    fixed=len("PROBLEM:\n\n\nREASONING (to be scored):\n\n\nFINAL ANSWER (context only):\n\n\nReturn the JSON object now."),
)


def pct(c: str) -> str:
    return f"round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6)"


ORACLE = {
    "rt_density_by_dataset": f"{FM} SELECT dataset, count(*) AS n, round(avg(density), 6) AS rt_density {BY_DOC.format(TOPO)} GROUP BY dataset",
    "rt_topology": f"{FM} SELECT d.doc_id, round(density, 6) AS density, round(ratio, 6) AS branch_merge_ratio, coalesce(depth, 0.0)::DOUBLE AS back_ref_depth {BY_DOC.format(TOPO)}",
    "pdd": f"{FM} SELECT d.doc_id, round(coalesce(v, 0.0), 6)::DOUBLE AS pdd {BY_DOC.format(PDD)}",
    "ear": f"{FM} SELECT d.doc_id, round(v, 6) AS ear {BY_DOC.format(EAR)}",
    "oed": f"{FX} SELECT doc_id, round({OED}, 6) AS oed FROM fx_trace",
    "ce": f"{FX} SELECT doc_id, round({CE}, 6) AS ce FROM fx_trace",
    "nrr": f"{FX} SELECT doc_id, round({NRR}, 6) AS nrr FROM fx_trace",
    "inertia_slope": f"{FM}, {WORDS3} SELECT d.doc_id, round(v, 6) AS inertia_slope FROM doc d LEFT JOIN slope USING (doc_id)",
    "ci_index": f"{FM}, {WORDS3}, e AS ({EAR}) SELECT d.doc_id, round(e.v / ({OED} + 0.01) * s.v, 6) AS ci FROM doc d LEFT JOIN slope s USING (doc_id) LEFT JOIN e USING (doc_id)",
    "bsd": f"{FM}, {EDGES} SELECT doc_id, round(v, 6) AS bsd FROM ({BSD}) x",
    "dep_edges": f"{FM}, {EDGES} SELECT doc_id, src::INT AS src, dst::INT AS dst, count(*) AS n FROM edge GROUP BY doc_id, src, dst",
    "action_hist": f"{FM} SELECT dataset, action, count(*) AS n FROM mark JOIN fx_trace USING (doc_id) GROUP BY ALL",
    "rae": f"""{FM}, run AS (SELECT doc_id, j, action, lag(action) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM mark WHERE n >= 5),
step AS (SELECT doc_id, before AS a, action AS b FROM run WHERE before IS NOT NULL AND before <> action),
cnt AS (SELECT doc_id, a, b, count(*)::DOUBLE AS c FROM step GROUP BY ALL),
tot AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r FROM cnt),
x AS (SELECT doc_id, any_value(n) AS n, -sum(c / n * log2(c / n)) AS e, sum(c) FILTER (WHERE r <= 3) / any_value(n) AS top FROM tot GROUP BY doc_id HAVING any_value(n) >= 3)
SELECT d.doc_id, round(e, 6) AS entropy, round(1 - e / log2(least(n, 36)), 6) AS routinization, round(top, 6) AS dominant_ratio FROM doc d LEFT JOIN x USING (doc_id)""",
    "fsd": f"""{FM}, l AS (SELECT doc_id, n, format, lag(format) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM mark),
x AS (SELECT doc_id, count(*) FILTER (WHERE before <> format)::DOUBLE / (any_value(n) - 1) AS v FROM l WHERE n >= 3 GROUP BY doc_id)
SELECT d.doc_id, round(v, 6) AS fsd FROM doc d LEFT JOIN x USING (doc_id)""",
    "ccs_exact": f"""{FM}, t AS (SELECT doc_id, j, n, critique, list_distinct(regexp_extract_all(lower(p), '{WORD}')) AS w FROM mark WHERE n >= 4),
pairwise AS (SELECT a.doc_id, a.j, b.j AS k, len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(list_concat(a.w, b.w))), 1) AS s
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.j <> b.j WHERE a.critique AND a.j > 0 AND len(a.w) > 0),
near AS (SELECT doc_id, avg(s) AS near FROM pairwise WHERE k BETWEEN j - 5 AND j - 1 GROUP BY doc_id),
far AS (SELECT doc_id, avg(s) AS far FROM (SELECT doc_id, j, avg(s) AS s FROM pairwise GROUP BY doc_id, j) y GROUP BY doc_id)
SELECT d.doc_id, round(near / greatest(far, 0.001), 6) AS ccs_exact FROM doc d LEFT JOIN near USING (doc_id) LEFT JOIN far USING (doc_id)""",
    "gini": f"""{FM}, v AS (SELECT doc_id, n, length(p)::DOUBLE AS v, row_number() OVER (PARTITION BY doc_id ORDER BY length(p)) AS i FROM para),
x AS (SELECT doc_id, CASE WHEN any_value(n) >= 2 THEN 2 * sum(i * v) / (any_value(n) * sum(v)) - (any_value(n) + 1.0) / any_value(n) END AS g FROM v GROUP BY doc_id)
SELECT d.doc_id, round(g, 6) AS gini FROM doc d LEFT JOIN x USING (doc_id)""",
    "paragraph_stats": f"{FM} SELECT doc_id, len(ps)::INT AS n_paras, length(array_to_string(ps, ''))::INT AS n_chars, {count(WORD)}::BIGINT AS n_words, {count(lx.CHUNK)}::BIGINT AS n_chunks FROM doc",
    "split_think": f"""{FX} SELECT doc_id, CASE WHEN {hit(lx.THINK, "output")} THEN {strip(f"regexp_extract(output, {q(lx.THINK)}, 1)")} ELSE '' END AS reasoning,
{strip(f"CASE WHEN {hit(lx.THINK, 'output')} THEN regexp_extract(output, {q(lx.THINK)}, 2) ELSE output END")} AS answer FROM fx_trace""",
    "split_generated": f"""{FX} SELECT doc_id, length({strip("replace(split_part(output, '</think>', 1), '<think>', '')")})::INT AS reasoning_chars,
CASE WHEN contains(output, '</think>') THEN {strip("string_split(output, '</think>')[-1]")} ELSE '' END AS answer, contains(output, '</think>') AS closed FROM fx_trace""",
    "problem_norm_hash": f"{FX}, {MANIFEST} SELECT doc_id, norm, sha1(norm) AS hash FROM keyed",
    "problem_norm_unicode": f"{FX}, {MANIFEST} SELECT doc_id, norm, sha1(norm) AS hash FROM keyed",
    "derived_uid": f"{FX} SELECT doc_id, substr(sha1(problem), 1, 16) AS derived FROM fx_trace",
    "truncate_head_tail": f"""{FX}, c AS (SELECT doc_id, CASE WHEN length(reasoning) <= 9000 THEN reasoning ELSE reasoning[1:4500] || chr(10) || chr(10) || '[... ' || (length(reasoning) - 9000) || ' chars elided ...]' || chr(10) || chr(10) || right(reasoning, 4500) END AS t FROM fx_trace)
SELECT doc_id, length(t)::INT AS n_chars, sha1(t) AS sha1 FROM c""",
    "judge_prompt_chars": f"{FX} SELECT doc_id, ({PROMPT})::INT AS n_chars FROM fx_trace",
    "critique_density_a": f"{FX} SELECT doc_id, round({density(lx.DENSITY_A)}, 6) AS density FROM fx_trace",
    "critique_density_b": f"{FX} SELECT doc_id, round({density(lx.DENSITY_B)}, 6) AS density FROM fx_trace",
    "token_jaccard": f"""{FX}, t AS (SELECT doc_id, reasoning_chars, list_distinct(regexp_extract_all(lower(problem), '{WORD}')) AS a, list_distinct(regexp_extract_all(lower(output), '{WORD}')) AS b FROM fx_trace)
SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard, round(log10(greatest(reasoning_chars, 1)), 6) AS log_chars FROM t""",
    "traces_from_conversations": f"""WITH {ctes("fx_conv")} SELECT conv_id, substr(sha1(coalesce(problem, '')), 1, 16) AS uid, coalesce(problem, '') AS problem, length(coalesce(assistant, ''))::INT AS reasoning_chars, sha1(coalesce(assistant, '')) AS answer_sha1 FROM fx_conv""",
    "layout_output_thinking": f"""{FX} SELECT doc_id, uid, '?' AS teacher, domain, length(CASE WHEN {hit(lx.THINK, "output")} THEN {strip(f"regexp_extract(output, {q(lx.THINK)}, 1)")} ELSE '' END)::INT AS reasoning_chars,
length({strip(f"CASE WHEN {hit(lx.THINK, 'output')} THEN regexp_extract(output, {q(lx.THINK)}, 2) ELSE output END")})::INT AS answer_chars FROM fx_trace""",
    "judge_json_parse_qc": f"""WITH {ctes("fx_judge_raw")}, j AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(content, '(?s)\\{{.*\\}}', 0), '') AS JSON) AS j FROM fx_judge_raw),
x AS (SELECT doc_id, j, TRY_CAST(j ->> 'ccr_closure' AS INT) AS ccr, j ->> 'reasoning_topology' AS topo FROM j)
SELECT doc_id, ccr, CASE WHEN j IS NULL THEN 'error' ELSE 'judged' END AS status, CASE WHEN j IS NULL THEN 'no object' ELSE concat_ws(',', CASE WHEN ccr IS NULL OR ccr NOT BETWEEN 0 AND 4 THEN 'bad:ccr_closure' END,
  CASE WHEN topo NOT IN ('chain', 'tree', 'graph', 'loop', 'drift') THEN 'bad:reasoning_topology' END, CASE WHEN topo IS NULL THEN 'missing:reasoning_topology' END) END AS qc FROM x""",
    "eligible_sample": f"""{FX}, s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS i FROM fx_trace), e AS (SELECT *, row_number() OVER (PARTITION BY dataset, uid ORDER BY doc_id) AS u FROM s WHERE i <= 60 AND reasoning_chars >= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(uid || '|42'), uid) AS r FROM e WHERE u = 1) SELECT dataset, uid, doc_id FROM r WHERE r <= 10""",
    "stratified_quota": f"""{FX}, c AS (SELECT *, count(*) OVER (PARTITION BY domain) AS c, count(*) OVER () AS t, row_number() OVER (PARTITION BY domain ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM fx_trace)
SELECT doc_id, domain FROM c ORDER BY r > least(c, greatest(1, round(50.0 * c / t))), md5(doc_id || '|42'), doc_id LIMIT 50""",
    "length_window_head": f"{FX} SELECT doc_id, reasoning_chars FROM fx_trace WHERE reasoning_chars BETWEEN 1500 AND 8000 ORDER BY doc_id LIMIT 3",
    "batches_of_five": f"""{FJ}, {FILES} SELECT dataset, batch_id::INT AS batch_id, count(*) AS n, string_agg(uid, ',' ORDER BY pos) AS uids FROM item GROUP BY dataset, batch_id""",
    "pair_manifest": f"{FX}, {MANIFEST} SELECT ds_hash, ds_id, glm_id, domain FROM manifest",
    "pair_dedup": f"{FX}, {MANIFEST} SELECT ds_id, glm_id FROM (SELECT *, row_number() OVER (PARTITION BY ds_id ORDER BY pos) AS r FROM manifest) x WHERE r = 1 ORDER BY pos LIMIT 20",
    "pair_yield": f"{FX}, {MANIFEST} SELECT domain, count(*) AS matches, count(DISTINCT ds_hash) AS keys, round(count(*)::DOUBLE / (SELECT count(*) FROM fx_trace WHERE dataset = 'glm'), 6) AS share_of_probes FROM manifest GROUP BY domain ORDER BY matches DESC, domain LIMIT 20",
    "pair_match_rate": f"{FX}, {MANIFEST} SELECT (SELECT count(*) FROM fx_trace WHERE dataset = 'glm') AS probes, count(*) AS matched, count(DISTINCT ds_id) AS keys FROM manifest",
    "positional_join": f"""{FJ}, {FILES}, al AS (SELECT file, bool_and(coalesce(i.uid = s.uid, false)) AS aligned FROM item i FULL JOIN score s USING (file, pos) GROUP BY file),
last AS (SELECT file, uid, max(pos) AS p FROM item GROUP BY file, uid)
SELECT s.file, s.pos::INT AS pos, s.uid, i.doc_id, s.ccr_closure, true AS aligned FROM score s JOIN al USING (file) JOIN item i ON i.file = s.file AND i.pos = s.pos WHERE aligned
UNION ALL SELECT s.file, s.pos::INT, s.uid, i.doc_id, s.ccr_closure, false FROM score s JOIN al USING (file) JOIN last l ON l.file = s.file AND l.uid = s.uid JOIN item i ON i.file = l.file AND i.pos = l.p WHERE NOT aligned""",
    "batch_complete": f"{FJ}, {FILES} SELECT file, n FROM (SELECT file, count(*) AS n FROM item GROUP BY file) a JOIN (SELECT file, count(*) AS n FROM score GROUP BY file) b USING (file, n)",
    "resume_todo": f"{FJ} SELECT doc_id, dataset, uid FROM fx_trace t WHERE NOT EXISTS (SELECT 1 FROM fx_judgment j WHERE judge = 'b' AND (doc_id % 3 = 0 OR doc_id % 50 = 49) AND status <> 'error' AND j.dataset = t.dataset AND j.uid = t.uid)",
    "summary_by_dataset": f"""{SCORED}, m AS (SELECT dataset, list_sort(list(ccr_closure)) AS l FROM s WHERE ccr_closure IS NOT NULL GROUP BY dataset)
SELECT dataset, count(*) AS n, round(avg(ccr_closure), 6) AS ccr_mean, any_value(l[len(l) // 2 + 1]) AS ccr_median, round(avg(monitoring_control_coupling), 6) AS coupling_mean, round(avg(causal_depth_of_critique), 6) AS depth_mean,
  round(avg(density), 6) AS density_mean, {pct("reasoning_topology = 'loop'")} AS loop_pct, {pct("overthrow_present = 1")} AS overthrow_pct, {pct("early_assertion = 1")} AS early_pct,
  {pct("answer_change = 'final'")} AS final_pct, {pct("templated_divergence = 1")} AS templated_pct FROM s JOIN m USING (dataset) WHERE ccr_closure IS NOT NULL GROUP BY dataset""",
    "summary_legacy": f"""{FJ} SELECT dataset, count(*) AS n, round(avg(ccr_closure), 6) AS ccr_mean, median(ccr_closure) AS ccr_median, round(avg(monitoring_control_coupling), 6) AS coupling_mean,
  count(*) FILTER (WHERE templated_divergence = 1) AS templated_n, count(*) FILTER (WHERE answer_change = 'none') AS change_none, count(*) FILTER (WHERE answer_change = 'intermediate') AS change_intermediate,
  count(*) FILTER (WHERE answer_change = 'final') AS change_final FROM fx_judgment WHERE judge = 'b' AND ccr_closure IS NOT NULL GROUP BY dataset""",
    "run_summary": FJ
    + " SELECT judge, "
    + ", ".join(f"round(avg({f}), 6) AS {f}_mean, median({f}) AS {f}_median, round(stddev_samp({f}), 6) AS {f}_std, count({f}) AS {f}_n" for f in ("ccr_closure", "monitoring_control_coupling"))
    + ", count(*) FILTER (WHERE status = 'judged') AS judged_n, count(*) FILTER (WHERE status = 'error') AS error_n FROM fx_judgment GROUP BY judge",
    "topology_hist": f"{FJ} SELECT dataset, reasoning_topology, count(*) AS n FROM fx_judgment WHERE judge = 'a' AND reasoning_topology IS NOT NULL GROUP BY ALL",
    "length_report": f"""{SCORED}, l AS (SELECT *, log10(greatest(reasoning_chars, 1)) AS l, dataset IN {lx.NATIVE_SETS} AS nat, dataset IN {lx.RECONSTRUCTED_SETS} AS rec, reasoning_chars BETWEEN 1000 AND 8000 AS band FROM s WHERE ccr_closure IS NOT NULL AND reasoning_chars > 0)
SELECT round({corr("l", "ccr_closure", 1)}, 6) AS pearson_log_len, round(coalesce(avg(reasoning_chars) FILTER (WHERE nat), 0), 6) AS chars_native, round(coalesce(avg(reasoning_chars) FILTER (WHERE rec), 0), 6) AS chars_rebuilt,
  count(*) FILTER (WHERE band AND nat) AS band_native_n, round(coalesce(avg(ccr_closure) FILTER (WHERE band AND nat), 0), 6) AS band_native_ccr, count(*) FILTER (WHERE band AND rec) AS band_rebuilt_n, round(coalesce(avg(ccr_closure) FILTER (WHERE band AND rec), 0), 6) AS band_rebuilt_ccr FROM l""",
    "judge_means": f"{WIDE} SELECT dataset, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(c), 6) AS c FROM w GROUP BY dataset",
    "bias_by_level": f"{WIDE} SELECT a AS level, count(*) AS n, round(avg(b), 6) AS other_mean FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a",
    "self_bias": f"{FJ} SELECT round(avg(ccr_closure) FILTER (WHERE judge = 'b'), 6) AS self_mean, round(avg(ccr_closure) FILTER (WHERE judge <> 'b'), 6) AS others_mean, round(avg(ccr_closure) FILTER (WHERE judge = 'b') - avg(ccr_closure) FILTER (WHERE judge <> 'b'), 6) AS bias FROM fx_judgment WHERE dataset = 'kimi'",
    "agreement": f"{WIDE} SELECT dataset, count(*) AS n, {pct('a = b')} AS exact_pct, {pct('abs(a - b) <= 1')} AS within1_pct, round(avg(abs(a - b)), 6) AS mean_abs_diff FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset",
    "qwk": f"{WIDE} SELECT dataset, round({kappa('a', 'c')}, 6) AS qwk FROM w WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY dataset",
    "calibration": f"""{FJ}, p AS (SELECT a.ccr_closure AS x, b.ccr_closure AS y FROM fx_judgment a JOIN fx_judgment b USING (dataset, uid) WHERE a.judge = 'a' AND b.judge = 'b' AND a.ccr_closure IS NOT NULL AND b.ccr_closure IS NOT NULL)
SELECT count(*) AS n, {pct("x = y")} AS exact_pct, {pct("abs(x - y) <= 1")} AS within1_pct, round(avg(abs(x - y)), 6) AS mean_abs_diff, round({kappa("x", "y")}, 6) AS qwk, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM p""",
    "wilcoxon_average": AVERAGE,
    "wilcoxon_a": ranks("abs(d), sign(d)", 6),
    "wilcoxon_b": ranks("abs(d), k", 5),
    "cliffs_delta": f"""{FJ}, g AS (SELECT judge, dataset, ccr_closure AS v FROM fx_judgment WHERE ccr_closure IS NOT NULL AND dataset IN ('glm', 'deepseek')),
x AS (SELECT judge, avg(sign(a.v - b.v)) AS delta FROM g a JOIN g b USING (judge) WHERE a.dataset = 'glm' AND b.dataset = 'deepseek' GROUP BY judge)
SELECT judge, round(delta, 6) AS delta, CASE WHEN abs(delta) > 0.474 THEN 'large' WHEN abs(delta) > 0.33 THEN 'medium' WHEN abs(delta) > 0.147 THEN 'small' ELSE 'negligible' END AS effect FROM x""",
    "paired_summary": f"""{PAIRED} SELECT count(*) AS n_pairs, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean, median(b - a) AS median_diff, count(*) FILTER (WHERE b > a) AS b_higher, count(*) FILTER (WHERE a > b) AS a_higher,
  count(*) FILTER (WHERE a = b) AS tied, round((count(*) FILTER (WHERE b > a) - count(*) FILTER (WHERE a > b))::DOUBLE / count(*), 6) AS rank_biserial, {pct("ta = 'loop'")} AS a_loop_pct, {pct("tb = 'loop'")} AS b_loop_pct,
  {pct("oa = 1")} AS a_overthrow_pct, {pct("ob = 1")} AS b_overthrow_pct, round(avg(da), 6) AS a_density, round(avg(db), 6) AS b_density FROM pair""",
    "paradox_check": f"{PAIRED} SELECT round(avg(da), 6) AS a_density, round(avg(db), 6) AS b_density, round(avg(a), 6) AS a_score, round(avg(b), 6) AS b_score, count(*) FILTER (WHERE da > db AND a < b) AS pairs_in_paradox, avg(da) > avg(db) AND avg(a) < avg(b) AS holds FROM pair",
    "spearman_ordinal": f"""{WIDE}, r AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY a, doc_id) - row_number() OVER (PARTITION BY dataset ORDER BY b, doc_id) AS d FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT dataset, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(1 - 6 * sum(d * d)::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) END AS rho FROM r GROUP BY dataset""",
    "spearman_avg": f"""{WIDE}, r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY a) + (count(*) OVER (PARTITION BY dataset, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY dataset ORDER BY b) + (count(*) OVER (PARTITION BY dataset, b) - 1) / 2.0::DOUBLE AS y
  FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT dataset, count(*) AS n, round({corr("x", "y", 2)}, 6) AS rho FROM r GROUP BY dataset""",
    "pearson_metric_ccr": FMJ + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) FILTER (WHERE ccr_closure IS NOT NULL) AS n, round({corr(m, 'ccr_closure')}, 6) AS r FROM met" for m in NAMES),
    "metric_dataset_rank": FMJ
    + ", means AS (SELECT dataset, avg(ccr_closure) AS c, "
    + ", ".join(f"avg({m}) AS {m}" for m in NAMES)
    + " FROM met GROUP BY dataset), long AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, dataset, {m} AS v, c FROM means" for m in NAMES)
    + """), r AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY metric ORDER BY c) + (count(*) OVER (PARTITION BY metric, c) - 1) / 2.0::DOUBLE AS y
  FROM long WHERE v IS NOT NULL AND c IS NOT NULL) """
    + f"SELECT metric, count(*) AS n, round({corr('x', 'y', 2)}, 6) AS rho FROM r GROUP BY metric",
    "mutual_info": f"""{FJ}, j AS (SELECT dataset, critique_present AS x, CASE WHEN answer_change IS NULL THEN NULL WHEN answer_change <> 'none' THEN 1 ELSE 0 END AS y FROM fx_judgment WHERE judge = 'a')
SELECT dataset, round({mutual("x", "y")}, 6) AS mi FROM j GROUP BY dataset UNION ALL SELECT '(pooled)', round({mutual("x", "y")}, 6) FROM j""",
    "label_mutual_info": f"SELECT round({mutual('quality', 'toxic')}, 6) AS mi FROM labels",
    "panel_matrix": f"""{FJ}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.ccr_closure AS x, b.ccr_closure AS y FROM fx_judgment a JOIN fx_judgment b USING (doc_id) WHERE a.judge < b.judge AND a.ccr_closure IS NOT NULL AND b.ccr_closure IS NOT NULL)
SELECT judge_a, judge_b, count(*) AS n, {pct("x = y")} AS exact_pct, {pct("abs(x - y) <= 1")} AS within1_pct, round(avg(abs(x - y)), 6) AS mean_abs_diff, round({kappa("x", "y", 3)}, 6) AS qwk FROM p GROUP BY judge_a, judge_b""",
    "panel_ranking": f"""{FJ}, m AS (SELECT dataset, judge, avg(ccr_closure) AS m FROM fx_judgment WHERE ccr_closure IS NOT NULL GROUP BY ALL), p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.m AS x, b.m AS y FROM m a JOIN m b USING (dataset) WHERE a.judge < b.judge),
r AS (SELECT judge_a, judge_b, rank() OVER (PARTITION BY judge_a, judge_b ORDER BY x) + (count(*) OVER (PARTITION BY judge_a, judge_b, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY judge_a, judge_b ORDER BY y) + (count(*) OVER (PARTITION BY judge_a, judge_b, y) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT judge_a, judge_b, count(*) AS n, round({corr("x", "y", 2)}, 6) AS rho FROM r GROUP BY judge_a, judge_b""",
    "panel_headline": f"""{FJ}, d AS (SELECT judge, b.ccr_closure - a.ccr_closure AS d FROM fx_judgment a JOIN fx_judgment b USING (judge, k) WHERE a.dataset = 'deepseek' AND b.dataset = 'glm' AND a.ccr_closure IS NOT NULL AND b.ccr_closure IS NOT NULL)
SELECT judge, count(*) AS n, count(*) FILTER (WHERE d > 0) AS b_higher, count(*) FILTER (WHERE d < 0) AS a_higher, count(*) FILTER (WHERE d = 0) AS tied, round(avg(d), 6) AS mean_diff FROM d GROUP BY judge""",
    "closure_rates": f"""{FJ} SELECT dataset, count(*) AS n, {pct("answer_change <> 'none'")} AS acting_pct, {pct("critique_present = 1 AND answer_change = 'none'")} AS idle_pct, {pct("overthrow_present = 1")} AS overturn_pct, {pct("ccr_closure >= 2")} AS closed_pct
FROM fx_judgment WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY dataset""",
    "method_means": f"""{FJ}, m AS (SELECT dataset, avg(ccr_closure) AS m FROM fx_judgment WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY dataset)
SELECT CASE WHEN dataset IN {lx.NATIVE_SETS} THEN 'native' WHEN dataset IN {lx.RECONSTRUCTED_SETS} THEN 'reconstructed' ELSE 'other' END AS method, count(*) AS datasets, round(avg(m), 6) AS mean_of_means FROM m GROUP BY 1""",
    "training_filter": f"{FJ} SELECT dataset, count(*) AS n FROM fx_judgment WHERE judge = 'a' AND ccr_closure >= 2 GROUP BY dataset",
}
