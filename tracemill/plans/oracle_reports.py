"""DuckDB forms of the queries in catalog_reports, and of those in catalog that need recursion or series."""

from __future__ import annotations

from .. import lexicons as lx
from .catalog_reports import DISPLAY, MORE_FIELDS
from .oracle import BSD, BY_DOC, CE, EAR, EDGES, FILES, FJ, FM, FX, MANIFEST, NRR, OED, PAIRED, PDD, SCORED, TOPO, WIDE, WORD, WORDS3, count, density, kappa, pct, ranks

MORE = ", ".join(f"{e} AS {k}" for k, e in MORE_FIELDS.items())
FULL = f"""{FJ}, s AS (SELECT j.*, {density(lx.DENSITY_B)} AS density, domain AS teacher, reasoning_chars FROM fx_judgment j JOIN fx_trace t USING (doc_id)),
full_ AS (SELECT *, {MORE} FROM s)"""
#: erf by its series of positive terms, and the upper tail of chi-squared by that of the incomplete gamma function.
P_OF_Z = """(CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * CASE WHEN {z} = 0 THEN 0.0 ELSE
  list_sum(list_transform(range(0, 221), lambda n: exp(n * ln(2) + (2 * n + 1) * ln(abs({z}) / sqrt(2)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1))))) END) END)"""
P_OF_CHI2 = """(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {x} > 80 * {k} + 80 THEN 0.0
  ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 881), lambda n: exp(({k} / 2.0 + n) * ln({x} / 2.0) - {x} / 2.0 - lgamma({k} / 2.0 + n + 1))))) END)"""


def commonest(name: str, rows: str, group: str, category: str, top: int | None = None) -> str:
    cut = f"WHERE r <= {top}" if top else ""
    return f"""{name} AS (SELECT {group}, string_agg({category} || ':' || n, ',' ORDER BY n DESC, {category}) AS {category} FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, {category}) AS r FROM (
    SELECT {group}, {category}, count(*) AS n FROM {rows} WHERE {category} IS NOT NULL GROUP BY ALL) x) y {cut} GROUP BY {group})"""


def mean(c: str) -> str:
    return f"round(coalesce(avg({c}), 0), 6)"


RANK = f"""
pr AS (WITH RECURSIVE node AS (SELECT doc_id, n, j FROM mark WHERE n >= 4),
  outs AS (SELECT doc_id, src, count(*) AS d FROM edge GROUP BY ALL),
  step AS (
    SELECT 0 AS i, doc_id, n, map_from_entries(list((j, 1.0::DOUBLE / n))) AS r FROM node GROUP BY doc_id, n
    UNION ALL
    SELECT i + 1, s.doc_id, s.n, map_from_entries(list_transform(range(0, s.n), lambda j: (j, 0.15 / s.n
      + 0.85 / s.n * coalesce(list_sum(list_transform(list_filter(range(0, s.n), lambda k: NOT list_contains(coalesce(l.srcs, []), k)), lambda k: s.r[k])), 0)
      + 0.85 * coalesce(list_sum(list_transform(list_filter(coalesce(l.links, []), lambda e: e.dst = j), lambda e: s.r[e.src] / e.d)), 0))))
    FROM step s LEFT JOIN (SELECT e.doc_id, list({{'src': e.src, 'dst': e.dst, 'd': o.d}}) AS links, list_distinct(list(e.src)) AS srcs FROM edge e JOIN outs o ON e.doc_id = o.doc_id AND e.src = o.src GROUP BY e.doc_id) l ON s.doc_id = l.doc_id
    WHERE i < 40)
  SELECT doc_id, n, list_sort(map_values(r)) AS v FROM step WHERE i = 40),
ici AS (SELECT doc_id, 2 * list_sum(list_transform(v, lambda x, i: i * x)) / (n * list_sum(v)) - (n + 1.0) / n AS ici FROM pr)
"""
CCS = """
tok AS (SELECT doc_id, j, n, critique, list_distinct(regexp_extract_all(lower(p), '{word}')) AS w FROM mark WHERE n >= 4),
pw AS (SELECT a.doc_id, a.j, b.j AS k, len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(list_concat(a.w, b.w))), 1) AS s
  FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.j <> b.j WHERE a.critique AND a.j > 0 AND len(a.w) > 0),
ccs_near AS (SELECT doc_id, avg(s) AS near FROM pw WHERE k BETWEEN j - 5 AND j - 1 GROUP BY doc_id),
""".replace("{word}", WORD)
CCS_ALL = CCS + """
ccs_far AS (SELECT doc_id, avg(s) AS far FROM (SELECT doc_id, j, avg(s) AS s FROM pw GROUP BY doc_id, j) y GROUP BY doc_id),
ccs AS (SELECT doc_id, near / greatest(far, 0.001) AS v FROM ccs_near JOIN ccs_far USING (doc_id))
"""
RAE = """
run AS (SELECT doc_id, j, action, lag(action) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM mark WHERE n >= 5),
bigram AS (SELECT doc_id, before AS a, action AS b FROM run WHERE before IS NOT NULL AND before <> action),
cnt AS (SELECT doc_id, a, b, count(*)::DOUBLE AS c FROM bigram GROUP BY ALL),
tot AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n FROM cnt),
rae AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS entropy, 1 + sum(c / n * log2(c / n)) / log2(least(any_value(n), 36)) AS routine FROM tot GROUP BY doc_id HAVING any_value(n) >= 3)
"""
FSD = """fl AS (SELECT doc_id, n, format, lag(format) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM mark),
fsd AS (SELECT doc_id, count(*) FILTER (WHERE before <> format)::DOUBLE / (any_value(n) - 1) AS v FROM fl WHERE n >= 3 GROUP BY doc_id)"""
GLM_SIDE = "CASE WHEN substr(md5(glm_id), 32, 1) < '6' THEN glm_id || 'x' ELSE glm_id END"


def cut(c: str, budget: int) -> str:
    half = budget // 2
    return f"CASE WHEN length({c}) <= {budget} THEN {c} ELSE {c}[1:{half}] || chr(10) || chr(10) || '[... ' || (length({c}) - {budget}) || ' chars elided ...]' || chr(10) || chr(10) || right({c}, {half}) END"


def prompt(problem: int, reasoning: str, answer: int, label: str, reasoning_label: str) -> str:
    nl = "chr(10)"
    return f"""sha1('PROBLEM:' || {nl} || problem[1:{problem}] || {nl} || {nl} || '{reasoning_label}:' || {nl} || {reasoning} || {nl} || {nl} || '{label}:' || {nl} || output[1:{answer}] || {nl} || {nl} || 'Return the JSON object now.')"""


NOTE = "chr(10) || '[NOTE: only the head and the tail of the reasoning are shown; judge what is visible with lower confidence.]'"
COT = "MODEL CoT (reasoning to be scored)"


def score_of(judge: str, name: str) -> str:
    return f"{name} AS (SELECT file, pos, i.uid, ccr_closure FROM item i JOIN fx_judgment j USING (doc_id) WHERE judge = '{judge}')"


SUMMARY = f"""count(*) AS n, round(avg(ccr_closure), 6) AS ccr_mean, list_sort(list(ccr_closure))[count(*) // 2 + 1] AS ccr_median, round(avg(monitoring_control_coupling), 6) AS coupling_mean, round(avg(causal_depth_of_critique), 6) AS depth_mean,
  round(avg(density), 6) AS density_mean, {pct("reasoning_topology = 'loop'")} AS loop_pct, {pct("overthrow_present = 1")} AS overthrow_pct, {pct("early_assertion = 1")} AS early_pct, {pct("answer_change = 'final'")} AS final_pct, {pct("templated_divergence = 1")} AS templated_pct"""
METRIC_COLUMNS = {
    "ccs": "c.v", "pdd": "coalesce(p.v, 0)", "inertia_slope": "s.v", "ear": "e.v", "oed": OED, "rt_topology_density": "t.density", "rt_branch_merge_ratio": "t.ratio", "rt_back_ref_depth": "coalesce(t.depth, 0.0)",
    "rae_bigram_entropy": "r.entropy", "rae_routinization": "r.routine", "fsd": "f.v", "ce": CE, "nrr": NRR, "bsd": "b.v", "ici": "i.ici", "ci_exact": f"e.v / ({OED} + 0.01) * s.v",
}

ORACLE = {
    "dataset_report": f"""{FULL}, j AS (SELECT * FROM full_ WHERE judge = 'a' AND ccr_closure IS NOT NULL), {commonest("topo", "j", "dataset", "reasoning_topology")}, {commonest("fail", "j", "dataset", "failure_type", 5)}
SELECT dataset, {SUMMARY}, arg_min(teacher, doc_id) AS teacher, coalesce(any_value(topo.reasoning_topology), '') AS reasoning_topology, coalesce(any_value(fail.failure_type), '') AS failure_type
FROM (SELECT j.* FROM j) j LEFT JOIN topo USING (dataset) LEFT JOIN fail USING (dataset) GROUP BY dataset""".replace("reasoning_topology = 'loop'", "j.reasoning_topology = 'loop'"),
    "legacy_report": f"""{FULL}, j AS (SELECT * FROM full_ WHERE judge = 'b' AND ccr_closure IS NOT NULL), {commonest("topo", "j", "dataset", "reasoning_topology")}, {commonest("fail", "j", "dataset", "failure_type")}, {commonest("chg", "j", "dataset", "answer_change")},
base AS (SELECT dataset, count(*) AS n, {mean("ccr_closure")} AS ccr_mean, median(ccr_closure) AS ccr_median, {mean("monitoring_control_coupling")} AS coupling_mean, count(*) FILTER (WHERE templated_divergence = 1) AS templated_n,
  {", ".join(f"count(*) FILTER (WHERE answer_change = '{c}') AS change_{c}" for c in ("none", "intermediate", "final"))}, {mean("causal_depth_of_critique")} AS depth_mean, {mean("density")} AS density_mean, {mean("planning_depth")} AS planning_mean,
  {mean("plan_execution_consistency")} AS plan_exec_mean, {mean("divergent_score")} AS divergent_mean, count(*) FILTER (WHERE creative_destruction = 1) AS creative_n, {pct("reasoning_topology = 'loop'")} AS loop_pct FROM j GROUP BY dataset)
SELECT base.*, coalesce(reasoning_topology, '') AS reasoning_topology, coalesce(failure_type, '') AS failure_type, coalesce(answer_change, '') AS answer_change FROM base LEFT JOIN topo USING (dataset) LEFT JOIN fail USING (dataset) LEFT JOIN chg USING (dataset)""",
    "run_report": f"""{FULL}, j AS (SELECT * FROM full_ WHERE status = 'judged'), {commonest("topo", "j", "judge", "reasoning_topology")}, {commonest("fail", "j", "judge", "failure_type")},
c AS (SELECT judge, {", ".join(f"count(*) FILTER (WHERE status = '{k}') AS n_{k}" for k in ("judged", "skipped", "error"))} FROM full_ GROUP BY judge),
m AS (SELECT judge, {", ".join(f"round(avg({f}), 6) AS {f}_mean, median({f}) AS {f}_median, round(stddev_samp({f}), 6) AS {f}_std, count({f}) AS {f}_n" for f in ("ccr_closure", "causal_depth_of_critique"))}, round(avg(density), 6) AS density_mean FROM j GROUP BY judge)
SELECT c.*, m.* EXCLUDE (judge), coalesce(reasoning_topology, '') AS reasoning_topology, coalesce(failure_type, '') AS failure_type FROM c LEFT JOIN m USING (judge) LEFT JOIN topo USING (judge) LEFT JOIN fail USING (judge)""",
    "teacher_means": f"{FULL} SELECT teacher, count(*) AS n, round(avg(ccr_closure), 2) AS mean_ccr FROM full_ WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY teacher",
    "model_read": f"""{FM}, {RAE} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE contains(output, '</think>')) AS n_closed, round(avg(entropy), 6) AS entropy_mean, round(avg(density), 6) AS edge_density_mean,
  count(*) FILTER (WHERE {count(lx.OVERTHROW)} > 0) AS n_overthrown, {pct(f"{count(lx.OVERTHROW)} > 0")} AS overthrown_pct FROM doc d LEFT JOIN rae USING (doc_id) LEFT JOIN ({TOPO}) x USING (doc_id) GROUP BY dataset""",
    "effect_rates": f"""{FULL} SELECT dataset, round(100.0 * count(*) FILTER (WHERE answer_change = 'final') / nullif(count(*) FILTER (WHERE answer_change <> 'none'), 0), 6) AS answer_impact,
  round(100.0 * count(*) FILTER (WHERE critique_present = 1 AND answer_change = 'none') / nullif(count(*) FILTER (WHERE critique_present = 1), 0), 6) AS idle_critique,
  round(100.0 * count(*) FILTER (WHERE reasoning_chars >= 2000 AND ccr_closure <= 1) / nullif(count(*) FILTER (WHERE reasoning_chars >= 2000), 0), 6) AS over_reasoning,
  round(100.0 * count(*) FILTER (WHERE verification_independence = 2) / nullif(count(*) FILTER (WHERE verification_independence >= 1), 0), 6) AS independent_check FROM full_ WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY dataset""",
    "three_way_positional": f"""{FJ}, {FILES}, {score_of("b", "sb")}, ok AS (SELECT file FROM (SELECT file, count(*) AS n FROM item GROUP BY file) JOIN (SELECT file, count(*) AS n FROM score GROUP BY file) USING (file, n) JOIN (SELECT file, count(*) AS n FROM sb GROUP BY file) USING (file, n))
SELECT i.file, i.pos, i.doc_id, s.ccr_closure AS a, b.ccr_closure AS b FROM item i JOIN score s ON i.file = s.file AND i.pos = s.pos JOIN sb b ON i.file = b.file AND i.pos = b.pos WHERE i.file IN (SELECT file FROM ok) AND s.ccr_closure IS NOT NULL AND b.ccr_closure IS NOT NULL""",
    "panel_left_join": f"""{FJ}, {FILES}, {score_of("b", "sb")}, {score_of("c", "sc")} SELECT i.file, i.pos, i.doc_id, i.dataset, s.ccr_closure AS a, b.ccr_closure AS b, c.ccr_closure AS c
FROM item i LEFT JOIN score s ON i.file = s.file AND i.pos = s.pos LEFT JOIN sb b ON i.file = b.file AND i.pos = b.pos LEFT JOIN sc c ON i.file = c.file AND i.pos = c.pos""",
    "metric_left_join": f"{FJ} SELECT doc_id, dataset, uid, reasoning_chars, ccr_closure FROM fx_trace LEFT JOIN (SELECT dataset, uid, arg_max(ccr_closure, judge) AS ccr_closure FROM fx_judgment WHERE ccr_closure IS NOT NULL GROUP BY ALL) j USING (dataset, uid)",
    "calibration_by_uid": f"""{FJ}, o AS (SELECT uid, arg_max(ccr_closure, doc_id) AS y FROM fx_judgment WHERE judge = 'b' AND ccr_closure IS NOT NULL GROUP BY uid), p AS (SELECT ccr_closure AS x, y FROM fx_judgment JOIN o USING (uid) WHERE judge = 'a' AND ccr_closure IS NOT NULL)
SELECT count(*) AS n, {pct("x = y")} AS exact_pct, {pct("abs(x - y) <= 1")} AS within1_pct, round(avg(abs(x - y)), 6) AS mean_abs_diff, round({kappa("x", "y")}, 6) AS qwk, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM p""",
    "verify_consistency": f"""{FJ}, {FILES}, {score_of("c", "second")}, first AS (SELECT file, uid, arg_max(ccr_closure, pos) AS y FROM score WHERE ccr_closure IS NOT NULL GROUP BY ALL), p AS (SELECT ccr_closure AS x, y FROM second JOIN first USING (file, uid) WHERE ccr_closure IS NOT NULL)
SELECT count(*) AS n, {pct("x = y")} AS exact_pct, {pct("abs(x - y) <= 1")} AS within1_pct, round(avg(abs(x - y)), 6) AS mean_abs_diff FROM p""",
    "batch_all_judged": f"""{FJ}, {FILES}, {score_of("b", "sb")} SELECT file, i.n AS n_items, coalesce(s.n, 0) AS n_scores, coalesce(s.n = i.n AND s.k = i.n, false) AS complete
FROM (SELECT file, count(*) AS n FROM item GROUP BY file) i LEFT JOIN (SELECT file, count(*) AS n, count(ccr_closure) AS k FROM sb GROUP BY file) s USING (file)""",
    "paired_report": f"""{FULL}, pair AS (SELECT a.ccr_closure AS a, b.ccr_closure AS b, a.density AS da, b.density AS db, a.monitoring_control_coupling AS ca, b.monitoring_control_coupling AS cb, coalesce(a.reasoning_topology, '?') AS a_topology, coalesce(b.reasoning_topology, '?') AS b_topology, 1 AS g
  FROM full_ a JOIN full_ b USING (k, judge) WHERE judge = 'a' AND a.dataset = 'deepseek' AND b.dataset = 'glm'), {commonest("ta", "pair", "g", "a_topology")}, {commonest("tb", "pair", "g", "b_topology")}
SELECT count(*) AS n_pairs, list_sort(list(a))[count(a) // 2 + 1] AS a_median, list_sort(list(b))[count(b) // 2 + 1] AS b_median, list_sort(list(b - a))[count(b - a) // 2 + 1] AS upper_median_diff, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean,
  round(avg(da), 6) AS a_density, round(avg(db), 6) AS b_density, round(avg(ca), 6) AS a_coupling, round(avg(cb), 6) AS b_coupling, any_value(ta.a_topology) AS a_topology, any_value(tb.b_topology) AS b_topology FROM pair JOIN ta USING (g) JOIN tb USING (g)""",
    "display_order": f"{FJ} SELECT dataset, round(avg(ccr_closure), 6) AS ccr_mean, coalesce(nullif(list_position({list(DISPLAY)}, dataset), 0), {len(DISPLAY) + 1})::INT AS place FROM fx_judgment WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY dataset",
    "judge_items": f"""{FX}, {MANIFEST}, pr AS (SELECT ds_id, arg_min(glm_id, pos) AS glm_id FROM manifest GROUP BY ds_id),
side AS (SELECT dataset, uid, max(doc_id) AS doc_id FROM fx_trace WHERE dataset IN ('deepseek', 'glm') GROUP BY ALL),
pick AS (SELECT 'paired' AS job, s.doc_id, ds_id AS pair_ds, glm_id AS pair_glm FROM pr JOIN side s ON s.uid = ds_id AND s.dataset = 'deepseek'
  UNION ALL SELECT 'paired', coalesce(g.doc_id, d.doc_id), ds_id, glm_id FROM pr LEFT JOIN side g ON g.uid = glm_id AND g.dataset = 'glm' LEFT JOIN side d ON d.uid = ds_id AND d.dataset = 'glm' WHERE coalesce(g.doc_id, d.doc_id) IS NOT NULL
  UNION ALL SELECT dataset, doc_id, NULL, NULL FROM fx_trace WHERE dataset NOT IN ('deepseek', 'glm'))
SELECT job, dataset, uid, pair_ds, pair_glm, reasoning_chars, sha1(problem[1:1500]) AS problem, sha1({cut("reasoning", 2400)}) AS reasoning, sha1(output[1:1200]) AS answer FROM pick JOIN fx_trace USING (doc_id)""",
    "judge_prompts": f"""{FX} SELECT doc_id, {prompt(2000, f"({cut('reasoning', 2400)}) || CASE WHEN length(reasoning) > 2400 THEN {NOTE} ELSE '' END", 2000, "FINAL ANSWER (context only)", "REASONING (to be scored)")} AS single,
  {prompt(2000, "reasoning", 2000, "FINAL ANSWER (context only — do NOT score its correctness)", COT)} AS batch, {prompt(1500, "reasoning", 1200, "FINAL ANSWER (context only — do NOT score correctness)", COT)} AS panel FROM fx_trace""",
    "last_trace_of_uid": f"{FX}, {MANIFEST} SELECT uid, max(doc_id) AS doc_id, arg_max(dataset, doc_id) AS dataset FROM fx_trace WHERE uid IN (SELECT ds_id FROM manifest UNION ALL SELECT glm_id FROM manifest) GROUP BY uid",
    "mann_whitney": f"""{FJ}, g AS (SELECT judge, dataset, ccr_closure AS v FROM fx_judgment WHERE ccr_closure IS NOT NULL AND dataset IN ('glm', 'deepseek')),
r AS (SELECT *, rank() OVER (PARTITION BY judge ORDER BY v) + (count(*) OVER (PARTITION BY judge, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY judge, v) AS t FROM g),
x AS (SELECT judge, count(*) FILTER (WHERE dataset = 'glm') AS n_a, count(*) FILTER (WHERE dataset <> 'glm') AS n_b, (sum(r) FILTER (WHERE dataset = 'glm'))::DOUBLE AS s, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY judge),
u AS (SELECT judge, n_a, n_b, s - n_a * (n_a + 1) / 2.0::DOUBLE AS u, (s - n_a * (n_a + 1) / 2.0::DOUBLE - n_a * n_b / 2.0::DOUBLE) / sqrt(n_a * n_b / 12.0::DOUBLE * (n_a + n_b + 1 - tie / ((n_a + n_b) * (n_a + n_b - 1.0::DOUBLE)))) AS z FROM x)
SELECT judge, n_a, n_b, round(u, 6) AS u, round(z, 6) AS z, round({P_OF_Z.format(z="z")}, 6) AS p FROM u""",
    "chi_squared": f"""{FJ}, k AS (SELECT dataset AS r, reasoning_topology AS c, count(*)::DOUBLE AS k FROM fx_judgment WHERE judge = 'a' AND reasoning_topology IS NOT NULL GROUP BY ALL),
rr AS (SELECT r, sum(k) AS nr FROM k GROUP BY r), cc AS (SELECT c, sum(k) AS nc FROM k GROUP BY c), n AS (SELECT sum(k) AS n FROM k),
x AS (SELECT any_value(n) AS n, (count(DISTINCT rr.r) - 1) * (count(DISTINCT cc.c) - 1) AS dof, sum((coalesce(k, 0) - nr * nc / n) ** 2 / (nr * nc / n)) AS chi2 FROM rr CROSS JOIN cc CROSS JOIN n LEFT JOIN k ON k.r = rr.r AND k.c = cc.c)
SELECT n::BIGINT AS n, dof, round(chi2, 6) AS chi2, round({P_OF_CHI2.format(x="chi2", k="dof")}, 6) AS p FROM x""",
    "mcnemar": f"""{WIDE}, m AS (SELECT dataset, count(*) FILTER (WHERE a >= 2 AND b < 2) AS only_a, count(*) FILTER (WHERE a < 2 AND b >= 2) AS only_b FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset),
x AS (SELECT *, CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0)::DOUBLE ** 2 / (only_a + only_b) END AS chi2 FROM m) SELECT dataset, only_a, only_b, round(chi2, 6) AS chi2, round({P_OF_CHI2.format(x="chi2", k="1")}, 6) AS p FROM x""",
    "quartiles": f"""{FULL} SELECT dataset, {", ".join(f"round(quantile_cont({f}, 0.5), 6)::DOUBLE AS {f}_median, round(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 6)::DOUBLE AS {f}_iqr" for f in ("ccr_closure", "density"))} FROM full_ WHERE judge = 'a' GROUP BY dataset""",
    "cohen_kappa": f"""{WIDE}, x AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT dataset, count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM x GROUP BY dataset),
e AS (SELECT dataset, sum(p.n::DOUBLE * q.n) AS e FROM (SELECT dataset, a AS v, count(*) AS n FROM x GROUP BY ALL) p JOIN (SELECT dataset, b AS v, count(*) AS n FROM x GROUP BY ALL) q USING (dataset, v) GROUP BY dataset)
SELECT dataset, n, round((po - coalesce(e, 0) / n / n) / nullif(1 - coalesce(e, 0) / n / n, 0), 6) AS kappa FROM n LEFT JOIN e USING (dataset)""",
    "bootstrap_mean": f"""{FJ}, d AS (SELECT dataset, ccr_closure AS v, r, ('0x' || substr(md5(doc_id || '|' || r), 1, 12))::BIGINT / {16**12}.0::DOUBLE AS u FROM fx_judgment, range(0, 50) t(r) WHERE judge = 'a' AND ccr_closure IS NOT NULL),
k AS (SELECT *, {" + ".join(f"CASE WHEN u >= (exp(-1) * ({' + '.join(f'1 / {f}.0' for f in [1, 1, 2, 6, 24, 120, 720, 5040][: i + 1])})) THEN 1 ELSE 0 END" for i in range(8))} AS k FROM d),
m AS (SELECT dataset, r, sum(v * k)::DOUBLE / nullif(sum(k), 0) AS m FROM k GROUP BY dataset, r), q AS (SELECT dataset, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY dataset)
SELECT dataset, count(*) AS n, round(avg(ccr_closure), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM fx_judgment JOIN q USING (dataset) WHERE judge = 'a' AND ccr_closure IS NOT NULL GROUP BY dataset""",
    "wilcoxon_p_negative_first": f"SELECT n_nonzero, z, round({P_OF_Z.format(z='z0')}, 6) AS p FROM (SELECT *, z AS z0 FROM ({ranks('abs(d), sign(d)', 6)}))",
    "wilcoxon_p": f"""{PAIRED}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0),
x AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS m, sum(t * t - 1)::DOUBLE AS tie FROM r),
y AS (SELECT n, (least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM x) SELECT n::BIGINT AS n_nonzero, round(z, 6) AS z, round({P_OF_Z.format(z="z")}, 6) AS p FROM y""",
    "ranked_places": f"{FX} SELECT doc_id, row_number() OVER (PARTITION BY dataset ORDER BY reasoning_chars, doc_id) - 1 AS place FROM fx_trace",
    "pair_fallback": f"""{FX}, {MANIFEST}, wanted AS (SELECT ds_id, {GLM_SIDE} AS glm_id FROM manifest), one AS (SELECT uid, min(doc_id) AS doc_id, arg_min(dataset, doc_id) AS dataset FROM fx_trace GROUP BY uid)
SELECT ds_id, glm_id, coalesce(g.doc_id, d.doc_id) AS doc_id, coalesce(g.dataset, d.dataset) AS dataset FROM wanted LEFT JOIN one g ON g.uid = glm_id LEFT JOIN one d ON d.uid = ds_id WHERE coalesce(g.doc_id, d.doc_id) IS NOT NULL""",
    "report_as_json": f"""{FJ} SELECT '{{"dataset":"' || dataset || '","n":' || count(*) || ',"most":' || max(ccr_closure) || '}}' AS json FROM fx_judgment WHERE judge = 'a' GROUP BY dataset""",
    "pagerank_ici": f"{FM}, {EDGES}, {RANK} SELECT d.doc_id, round(ici, 6) AS ici FROM doc d LEFT JOIN ici USING (doc_id)",
    "ccs_sampled": f"""{FM}, {CCS} draw AS (SELECT DISTINCT t.doc_id, t.j, k.k, (('0x' || substr(md5(t.doc_id || '|' || t.j || '|' || k.k), 1, 8))::BIGINT % t.n) AS d FROM tok t, range(0, 5) k(k) WHERE t.critique AND t.j > 0 AND len(t.w) > 0),
far AS (SELECT draw.doc_id, avg(s) AS far FROM draw JOIN pw ON pw.doc_id = draw.doc_id AND pw.j = draw.j AND pw.k = draw.d GROUP BY draw.doc_id)
SELECT d.doc_id, round(near / greatest(far, 0.001), 6) AS ccs FROM doc d LEFT JOIN ccs_near USING (doc_id) LEFT JOIN far USING (doc_id)""",
    "all_metrics_by_dataset": f"""{FM}, {EDGES}, {RANK}, {CCS_ALL}, {RAE}, {FSD}, {WORDS3},
val AS (SELECT d.dataset, {", ".join(f"{e} AS {m}" for m, e in METRIC_COLUMNS.items())} FROM doc d LEFT JOIN ccs c USING (doc_id) LEFT JOIN ({PDD}) p USING (doc_id) LEFT JOIN slope s USING (doc_id) LEFT JOIN ({EAR}) e USING (doc_id)
  LEFT JOIN ({TOPO}) t USING (doc_id) LEFT JOIN rae r USING (doc_id) LEFT JOIN fsd f USING (doc_id) LEFT JOIN ({BSD}) b USING (doc_id) LEFT JOIN ici i USING (doc_id))
SELECT dataset, {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRIC_COLUMNS)} FROM val GROUP BY dataset""",
    "failure_top5": f"{FJ}, c AS (SELECT dataset, failure_type, count(*) AS n FROM fx_judgment WHERE judge = 'a' AND failure_type IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, failure_type)::INT AS rank FROM c) x WHERE rank <= 5",
    "uid_lookup": f"{FX}, {MANIFEST} SELECT doc_id, dataset, uid FROM fx_trace WHERE uid IN (SELECT glm_id FROM manifest)",
    "dataset_ladder": f"""{SCORED}, m AS (SELECT dataset, avg(density) AS d, avg(ccr_closure) AS c FROM s GROUP BY dataset) SELECT dataset, round(d, 6) AS density_mean, round(c, 6) AS ccr_mean,
  CASE WHEN d >= 5 THEN 'high' WHEN d >= 2 THEN 'medium' ELSE 'low' END AS level, row_number() OVER (ORDER BY d DESC, dataset)::INT AS place FROM m""",
    "kruskal_wallis": f"""{FJ}, r AS (SELECT dataset, ccr_closure AS v, rank() OVER (ORDER BY ccr_closure) + (count(*) OVER (PARTITION BY ccr_closure) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ccr_closure) AS t, count(*) OVER () AS n FROM fx_judgment WHERE judge = 'a' AND ccr_closure IS NOT NULL),
g AS (SELECT dataset, sum(r)::DOUBLE * sum(r)::DOUBLE / count(*) AS q, any_value(n)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY dataset),
h AS (SELECT any_value(n)::BIGINT AS n, count(*) AS groups, (12 / (any_value(n) * (any_value(n) + 1)) * sum(q) - 3 * (any_value(n) + 1)) / (1 - sum(tie) / (any_value(n) ** 3 - any_value(n))) AS h FROM g)
SELECT n, groups, round(h, 6) AS h, round({P_OF_CHI2.format(x="h", k="(groups - 1)")}, 6) AS p FROM h""",
}
