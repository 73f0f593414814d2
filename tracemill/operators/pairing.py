"""Matching of the same problems across sources, and of scores to items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import head_and_tail, normalize_problem, problem_hash


def one_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pair_manifest(small: DataFrame, large: DataFrame, order: str, unicode: bool = True) -> DataFrame:
    """(ds_hash, ds_id, glm_id, domain): one row for every row of ``large`` whose problem ``small`` has too.

    Of several rows of ``small`` with one problem the last in ``order`` counts. Blank problems match
    nothing. The join is on the hash; Spark picks its kind by the sizes it meets.
    """
    keyed = lambda df: df.withColumn("problem_hash", problem_hash("problem", unicode)).where(normalize_problem("problem", unicode) != "")
    build = one_of(keyed(small), ["problem_hash"], F.desc(order)).select("problem_hash", F.col("uid").alias("ds_id"), F.col("domain").alias("domain"))
    probe = keyed(large).select("problem_hash", F.col("uid").alias("glm_id"), F.col(order).alias("probe_pos"))
    return probe.join(build, "problem_hash").select(F.col("problem_hash").alias("ds_hash"), "ds_id", "glm_id", "domain", "probe_pos")


def pair_dedup(manifest: DataFrame, n: int, order: str) -> DataFrame:
    """The first manifest row of each ds_id, ``n`` in all."""
    return one_of(manifest, ["ds_id"], F.col(order)).orderBy(order).limit(n)


def resolve_pairs(manifest: DataFrame, traces: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Traces of each manifest row by glm_id, or else by ds_id."""
    side = lambda s: traces.select(F.col("uid").alias(f"__key_{s}"), *(F.col(c).alias(f"__{c}_{s}") for c in columns))
    both = manifest.join(side("g"), F.col("glm_id") == F.col("__key_g"), "left").join(side("d"), F.col("ds_id") == F.col("__key_d"), "left")
    found = [F.when(F.col("__key_g").isNotNull(), F.col(f"__{c}_g")).otherwise(F.col(f"__{c}_d")).alias(c) for c in columns]
    return both.where("__key_g is not null or __key_d is not null").select(*manifest.columns, *found)


def pair_yield(manifest: DataFrame, probes: DataFrame) -> DataFrame:
    """(domain, matches, keys) by domain, the match rate over all probe rows beside them; 20 domains."""
    total = probes.count()
    out = manifest.groupBy("domain").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("ds_hash").alias("keys"), (F.count(F.lit(1)) / F.lit(float(max(1, total)))).alias("share_of_probes"))
    return out.orderBy(F.desc("matches"), "domain").limit(20)


def positional_join(items: DataFrame, scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scores matched to the items of their file.

    Both have file, pos and uid. If a file has as many scores as items and all uids agree place by
    place, they match by place; else by uid, where of several items with one uid the last counts.
    """
    s = scores.select("file", "pos", F.col("uid").alias("score_uid"), *columns)
    i = items.select("file", "pos", "uid", *(c for c in items.columns if c not in ("file", "pos", "uid")))
    met = i.select("file", "pos", "uid").join(s.select("file", "pos", "score_uid"), ["file", "pos"], "full")
    aligned = met.groupBy("file").agg(F.bool_and(F.coalesce(F.col("uid") == F.col("score_uid"), F.lit(False))).alias("aligned"))
    s = s.join(aligned, "file")
    by_place = s.where("aligned").join(i, ["file", "pos"])
    last = one_of(i, ["file", "uid"], F.desc("pos")).drop("pos")
    by_uid = s.where("not aligned").join(last, (s.file == last.file) & (F.col("score_uid") == F.col("uid"))).drop(last.file)
    names = ["file", "pos", "uid", *columns, *(c for c in items.columns if c not in ("file", "pos", "uid")), "aligned"]
    return by_place.select(names).union(by_uid.select(names))


def complete_files(*scores: tuple[DataFrame, str]) -> DataFrame:
    """Files for which all tables (name, of the count) have the same number of rows."""
    out = None
    for df, name in scores:
        n = df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, "file")
    names = [name for _, name in scores]
    for name in names[1:]:
        out = out.where(F.col(name) == F.col(names[0]))
    return out.select("file", F.col(names[0]).alias("n"))


def judged_files(items: DataFrame, scores: DataFrame, score: str = "ccr_closure") -> DataFrame:
    """(file, n_items, n_scores, complete): complete if there are as many scores as items and all of them are set."""
    n = scores.groupBy("file").agg(F.count(F.lit(1)).alias("n_scores"), F.count(score).alias("__set"))
    out = items.groupBy("file").agg(F.count(F.lit(1)).alias("n_items")).join(n, "file", "left")
    out = out.withColumns({"n_scores": F.coalesce("n_scores", F.lit(0)), "__set": F.coalesce("__set", F.lit(0))})
    return out.select("file", "n_items", "n_scores", ((F.col("n_scores") == F.col("n_items")) & (F.col("__set") == F.col("n_items"))).alias("complete"))


def panel(items: DataFrame, scores: dict[str, DataFrame], score: str = "ccr_closure", strict: bool = False) -> DataFrame:
    """Items (file, pos, ...) with a column of each judge's score at their place, null where it gave none.

    ``strict``: only files in which every judge has as many rows as there are items, and of those
    only places that all judges scored.
    """
    judges = list(scores)
    long = reduce(DataFrame.union, (df.select("file", "pos", F.lit(j).alias("__judge"), F.col(score).alias("__score")) for j, df in scores.items()))
    by_judge = lambda j: F.col("__judge") == j
    wide = long.groupBy("file", "pos").agg(*(F.max(F.when(by_judge(j), F.col("__score"))).alias(j) for j in judges))
    out = items.join(wide, ["file", "pos"], "left")
    if not strict:
        return out
    sizes = long.groupBy("file").agg(*(F.count_if(by_judge(j)).alias(f"__n_{j}") for j in judges))
    whole = items.groupBy("file").agg(F.count(F.lit(1)).alias("__n")).join(sizes, "file")
    for j in judges:
        whole = whole.where(F.col(f"__n_{j}") == F.col("__n"))
    return out.join(whole.select("file"), "file", "left_semi").dropna(subset=judges)


def resume_todo(items: DataFrame, done: DataFrame, key: Sequence[str] = ("dataset", "uid"), retry_errors: bool = True) -> DataFrame:
    """Items that aren't done yet; errors are tried again."""
    finished = done.where(F.coalesce("status", F.lit("judged")) != "error") if retry_errors else done
    return items.join(finished.select(*key).distinct(), list(key), "left_anti")


def lookup(traces: DataFrame, wanted: DataFrame, key: Sequence[str] = ("uid",), last: str | None = None) -> DataFrame:
    """Traces of the wanted ids; with ``last`` the last one of each id in that order, else all."""
    found = traces.join(wanted.select(*key).distinct(), list(key), "left_semi")
    return one_of(found, key, F.desc(last)) if last else found


def judge_items(traces: DataFrame, tags: Sequence[str] = (), budget: int = 24000) -> DataFrame:
    """What a judge gets of each trace: ids, the head of problem and answer, the reasoning cut to ``budget``, and ``tags``."""
    return traces.select(
        "uid", "dataset", "teacher", "domain", "reasoning_chars", F.substring("problem", 1, 1500).alias("problem"),
        head_and_tail("reasoning", budget).alias("reasoning"), F.substring("answer", 1, 1200).alias("answer"), *tags,
    )


def paired_and_standalone(manifest: DataFrame, small: DataFrame, large: DataFrame, others: DataFrame, budget: int = 24000) -> DataFrame:
    """Judge items of both traces of each manifest row (ds_id, glm_id), tagged with the pair, and of other traces, untagged.

    ``small`` is looked up by ds_id; ``large`` by glm_id, or else by ds_id. The job is ``paired``, or
    the dataset of a standalone trace.
    """
    columns = ("dataset", "teacher", "domain", "reasoning_chars", "problem", "reasoning", "answer")
    pairs = manifest.select("ds_id", "glm_id")
    left = pairs.join(small.select(F.col("uid").alias("ds_id"), *columns), "ds_id").withColumn("uid", F.col("ds_id"))
    right = resolve_pairs(pairs, large, ["uid", *columns])
    tagged = left.select("uid", "ds_id", "glm_id", *columns).unionByName(right.select("uid", "ds_id", "glm_id", *columns))
    tagged = judge_items(tagged.withColumnsRenamed({"ds_id": "pair_ds", "glm_id": "pair_glm"}), ["pair_ds", "pair_glm"], budget)
    return tagged.withColumn("job", F.lit("paired")).unionByName(judge_items(others, budget=budget).withColumn("job", F.col("dataset")), allowMissingColumns=True)


def training_set(scores: DataFrame, least: int = 2, score: str = "ccr_closure") -> DataFrame:
    """Rows whose loop closes at ``least`` or more: those worth training on."""
    return scores.where(F.col(score) >= least)


def match_rate(manifest: DataFrame, probes: DataFrame, order: str) -> DataFrame:
    """(probes, matched, keys): rows of the large side, those with a partner, and distinct partners."""
    met = probes.join(manifest.select(F.col("probe_pos").alias(order), "ds_id"), order, "left")
    return met.agg(F.count(F.lit(1)).alias("probes"), F.count("ds_id").alias("matched"), F.count_distinct("ds_id").alias("keys"))
