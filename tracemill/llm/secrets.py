"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content (a blob). The ledger
holds which blobs were scanned under which version of which rule. Only the pairs that it
lacks are scanned, each blob once however many paths hold it, and the findings are joined
back to all paths. Documents may hold many versions of one path; an equal version that came
back is a blob that the ledger knows. ``append`` keeps the ledger as a Parquet table.

Regex matches get places by splitting a text at its matches: the lengths of the pieces
between and of the matches add up to where each match begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, inner_prefix


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def screen(self) -> str:
        """A pattern that every text with a finding contains, without the length's condition."""
        return self.pattern


KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", 1, rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Places (start, end) of a rule's findings in code points, leftmost first and apart."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    triples = F.arrays_zip(lengths.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("own"), F.transform(tested, lambda x: F.length(x)).alias("part"))
    none = F.array().cast(SPAN)

    def step(s: Column, t: Column) -> Column:
        start = (s["at"] + t["gap"]).cast("int")
        end = (start + F.coalesce(t["own"], F.lit(0))).cast("int")
        new = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["part"] >= rule.least, F.concat(s["found"], new)).otherwise(s["found"]).alias("found"))

    found = F.aggregate(triples, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.when(text.rlike(rule.screen), found).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``docs``, the ledger with what this scan added).

    ``docs``: (doc_id, text), doc_id naming the path; several rows of one doc_id are its versions.
    Findings: doc_id, blob and ``spans``, an array of (start, end, kind, kind_at) by start, then
    the order of the rules. ``ledger``: (blob, kind, version, spans) as returned by an earlier
    scan; None is an empty one. Null texts count as empty. Repeated rows and null ids stay; an
    empty table gives an empty result.
    """
    found, added = _scanned(docs, ledger, rules)
    return found, added if ledger is None else ledger.select(*added.columns).union(added)


def scan_in_turn(arrivals: list[DataFrame], rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of all rows, the ledger) of tables that arrive one after the other, each scanned against the ledger grown so far."""
    found, ledger = scan(arrivals[0], None, rules)
    for docs in arrivals[1:]:
        more, ledger = scan(docs, ledger, rules)
        found = found.union(more)
    return found, ledger


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that ``append`` wrote, each (blob, kind, version) once however often a retried append wrote it."""
    return spark.read.schema(f"blob string, kind string, version int, spans {SPAN}").parquet(path).dropDuplicates(["blob", "kind", "version"])


def append(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``docs`` against the ledger table at ``path``, made if it isn't there; what was scanned is appended to it."""
    spark = docs.sparkSession
    spark.createDataFrame([], f"blob string, kind string, version int, spans {SPAN}").write.mode("append").parquet(path)
    found, added = _scanned(docs, read_ledger(spark, path), rules)
    found = checkpointed(found)
    added.write.mode("append").parquet(path)
    return found


def _scanned(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(findings, rows that the ledger lacked)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), blob_of(text).alias("blob"))
    paths = checkpointed(rows.select("doc_id", "blob"))
    wanted = paths.select("blob").distinct()
    kinds = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    pairs = wanted.select("blob", F.explode(F.array(*kinds)).alias("k")).select("blob", "k.kind", "k.version")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    unseen = pairs.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("todo"))
    # One row of each unseen blob brings the text. Its place is picked by the least doc_id, then one of equal rows.
    chosen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(unseen, "blob")
    chosen = chosen.select(F.col("blob").alias("of"), F.col("doc_id").alias("first"), "todo").hint("shuffle_hash")
    source = rows.join(chosen, (F.col("blob") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))
    found = [F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), spans(F.col("text"), r)).alias(r.kind) for r in rules]
    scanned = source.select("blob", *found)
    added = scanned.select("blob", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules))).alias("e"))
    added = checkpointed(added.where("e.spans is not null").select("blob", "e.kind", "e.version", "e.spans").dropDuplicates(["blob", "kind", "version"]))
    known = added if ledger is None else ledger.select(*added.columns).union(added)
    return _joined(paths, known, rules), added


def _joined(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    now = F.lit(False)
    order = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        mine = (F.col("kind") == r.kind) & (F.col("version") == r.version)
        now, order = now | mine, F.when(mine, F.lit(i)).otherwise(order)
    flat = ledger.where(now & (F.size("spans") > 0)).select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("kind_at"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("spans"))
    by_blob = flat.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with every span of ``findings`` (doc_id, blob, spans) in its text replaced by its kind in brackets.

    Findings belong to texts (blobs), so rows with null or repeated ids get those of their own
    text. Overlapping spans become one, of the first one's kind. All rows stay, repeated ones too;
    rows without findings stay as they are, null and empty texts too. ``n_chars`` follows where
    the table has it. Columns may have any names. An empty table gives an empty result.
    """
    inner = inner_prefix(docs)
    blob, spans, new = (inner + c for c in ("blob", "spans", "text"))
    # Equal texts have equal findings, so one row for each blob is joined, whatever the doc_ids are.
    hits = findings.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(spans))
    text = F.col("text").cast("string")
    joined = docs.withColumn(blob, blob_of(text)).join(hits, blob, "left")
    mine = F.col(spans).isNotNull()
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        inside = (x["start"] < s["at"]) & (F.size(s["out"]) > 0)
        out = F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(gap, F.concat(F.lit("["), x["kind"], F.lit("]")))))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    redacted = joined.withColumn(new, F.when(mine, F.aggregate(spans, zero, step, finish)).otherwise(text))
    columns = {"text": F.col(new)} | ({"n_chars": F.when(mine, F.length(new).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return redacted.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))
