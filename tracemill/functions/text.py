"""Column builders for the row-wise text transforms. Null texts count as empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as lx

TEXTS = "array<string>"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def folded(c: Column) -> Column:
    """Lower case, the long s as s; ``replace`` looks for its bytes, where ``translate`` looks every character up."""
    return F.replace(F.lower(c), F.lit("ſ"), F.lit("s"))


def matches(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern occurs in ``c``; ``low`` is ``c`` folded, if that is at hand."""
    if lx.ignores_case(pattern):
        c = folded(c) if low is None else low
    return c.rlike(lx.java(pattern))


#: What ``\s`` means in Unicode: the separators and the control characters among white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_problem(c: Column | str, unicode: bool = True) -> Column:
    """Compatibility form, lower case, single spaces, stripped. Without ``unicode`` it stays in the JVM, for ASCII texts."""
    t = nfkc(text(c)) if unicode else text(c)
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def problem_hash(c: Column | str, unicode: bool = True) -> Column:
    return F.sha1(normalize_problem(c, unicode).cast("binary"))


def derived_uid(c: Column | str) -> Column:
    """The first 16 hex digits of the SHA-1 of the raw problem."""
    return F.substring(F.sha1(text(c).cast("binary")), 1, 16)


def split_thinking(c: Column | str) -> tuple[Column, Column]:
    """(reasoning, answer) of the first think block; without a closed one all is answer."""
    t, pattern = text(c), "(?U)(?d)" + lx.THINK
    has = t.rlike(pattern)
    return F.when(has, strip(F.regexp_extract(t, pattern, 1))).otherwise(F.lit("")), strip(F.when(has, F.regexp_extract(t, pattern, 2)).otherwise(t))


def split_generated(c: Column | str) -> tuple[Column, Column, Column]:
    """(reasoning, answer, closed) at literal tags: before the first closing one, after the last."""
    t = text(c)
    parts = F.split(t, "</think>", -1)
    closed = F.size(parts) > 1
    think = F.when(closed, F.element_at(parts, 1)).otherwise(t)
    return strip(F.replace(think, F.lit("<think>"), F.lit(""))), F.when(closed, strip(F.element_at(parts, -1))).otherwise(F.lit("")), closed


def head_and_tail(c: Column | str, budget: int) -> Column:
    """Texts over ``budget`` characters keep half of it from either end."""
    t, half = text(c), budget // 2
    cut = F.concat(F.substring(t, 1, half), F.lit("\n\n[... "), (F.length(t) - budget).cast("string"), F.lit(" chars elided ...]\n\n"), F.right(t, F.lit(half)))
    return F.when(F.length(t) <= budget, t).otherwise(cut)


#: What a panel's judges read of the final answer, in two wordings (fixed values).
ANSWER_LABELS = {"batch": "FINAL ANSWER (context only — do NOT score its correctness)", "panel": "FINAL ANSWER (context only — do NOT score correctness)"}


def judge_prompt(problem: Column | str, reasoning: Column | str, answer: Column | str, budget: int | None = 24000, problem_chars: int = 2000, answer_chars: int = 2000, label: str = "FINAL ANSWER (context only)", reasoning_label: str = "REASONING (to be scored)") -> Column:
    """The text a judge reads about a trace; without a ``budget`` all of the reasoning."""
    shown, note = text(reasoning), F.lit("")
    if budget is not None:
        shown = head_and_tail(reasoning, budget)
        note = F.when(F.length(text(reasoning)) > budget, F.lit("\n[NOTE: only the head and the tail of the reasoning are shown; judge what is visible with lower confidence.]")).otherwise(note)
    return F.concat(
        F.lit("PROBLEM:\n"), F.substring(text(problem), 1, problem_chars),
        F.lit(f"\n\n{reasoning_label}:\n"), shown, note,
        F.lit(f"\n\n{label}:\n"), F.substring(text(answer), 1, answer_chars),
        F.lit("\n\nReturn the JSON object now."),
    )


def batch_prompt(problem: Column | str, reasoning: Column | str, answer: Column | str, wording: str = "batch") -> Column:
    """The prompt of a batch item, which is cut already: 2,000 characters of problem and answer for ``batch``, 1,500 and 1,200 for ``panel``."""
    heads = (2000, 2000) if wording == "batch" else (1500, 1200)
    return judge_prompt(problem, reasoning, answer, None, *heads, label=ANSWER_LABELS[wording], reasoning_label="MODEL CoT (reasoning to be scored)")


def count_matches(c: Column | str, pattern: str) -> Column:
    t = folded(text(c)) if lx.ignores_case(pattern) else text(c)
    return F.regexp_count(t, F.lit(lx.java(pattern))).cast("long")


def density(c: Column | str, pattern: str) -> Column:
    """Matches per 1,000 tokens of four characters."""
    return F.lit(1000.0) * count_matches(c, pattern) / F.greatest(F.length(text(c)) / F.lit(4.0), F.lit(1.0))


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), lx.java(lx.PARAGRAPH_BREAK), -1), strip), lambda p: p != "")


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(lx.java(pattern)), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(c), lx.WORD))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; their union's size follows from the intersection's."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)).cast("double"))


def first_match(c: Column, patterns: dict[str, str], otherwise: str, low: Column | None = None) -> Column:
    out = F.lit(otherwise)
    for name, p in reversed(patterns.items()):
        out = F.when(matches(c, p, low), F.lit(name)).otherwise(out)
    return out


def log_length(chars: Column) -> Column:
    return F.log10(F.greatest(chars, F.lit(1)).cast("double"))


def sql_functions() -> dict[str, str]:
    """Bodies of the SQL functions of a text x, by name; ``nfkc`` is a vectorised function beside them."""
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    norm = f"trim(regexp_replace(lower(nfkc(coalesce(x, ''))), {quoted(r'(?U)\s+')}, ' '))"
    low = "replace(lower(coalesce(x, '')), 'ſ', 's')"
    return {
        "normalize_problem": norm,
        "problem_hash": f"sha1(cast({norm} AS BINARY))",
        "derived_uid": "substring(sha1(cast(coalesce(x, '') AS BINARY)), 1, 16)",
        "critique_density": f"1000.0D * regexp_count({low if lx.ignores_case(lx.DENSITY_B) else 'coalesce(x, \'\')'}, {quoted(lx.java(lx.DENSITY_B))}) / greatest(length(coalesce(x, '')) / 4.0D, 1.0D)",
    }


def register_sql(spark: SparkSession) -> None:
    """Make ``sql_functions`` and ``nfkc`` callable from SQL in this session."""
    spark.udf.register("nfkc", nfkc)
    for name, body in sql_functions().items():
        kind = "DOUBLE" if name == "critique_density" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
