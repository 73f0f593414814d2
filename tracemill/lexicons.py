"""Patterns of the text metrics, and their forms for Spark's regex engine.

A pattern gets Unicode classes and ``\\n`` as the only line end in front, so that it
means in Java what it means in Python. Patterns that ignore case run on lower-cased text
instead, which takes Java a fraction of the time; their letters are all lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from re import _parser

# The metrics are defined by these very patterns.
DENSITY_A = r"(?i)\b(wait|but|however|actually|reconsider|check|verify|mistake|wrong|recompute|let me|hmm)\b"
DENSITY_B = (
    r"(?i)\b(wait|but|however|actually|reconsider|recheck|check|verify|mistake|wrong|"
    r"recompute|let me|hmm|oops|incorrect)\b|不对|等等|然而|重新|检查|验证|错误|修正"
)
CRITIQUE = (
    r"(?i)\b(wait|but|however|actually|reconsider|recheck|re-check|check|verify|mistake|wrong|"
    r"recompute|let me|hmm|oops|incorrect|hold on|on second thought)\b|不对|等等|然而|重新|检查|验证|错误|修正"
)
ASSERTION = (
    r"(?i)\b(the answer is|therefore|thus|clearly|obviously|it follows that|we can conclude|"
    r"this means|the result is|certainly|definitely)\b|(答案[是为]|因此|所以|显然|可以得出|结论[是为])"
)
OVERTHROW = (
    r"(?is)((earlier|previously|above|before|i (said|stated|concluded|assumed)).{0,90}"
    r"(wrong|incorrect|mistake|flawed|not right|doesn't hold|does not hold))"
    r"|((wait|hold on|actually).{0,50}(this (is|was) wrong|let me reconsider|i need to rethink))"
    r"|((之前|前面|上面|刚才).{0,50}(错了|不对|有误|不成立))"
)
BACKREF = (
    r"(?i)(as (mentioned|shown|noted|discussed|established|calculated) (above|earlier|before|previously)|"
    r"from (step|equation|part) (\d+)|recall(ing)? that|going back to|using the (result|value|equation) (from|we))"
    r"|如前[所面]述|根据(前面|上面|之前)|回[到顾]"
)
CAUSAL = r"(?i)\b(therefore|hence|thus|consequently|so |as a result|this (means|implies|gives))\b|因此|所以|由此"
BRANCH = r"(?i)\b(alternatively|on the other hand|another (approach|way|method)|case [12]|if .{0,30} then)\b|另一[方种]面|或者|如果"
MERGE = r"(?i)\b(combining|integrating|in (summary|conclusion)|putting it all together|overall|taking (both|all))\b|综合|综上|总[结的]来"
LOGIC = (
    r"(?i)\b(if|then|therefore|thus|hence|so|because|since|assume|suppose|let|given|"
    r"implies|follows|provided|otherwise|whereas|consequently|iff|where|define)\b"
    r"|因为|所以|因此|假[设如]|令|设|由此|则|当且仅当|定义|推出"
)
NOISE = (
    r"(?i)(as an ai|i (might|may|could) be wrong|i apologize|i'm sorry|sorry|"
    r"i hope this helps|please note|it's worth noting|just to clarify|"
    r"i'm just|to be honest|if i'm not mistaken|disclaimer|of course|certainly!)"
    r"|抱歉|对不起|需要注意|值得注意|希望(这)?对你有帮助|当然"
)
ACTIONS = {
    "VERIFY": r"(?i)(let me (check|verify|confirm|double.?check)|to verify|checking|验证|检查)",
    "CRITIQUE": r"(?i)(wait|hold on|but this|however this|this (is|seems) wrong)|等等|不对|这.{0,5}(有问题|错了)",
    "CONCLUDE": r"(?i)(therefore|thus|in conclusion|the (answer|result|solution) is)|因此|所以|结论|答案",
    "EXPLORE": r"(?i)(alternatively|another (way|approach)|what if|suppose)|另一[种方]|或者|假[设如]",
    "DECOMPOSE": r"(?i)(let me break|step \d|first.{0,10}(we|i) (need|should|will))|分[解步]|第[一二三四\d]步|首先",
    "CALCULATE": r"(?i)(calculating|computing|evaluating|substituting|plugging in)|计算|代入|求解|\$.*[=+\-*/].*\$",
}
FORMATS = {
    "math": r"\$.+?\$|\\boxed|\\frac|\\sum|\\int|[=≠≤≥]\s*\d|\b\d+\s*[+\-*/]\s*\d+",
    "code": r"```|\bdef \b|\bimport \b|\breturn \b|[{};]\s*$|^\s*(for|while|if)\s*\(",
    "list": r"(?i)^\s*(\d+[.)]|[-*•]|\bstep \d)",
    "table": r"\|.+\|",
}
STEP = r"(?i)step (\d+)"
THINK = r"(?is)<think(?:ing)?>(.*?)</think(?:ing)?>(.*)"
PARAGRAPH_BREAK = r"\n\s*\n"
WORD = r"\b\w+\b"
LONG_WORD = r"\b\w{4,}\b"
CHUNK = r"\S+"
NATIVE_SETS = ("glm", "deepseek", "kimi", "qwen", "gemini")
RECONSTRUCTED_SETS = ("claude46_ti", "claude47_ti", "angrygiraffe")
TOPOLOGIES = ("chain", "tree", "graph", "loop", "drift")
JUDGMENT_FIELDS = (
    "critique_present", "monitoring_control_coupling", "causal_depth_of_critique", "answer_change",
    "verification_independence", "ccr_closure", "failure_type", "reasoning_topology", "uncertainty_stage",
    "early_assertion", "overthrow_present", "planning_depth", "plan_execution_consistency", "divergent_score",
    "creative_destruction", "templated_divergence", "evidence", "rationale", "judge_confidence",
)
# End of fixed values.


_CLASSES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w"}


def _starts(items: Iterable) -> tuple[set[str] | None, bool]:  # parsed items of a pattern
    """(the characters and classes that can stand first, or None if that isn't known; whether nothing at all matches too)."""
    out: set[str] = set()
    for op, arg in items:
        match str(op):
            case "AT":
                continue
            case "LITERAL":
                return out | {chr(arg)}, False
            case "IN":
                found = {chr(a) if str(o) == "LITERAL" else _CLASSES.get(str(a)) for o, a in arg if str(o) in ("LITERAL", "CATEGORY")}
                return (None if None in found or len(found) < len(arg) else out | found), False
            case "BRANCH":
                parts = [_starts(x) for x in arg[1]]
            case "SUBPATTERN":
                parts = [_starts(arg[3])]
            case "MAX_REPEAT" | "MIN_REPEAT":
                first, empty = _starts(arg[2])
                parts = [(first, empty or arg[0] == 0)]
            case _:
                return None, False
        if any(first is None for first, _ in parts):
            return None, False
        out = out.union(*(first for first, _ in parts))
        if not any(empty for _, empty in parts):
            return out, False
    return out, True


def _first(pattern: str) -> set[str] | None:
    first, empty = _starts(_parser.parse(pattern))
    return None if empty else first


def _ahead(first: set[str]) -> str:
    """Looks ahead for one of ``first``, or for what lies between those beyond ASCII: one range is faster than many characters, and lets more through at worst."""
    far = sorted(c for c in first if not c.isascii())
    near = sorted(c if len(c) > 1 or c.isalnum() else "\\" + c for c in first if c.isascii())
    return f"(?=[{''.join(near)}{far[0] + '-' + far[-1] if far else ''}])"


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside of groups and classes."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|[()|]", pattern):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "|" and not depth:
            out.append(pattern[begin : m.start()])
            begin = m.end()
    return [*out, pattern[begin:]]


def guarded(pattern: str) -> str:
    """A pattern without flags that matches the same, but looks at one character before it tries its alternatives.

    Java tries all of them at every place of a text. Before ``\\b`` and a word character it also
    looks back for a letter, which costs less than the boundary itself.
    """
    first = _first(pattern)
    if first is None or len(first) < 2 or pattern.startswith("^"):
        return pattern
    alts, out = _alternatives(pattern), []
    for a in alts:
        begin = _first(a)
        if a.startswith(r"\b") and all(c in (r"\d", r"\w") or (c.isascii() and c.isalnum()) for c in begin):
            a = "(?<![a-z0-9_])" + a  # noqa: PLW2901
        out.append((a, all(not c.isascii() for c in begin)))
    cut = next((i for i in range(len(out) + 1) if all(far for _, far in out[i:])), len(out))
    far = "|".join(a for a, _ in out[cut:])
    tail = [f"{_ahead(_first(far))}(?:{far})"] if 0 < cut < len(out) else [far] if far else []
    return f"{_ahead(first)}(?:{'|'.join([a for a, _ in out[:cut]] + tail)})"


@cache
def java(pattern: str) -> str:
    """The pattern in Java, to be run on ``folded`` text if it ignores case."""
    flags = re.match(r"\(\?(i?s?)\)|", pattern)
    rest = pattern[flags.end() :]
    # A run of word characters that is as long as can be has boundaries at both ends.
    run = re.fullmatch(r"\\b(\\w(?:\+|\{\d+,\}))\\b", rest)
    return "(?U)(?d)" + ("(?s)" if "s" in (flags[1] or "") else "") + (run[1] if run else guarded(rest))


def ignores_case(pattern: str) -> bool:
    return pattern.startswith("(?i")
