"""Judging of traces through a backend, and parsing and checking of what judges return."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.text import judge_prompt, strip, text

#: Makers of backends by name: a backend answers a prompt with a judge's text, or raises.
BACKENDS: dict[str, Callable[[], Callable[[str], str]]] = {}
#: What is kept of an error.
ERROR_CHARS = 200


class Busy(Exception):
    """The endpoint asks to come back later, in ``after`` seconds if it says so."""

    def __init__(self, message: str = "busy", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def backend(name: str) -> Callable[[Callable[[], Callable[[str], str]]], Callable[[], Callable[[str], str]]]:
    def put(f: Callable[[], Callable[[str], str]]) -> Callable[[], Callable[[str], str]]:
        BACKENDS[name] = f
        return f

    return put


@backend("mock")
def mock() -> Callable[[str], str]:
    """Deterministic scores from a hash of the prompt."""

    def answer(prompt: str) -> str:
        h = hashlib.sha1(prompt.encode()).digest()
        out = dict.fromkeys(lx.JUDGMENT_FIELDS)
        out |= {"ccr_closure": h[0] % 5, "critique_present": h[1] % 2, "reasoning_topology": lx.TOPOLOGIES[h[2] % 5], "answer_change": ("none", "intermediate", "final")[h[3] % 3]}
        return "```json\n" + json.dumps(out) + "\n```"

    return answer


@dataclass(frozen=True)
class Endpoint:
    """A chat-completion endpoint: its url, model and key."""

    url: str
    model: str
    key: str = ""


#: (endpoint, request) -> response, both as JSON objects; raises Busy where the endpoint asks to wait.
Transport = Callable[[Endpoint, dict], dict]


def http_transport(endpoint: Endpoint, request: dict, seconds: float = 120.0) -> dict:
    """POST over HTTP; 429 and 5xx are Busy, with the time that Retry-After names."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {endpoint.key}"} if endpoint.key else {})
    call = urllib.request.Request(endpoint.url, json.dumps(request).encode(), headers)  # noqa: S310
    try:
        with urllib.request.urlopen(call, timeout=seconds) as got:  # noqa: S310
            return json.load(got)
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            after = e.headers.get("Retry-After", "")
            raise Busy(f"HTTP {e.code}", float(after) if after.isdigit() else None) from e
        raise


class Chat:
    """A backend over one or several endpoints, in turn.

    An endpoint that is busy rests for a cooldown that doubles each time and ends with an answer;
    while all rest, the call waits for the first one. Other errors go to the next endpoint. A prompt
    is given up after ``tries`` calls.
    """

    def __init__(self, endpoints: Sequence[Endpoint], transport: Transport = http_transport, system: str = "", tries: int = 6, cooldown: float = 1.0, longest: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.endpoints, self.transport, self.system = list(endpoints), transport, system
        self.tries, self.cooldown, self.longest, self.clock, self.sleep = tries, cooldown, longest, clock, sleep
        self.rest_until, self.busy, self.turn = [0.0] * len(self.endpoints), [0] * len(self.endpoints), 0

    def _next(self) -> int:
        """The next endpoint in turn that doesn't rest, after a wait if all do."""
        n = len(self.endpoints)
        order = [(self.turn + i) % n for i in range(n)]
        at = min(order, key=lambda i: (max(0.0, self.rest_until[i] - self.clock()), order.index(i)))
        if (wait := self.rest_until[at] - self.clock()) > 0:
            self.sleep(wait)
        self.turn = (at + 1) % n
        return at

    def __call__(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": prompt}]
        why: Exception | None = None
        for _ in range(self.tries):
            at = self._next()
            endpoint = self.endpoints[at]
            try:
                got = self.transport(endpoint, {"model": endpoint.model, "messages": messages, "temperature": 0})
                content = got["choices"][0]["message"]["content"]
                self.busy[at] = 0
                return content
            except Busy as e:
                why = e
                self.busy[at] += 1
                self.rest_until[at] = self.clock() + (e.after if e.after is not None else min(self.longest, self.cooldown * 2 ** (self.busy[at] - 1)))
            except Exception as e:  # noqa: BLE001  whatever an endpoint raises, the next one is tried
                why = e
        raise why if why is not None else ValueError("no tries")


def chat_backend(name: str, endpoints: Sequence[Endpoint], **options: object) -> None:
    """Register a Chat backend; each partition makes one of its own."""
    BACKENDS[name] = lambda: Chat(endpoints, **options)


def file_backend(name: str, answers: dict[str, str]) -> None:
    """Register a backend that gives recorded answers by the SHA-1 of the prompt; a prompt without one is an error."""

    def make() -> Callable[[str], str]:
        return lambda prompt: answers[hashlib.sha1(prompt.encode()).hexdigest()]

    BACKENDS[name] = make


def call(traces: DataFrame, name: str = "mock") -> DataFrame:
    """(dataset, uid, content, error) of each trace (dataset, uid, problem, reasoning, answer).

    Partitions call the backend one prompt after another; what it raises stays as the row's error.
    Filter and anti-join before this: Spark doesn't push predicates through it.
    """
    make = BACKENDS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            content, error = [], []
            for prompt in pdf["prompt"]:
                got, why = None, None
                try:
                    got = ask(prompt)
                except Exception as e:  # noqa: BLE001  kept with the row
                    why = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
                content.append(got)
                error.append(why)
            yield pdf[["dataset", "uid"]].assign(content=content, error=error)

    prompts = traces.select("dataset", "uid", judge_prompt("problem", "reasoning", "answer").alias("prompt"))
    return prompts.mapInPandas(run, "dataset string, uid string, content string, error string")


def parse(content: Column | str) -> Column:
    """The JSON object of a judge's answer as a variant; null without one.

    Tried in turn: the first fenced block (or all), the greedy object, and the text up to its last brace.
    """
    c = text(content)
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    first = F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)
    whole = strip(c)
    cut = F.when(whole.startswith("{"), F.concat(F.regexp_extract(whole, r"(?s)^(.*)\}", 1), F.lit("}")))
    found = F.coalesce(*(F.try_parse_json(F.nullif(strip(x), F.lit(""))) for x in (first, F.regexp_extract(c, r"(?s)\{.*\}", 0), cut)))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def integer_field(judgment: Column, field: str) -> Column:
    """A field that holds a whole number, null for other types; true and false count as 1 and 0."""
    kind = F.schema_of_variant(F.try_variant_get(judgment, f"$.{field}", "variant"))
    return F.when(kind.isin("BIGINT", "BOOLEAN"), F.try_variant_get(judgment, f"$.{field}", "int"))


def problems(judgment: Column, fields: tuple[str, ...] = lx.JUDGMENT_FIELDS) -> Column:
    """Sorted names of what is wrong with a judgment: missing fields, a score or topology out of range."""
    has = lambda f: F.try_variant_get(judgment, f"$.{f}", "variant").isNotNull()
    missing = [F.when(~has(f), F.lit(f"missing:{f}")) for f in fields]
    score = integer_field(judgment, "ccr_closure")
    topology = F.try_variant_get(judgment, "$.reasoning_topology", "string")
    bad = [F.when(score.isNull() | ~score.between(0, 4), F.lit("bad:ccr_closure")), F.when(topology.isNotNull() & ~topology.isin(*lx.TOPOLOGIES), F.lit("bad:reasoning_topology"))]
    return F.when(judgment.isNotNull(), F.array_sort(F.array_compact(F.array(*missing, *bad)))).otherwise(F.array(F.lit("no object")))


def judge(traces: DataFrame, name: str = "mock") -> DataFrame:
    """(dataset, uid, status, ccr_closure, reasoning_topology, qc) of each trace."""
    parsed = call(traces, name).withColumn("judgment", parse("content"))
    status = F.when(F.col("judgment").isNotNull(), "judged").otherwise("error")
    return parsed.select("dataset", "uid", status.alias("status"), integer_field(F.col("judgment"), "ccr_closure").alias("ccr_closure"), F.try_variant_get("judgment", F.lit("$.reasoning_topology"), "string").alias("reasoning_topology"), problems(F.col("judgment")).alias("qc"))
