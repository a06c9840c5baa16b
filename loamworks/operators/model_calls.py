"""Model calls as rows: batched fan-out, structured answers, typed failures. Clients are injected; there is no network here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "item_id long, result string, reason string, raw_output string"
FENCE = re.compile(r"```[^\n`]{0,19}\n(.*)```", re.S)


class Retryable(Exception):
    """What a client raises when another try may help."""


def blob(raw: str) -> str:
    """The JSON in an answer: inside a fence, else the outermost object, else the outermost array."""
    said = (raw or "").strip()
    if m := FENCE.search(said):
        return m[1].strip()
    for a, b in ("{}", "[]"):
        i, j = said.find(a), said.rfind(b)
        if 0 <= i < j:
            return said[i : j + 1]
    return said


def repaired(said: str) -> str:
    """With bare keys quoted, trailing commas dropped and open brackets closed."""
    out, stack, quoted, i = [], [], False, 0
    while i < len(said):
        c = said[i]
        if quoted:
            out.append(c)
            if c == "\\" and i + 1 < len(said):
                i += 1
                out.append(said[i])
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
            out.append(c)
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            _drop_comma(out)
            if stack:
                out.append(stack.pop())
        elif m := re.match(r"[A-Za-z_]\w*(?=\s*:)", said[i:]):
            out.append(f'"{m[0]}"')
            i += len(m[0]) - 1
        else:
            out.append(c)
        i += 1
    if quoted:
        out.append('"')
    _drop_comma(out)
    return "".join(out) + "".join(reversed(stack))


def _drop_comma(out: list[str]) -> None:
    while out and out[-1].isspace():
        out.pop()
    if out and out[-1] == ",":
        out.pop()


def parse(raw: str, required: tuple[str, ...]) -> tuple[dict | None, str | None]:
    """The answer as an object with the required keys, or why it is none."""
    said = blob(raw)
    if not said:
        return None, "empty answer"
    for text in (said, repaired(said)):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        if not isinstance(got, dict):
            return None, "not an object"
        if lacking := [k for k in required if k not in got]:
            return None, f"missing {', '.join(lacking)}"
        return got, None
    return None, "not JSON"


def ask(client: Callable[[str, int], str], prompt: str, required: tuple[str, ...], tokens: int, ceiling: int, tries: int, wait: float, repair: Callable[[str, str], str] | None) -> tuple[str | None, str | None, str]:
    """One call: retries with growing waits, more tokens after an answer that breaks off, at last one repair call."""
    raw, why = "", "no answer"
    for n in range(tries):
        try:
            raw = client(prompt, tokens)
        except Retryable as e:
            why = f"unavailable: {e}"
            time.sleep(wait * 2**n)
            continue
        except Exception as e:  # noqa: BLE001 - a failed call is a row, not a failed job
            return None, f"call failed: {e}", raw
        got, why = parse(raw, required)
        if got is not None:
            return json.dumps(got), None, raw
        if raw.count("{") <= raw.count("}") or tokens >= ceiling:
            break
        tokens = min(ceiling, 2 * tokens)
    if repair and raw:
        try:
            got, why2 = parse(repair(raw, why or ""), required)
        except Exception as e:  # noqa: BLE001
            got, why2 = None, str(e)
        if got is not None:
            return json.dumps(got), None, raw
        why = why2
    return None, why, raw


def fan_out(items: DataFrame, client: Callable[[], Callable[[str, int], str]], required: tuple[str, ...], tokens: int = 2048, ceiling: int = 8000, tries: int = 3, wait: float = 1.0, width: int = 6, repair=None) -> DataFrame:
    """item_id, result, reason, raw_output for items (item_id, prompt): exactly one of result and reason is null.

    `client` makes a client on each worker; `width` partitions ask at a time. Calls cost, so write the
    answers before using them twice. Repeated item_ids after a retried task: keep one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for part in parts:
            rows = [(i, *ask(call, p, required, tokens, ceiling, tries, wait, repair)) for i, p in zip(part["item_id"], part["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "result", "reason", "raw_output"])

    return items.select("item_id", "prompt").repartition(width).mapInPandas(run, ANSWER)


def findings(answers: DataFrame, work: DataFrame) -> DataFrame:
    """One row per finding with a title, with the work item's own columns; answers with failures give none."""
    raw = "array<struct<title: string, detail: string, evidence: string, section: string, page: int, table_ref: string, severity: string>>"
    rows = answers.where("result IS NOT NULL").select("item_id", F.posexplode(F.from_json("result", f"findings {raw}")["findings"]).alias("finding_ord", "f"))
    return rows.join(work.drop("prompt"), "item_id").select("*", "f.*").drop("f").where("trim(coalesce(title, '')) <> ''").withColumn("title", F.trim("title"))


def failures(answers: DataFrame) -> DataFrame:
    return answers.where("reason IS NOT NULL").select("item_id", "reason", "raw_output", F.lit(True).alias("requires_human_review"))
