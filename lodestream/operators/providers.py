"""Model calls: a callable is injected, errors become data, waits follow the provider's advice."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------
#: Longest wait; wait advised beyond which a quota counts as used up; failures in a row that mean the provider is down.
LONGEST_WAIT, QUOTA_WAIT, FAILURES = 60.0, 180.0, 2
# --------------------------------------------------------------------------------------------------------------


class ProviderError(Exception):
    """A failed call: HTTP status, message, and the Retry-After header if there was one."""

    def __init__(self, status: int, message: str, retry_after: str | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def advised_wait(message: Column, header: Column) -> Column:
    """Seconds that the provider asks to wait: the header, a retryDelay field, or "try again in 1m2.5s"; else null."""
    field = F.regexp_extract(message, r"(?i)retryDelay[^\p{L}\p{N}_]+([0-9]+(?:\.[0-9]+)?)s", 1)
    said = r"(?i)try again in (?:([0-9]+)m)?([0-9]+(?:\.[0-9]+)?)s"
    minutes, seconds = (F.regexp_extract(message, said, i).try_cast("double") for i in (1, 2))
    return F.coalesce(header.try_cast("double"), field.try_cast("double"), F.coalesce(minutes, F.lit(0.0)) * 60 + seconds)


def is_daily_quota(message: Column) -> Column:
    return message.rlike(r"(?i)per ?day|\b[RT]PD\b")


def _wait(error: ProviderError, attempt: int) -> float:
    text = str(error)
    try:
        return float(error.retry_after)
    except (TypeError, ValueError):
        pass
    if m := re.search(r"retryDelay\W+([0-9.]+[0-9]|[0-9])s", text, re.I):
        return float(m[1])
    if m := re.search(r"try again in (?:([0-9]+)m)?([0-9]+(?:\.[0-9]+)?)s", text, re.I):
        return 60 * int(m[1] or 0) + float(m[2])
    return min(LONGEST_WAIT, 5.0 * 2**attempt)


def first_object(text: str) -> dict:
    """The first JSON object of an answer; what follows it is ignored."""
    value, _ = json.JSONDecoder().raw_decode(text[max(0, text.find("{")) :])
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    return value


def call(rows: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds ``answer, error, status``: ok, failed, quota (used up) or down (too many failures in a row, not called).

    ``make`` builds the client on the executor. Refusals (4xx but 429) are not tried again.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(client: Callable[[str], str], text: str) -> tuple[str | None, str | None, str]:
        for attempt in range(attempts):
            try:
                return client(text), None, "ok"
            except TimeoutError:
                return None, "timeout", "failed"
            except ProviderError as error:
                if error.status == 429 and re.search(r"per ?day|\b[RT]PD\b", str(error), re.I):
                    return None, str(error), "quota"
                if 400 <= error.status < 500 and error.status != 429:
                    return None, str(error), "failed"
                wait, last = _wait(error, attempt), str(error)
                if wait > QUOTA_WAIT:
                    return None, last, "quota"
                if attempt + 1 < attempts:
                    sleep(wait)
        return None, last, "failed"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, failed, stopped = make(), 0, None
        for frame in frames:
            out = []
            for text in frame[prompt]:
                if stopped:
                    out.append((None, "not called", stopped))
                    continue
                out.append(one(client, text))
                failed = failed + 1 if out[-1][2] == "failed" else 0
                stopped = "quota" if out[-1][2] == "quota" else "down" if failed >= FAILURES else None
            yield frame.assign(**{name: [x[i] for x in out] for i, name in enumerate(("answer", "error", "status"))})

    return rows.mapInPandas(run, f"{fields}, answer string, error string, status string")


def claims(answer: Column) -> Column:
    """Claims of a judge's JSON answer: cited numbers each once, supporting ones only if cited. Null if it doesn't parse."""
    parsed = F.from_json(answer, "claims array<struct<claim:string,cited:array<string>,supported:boolean,supporting_cited:array<string>>>")["claims"]
    ints = lambda c: F.filter(F.transform(F.coalesce(c, F.array()), lambda x: F.when(x.rlike("^-?[0-9]+$"), x.try_cast("int"))), lambda n: n.isNotNull())
    cited = lambda c: F.array_distinct(ints(c["cited"]))
    return F.transform(parsed, lambda c: F.struct(c["claim"].alias("claim"), cited(c).alias("cited"), F.coalesce(c["supported"], F.lit(False)).alias("supported"), F.array_intersect(cited(c), ints(c["supporting_cited"])).alias("supporting_cited")))
