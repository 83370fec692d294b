"""A long-lived session per key as a stream: requests change its declarations, replies tell the
status; reset clears it, a crash is an infrastructure status and leaves a fresh session, and an
idle session is dropped after a timeout."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPLY = "session string, seq long, op string, status string, failure_class string, declarations long"
STATE = "names array<string>, last long"
IDLE_MS = 3_600_000
_DECLARES = re.compile(r"^\s*(?:def|theorem)\s+(\S+)")
_USES = re.compile(r"^\s*#check\s+(\S+)")


def step(names: list[str], op: str, source: str | None) -> tuple[list[str], str, str | None]:
    """Declarations, status and class after one request."""
    if op == "reset":
        return [], "SUCCESS", None
    if op == "crash":
        return [], "RESOURCE_LIMIT", "INFRASTRUCTURE_FAILURE"
    text = source or ""
    if m := _DECLARES.match(text):
        if m[1] in names:
            return names, "FAIL_TYPECHECK", "MODEL_FAILURE"
        return [*names, m[1]], "SUCCESS", None
    if m := _USES.match(text):
        return (names, "SUCCESS", None) if m[1] in names else (names, "FAIL_TYPECHECK", "MODEL_FAILURE")
    return names, "FAIL_PARSE", "MODEL_FAILURE"


def _requests(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    names, last = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
    pdf = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in pdf.itertuples(index=False):
        if r.seq <= last:  # a request that was answered before
            continue
        last = int(r.seq)
        names, status, failure = step(names, r.op, r.source)
        out.append((key[0], last, r.op, status, failure, len(names)))
    state.update((names, last))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["session", "seq", "op", "status", "failure_class", "declarations"])


def replies(requests: DataFrame) -> DataFrame:
    """Replies to a stream of (session, seq, op, source) requests; repeated requests get none."""
    return requests.groupBy("session").applyInPandasWithState(_requests, REPLY, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
