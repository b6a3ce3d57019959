"""A cache of usage checks as stream state: a verdict holds while the file is unchanged and not too old.

Fixed values: a verdict expires after 24 hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOURS = 24
SCHEMA = "source_path string, target_path string, ts timestamp, used boolean, outcome string"


def cached(requests: DataFrame, late: str = "10 minutes", hours: int = HOURS) -> DataFrame:
    """(source_path, target_path, ts, used, outcome) for each request (source_path, target_path, mtime_ms, used, ts).

    ``used`` of a request is the verdict to store, or null where only a lookup is meant.  The outcome is
    stored, hit, absent, changed (the file has another time) or expired.  Requests of one pair are taken in
    order of time within a batch, stores first where times tie; state goes when its last verdict expires.
    """
    span = hours * 3_600_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mtime, used, at = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).assign(lookup=lambda f: f["used"].isna()).sort_values(["ts", "lookup"], kind="stable")
        out = []
        for r in rows.itertuples():
            now = int(r.ts.timestamp() * 1000)
            verdict, outcome = None, "hit"
            if not r.lookup:
                mtime, used, at, outcome = int(r.mtime_ms), bool(r.used), now, "stored"
                verdict = used
            elif at is None:
                outcome = "absent"
            elif now - at > span:
                mtime = used = at = None
                outcome = "expired"
            elif mtime != r.mtime_ms:
                mtime = used = at = None
                outcome = "changed"
            else:
                verdict = used
            out.append((*key, r.ts, verdict, outcome))
        if at is None:
            if state.exists:
                state.remove()
        else:
            state.update((mtime, used, at))
            state.setTimeoutTimestamp(max(at + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source_path", "target_path", "ts", "used", "outcome"]).astype({"used": "object"})

    marked = requests.withWatermark("ts", late)
    return marked.groupBy("source_path", "target_path").applyInPandasWithState(run, SCHEMA, "mtime_ms long, used boolean, at long", "append", GroupStateTimeout.EventTimeTimeout)
