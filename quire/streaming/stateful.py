"""Keyed folds on streams: the rolling limit and personal state, with state that caps keep bounded."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def stream_rolling_limit(events: DataFrame, key: str, most: int = 60, seconds: int = 3600) -> DataFrame:
    """The batch operator's admissions: at most `most` admitted in any hour; the state holds those of the last hour.

    Events of a key have to come in order; the source's files are read in theirs.
    """

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for at in rows["at"]:
            now = at.timestamp()
            held = [h for h in held if now - h < seconds]
            out.append(len(held) < most)
            if out[-1]:
                held.append(now)
        state.update((held,))
        yield pd.DataFrame({key: rows[key], "id": rows["id"], "at": rows["at"], "admitted": out})

    return events.select(key, "id", "at").groupBy(key).applyInPandasWithState(fold, f"{key} long, id long, at timestamp, admitted boolean", "held array<double>", "append", "NoTimeout")


def stream_personal(ops: DataFrame, most: int = 1000) -> DataFrame:
    """Save and remove operations, idempotent by operation id and fingerprint; the state is the places, the operations and the revision."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, seen, revision = json.loads(state.get[0]) if state.exists else ([], {}, 0)
        places = set(places)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            op, mark = str(row.op), [row.kind, int(row.place)]
            if op in seen:
                result = "repeated" if seen[op] == mark else "conflict"
            else:
                seen[op] = mark
                if row.kind == "save" and row.place not in places and len(places) >= most:
                    result = "full"
                else:
                    changed = (row.place not in places) == (row.kind == "save")
                    (places.add if row.kind == "save" else places.discard)(int(row.place))
                    revision += changed
                    result = "done" if changed else "same"
            out.append((name[0], row.seq, result, revision))
        state.update((json.dumps([sorted(places), seen, revision]),))
        yield pd.DataFrame(out, columns=["owner", "seq", "result", "revision"])

    return ops.groupBy("owner").applyInPandasWithState(fold, "owner long, seq long, result string, revision int", "held string", "append", "NoTimeout")
