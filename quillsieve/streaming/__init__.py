"""Streaming forms of the session operators: keyed state that may have a time to live, equal to the batch folds."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..operators import sessions
from ..sources import write_sidecars

STATE = "value string"
#: Milliseconds after which an idle session loses its state. Set it for streams that never end (a day, say); with it,
#: a stream keeps making batches to find idle sessions, so one that is to end by itself (availableNow) leaves it None.
IDLE_MS: int | None = None


def _keyed(rows: DataFrame, step, outputs: str) -> DataFrame:
    """Apply ``step(state, row) -> (state, dict)`` to a session's rows in order of ``seq``; state is a JSON value."""
    idle_ms = IDLE_MS

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        frame = pd.concat(list(pdfs)).sort_values("seq")
        made = []
        for row in frame.to_dict("records"):
            held, values = step(held, row)
            made.append({"session": key[0], "seq": row["seq"], **values})
        state.update((json.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if made:
            yield pd.DataFrame(made)

    return rows.groupBy("session").applyInPandasWithState(run, f"session string, seq long, {outputs}", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def pressure_bands(calls: DataFrame) -> DataFrame:
    """``session, seq, band`` from ``session, seq, bytes``."""

    def step(held, row):
        band = sessions.next_band(held, row["bytes"])
        return band, {"band": band}

    return _keyed(calls, step, "band string")


def duplicates(calls: DataFrame) -> DataFrame:
    """``duplicate, age_ms`` from ``session, seq, hash, at, reset``: a ring of the last 20 hashes, emptied by a reset."""

    def step(held, row):
        ring = [] if row["reset"] else held or []
        last = next((at for own, at in reversed(ring) if own == row["hash"]), None)
        ring = [*ring, [row["hash"], int(row["at"])]][-C.DUP_RING :]
        return ring, {"duplicate": last is not None, "age_ms": None if last is None else max(0, int(row["at"]) - last)}

    return _keyed(calls, step, "duplicate boolean, age_ms long")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """``repeated`` from ``session, seq, call_id, hash``: the same call with the same content, among the last 200."""

    def step(held, row):
        state, (repeated,) = sessions.step_handled(OrderedDict(held or []), row)
        return list(state.items()), {"repeated": repeated}

    return _keyed(calls, step, "repeated boolean")


def narration(turns: DataFrame) -> DataFrame:
    """``total, exceeded`` from ``session, seq, profile, words, blocker, turn_key``."""

    def step(held, row):
        state, (total, fires) = sessions.step_narration(held or {}, row)
        return state, {"total": total, "exceeded": fires}

    return _keyed(turns, step, "total long, exceeded boolean")


def recovery(calls: DataFrame) -> DataFrame:
    """``kind`` from ``session, seq, epoch, cmd_hash, bypass, path, content, lossy, sidecar, sidecar_read, is_edit``; an epoch's change clears the ring."""

    def step(held, row):
        ring = held["ring"] if held and held["epoch"] == row["epoch"] else []
        kind, edited = None, False
        back = list(reversed(ring[-C.RECOVERY_WINDOW :]))
        same = lambda r: r["cmd"] and r["cmd"] == row["cmd_hash"]
        if row["bypass"] and any(map(same, back)):
            kind = "trim-bypass-rerun"
        elif row["sidecar_read"] and any(r["lossy"] and r["sidecar"] for r in back):
            kind = "artifact-retrieval"
        elif row["path"] and row["content"] and any((r["path"], r["content"]) == (row["path"], row["content"]) for r in back):
            kind = "same-read"
        else:
            for r in back:
                edited = edited or r["edit"]
                if same(r):
                    kind = "same-command" if edited else "unchanged-validation"
                    break
        own = {"cmd": row["cmd_hash"], "path": row["path"], "content": row["content"], "lossy": bool(row["lossy"]), "sidecar": bool(row["sidecar"]), "edit": bool(row["is_edit"])}
        return {"epoch": row["epoch"], "ring": [*ring, own][-C.RECOVERY_RING :]}, {"kind": kind}

    return _keyed(calls, step, "kind string")


def save_sidecars(path: str):
    """A function for ``foreachBatch``: saved outputs, once a name, also when a batch runs again."""

    def run(batch: DataFrame, _epoch: int) -> None:
        write_sidecars(batch, path)

    return run


__all__ = ["duplicates", "narration", "pressure_bands", "recovery", "repeated_calls", "save_sidecars"]
