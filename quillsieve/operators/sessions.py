"""Session operators: what a row means given the rows before it in its session.

Bounded looks back are windows. True folds run over a partitioning by session, sorted within partitions, in constant
memory a session; their streaming forms are in :mod:`quillsieve.streaming`.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .. import constants as C


def by_session():
    """A session's rows in order (windows need a running session, so they are made when asked for)."""
    return Window.partitionBy("session").orderBy("seq")


def so_far():
    return by_session().rowsBetween(Window.unboundedPreceding, 0)


def islands(calls: DataFrame, reset: Column, name: str = "island") -> DataFrame:
    """Number of resets so far; rows of one island share state."""
    return calls.withColumn(name, F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(so_far()).cast("long"))


def epoch_islands(calls: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Islands that begin wherever the epoch changes, also back to an earlier one."""
    return islands(calls.withColumn("__was", F.lag(epoch).over(by_session())), F.col(epoch) != F.col("__was")).drop("__was")


def exact_duplicates(calls: DataFrame, size: int = C.DUP_RING, among: Column | None = None) -> DataFrame:
    """``duplicate`` and ``age_ms``: the same hash among the island's last ``size`` rows. ``among``: only such rows count;
    the others are no duplicates."""
    rows = calls.withColumn("__in", F.coalesce(among, F.lit(False)) if among is not None else F.lit(True))
    rows = rows.withColumn("__pos", F.row_number().over(Window.partitionBy("session", "island", "__in").orderBy("seq")))
    same = Window.partitionBy("session", "island", "__in", "hash").orderBy("seq")
    rows = rows.withColumns({"__prev": F.lag("__pos").over(same), "__at": F.lag("at").over(same)})
    met = F.col("__in") & F.coalesce(F.col("__pos") - F.col("__prev") <= size, F.lit(False))
    return rows.withColumn("duplicate", met).withColumn("age_ms", F.when(met, F.greatest(F.lit(0).cast("long"), F.col("at") - F.col("__at")))).drop("__in", "__pos", "__prev", "__at")


def recovery(calls: DataFrame, window: int = C.RECOVERY_WINDOW) -> DataFrame:
    """``kind`` and facts of the row that a call goes back to, among the island's last five: a rerun with bypass, a read of
    a saved output, the same read, the same command with or without an edit between."""
    fields = ("pos", "cmd_hash", "path", "range", "content", "lossy", "sidecar", "marker", "applied", "is_edit", "at")
    own = Window.partitionBy("session", "island").orderBy("seq")
    rows = calls.withColumn("pos", F.row_number().over(own))
    ring = F.reverse(F.collect_list(F.struct(*fields)).over(own.rowsBetween(-window, -1)))
    rows = rows.withColumn("ring", ring)
    newest = lambda test: F.try_element_at(F.filter("ring", test), F.lit(1))
    same_command = newest(lambda x: x["cmd_hash"] == F.col("cmd_hash"))
    rows = rows.withColumns(
        {
            "m1": F.when(F.col("bypass"), same_command),
            "m2": F.when(F.col("sidecar_read"), newest(lambda x: x["lossy"] & x["sidecar"])),
            "m3": F.when(F.col("path").isNotNull() & F.col("content").isNotNull(), newest(lambda x: (x["path"] == F.col("path")) & x["range"].eqNullSafe(F.col("range")) & (x["content"] == F.col("content")))),
            "m4": same_command,
        }
    )
    edited = F.exists("ring", lambda x: x["is_edit"] & (x["pos"] >= F.col("m4.pos")))
    kind = (
        F.when(F.col("m1").isNotNull(), "trim-bypass-rerun").when(F.col("m2").isNotNull(), "artifact-retrieval").when(F.col("m3").isNotNull(), "same-read")
        .when(F.col("m4").isNotNull() & edited, "same-command").when(F.col("m4").isNotNull(), "unchanged-validation")
    )
    rows = rows.withColumn("kind", kind).withColumn("m", F.coalesce("m1", "m2", "m3", "m4"))
    return rows.select(
        *calls.columns, F.col("kind").isNotNull().alias("candidate"), "kind", F.col("m.marker").alias("preceding_marker"), F.coalesce("m.lossy", F.lit(False)).alias("preceding_lossy"),
        F.coalesce("m.applied", F.lit(False)).alias("preceding_applied"), (F.col("at") - F.col("m.at")).alias("age_ms"), (F.col("pos") - F.col("m.pos")).cast("long").alias("seq_gap"),
    )


def observed_bytes(calls: DataFrame, size: str = "bytes") -> DataFrame:
    """``observed`` bytes and ``turn`` of a session's island so far."""
    own = Window.partitionBy("session", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumns({"observed": F.sum(size).over(own), "turn": F.count("*").over(own)})


def prompt_as_of(events: DataFrame, is_prompt: Column, text: str = "text") -> DataFrame:
    """``prompt``: the newest prompt at or before a row."""
    return events.withColumn("prompt", F.last(F.when(is_prompt, F.col(text)), True).over(so_far()))


def note_once(calls: DataFrame, marked: Column) -> DataFrame:
    """``note``: true for the first marked row of a session's island."""
    own = Window.partitionBy("session", "island", "__marked").orderBy("seq")
    rows = calls.withColumn("__marked", F.coalesce(marked, F.lit(False)))
    return rows.withColumn("note", F.col("__marked") & (F.row_number().over(own) == 1)).drop("__marked")


def fold(rows: DataFrame, start: Callable, step: Callable, outputs: StructType, uses: tuple, keys: tuple = ("session",), order: tuple = ("seq",)) -> DataFrame:
    """``rows`` with ``outputs``: for each key in order, ``step(state, row) -> (state, values)``. ``uses``: the columns that
    ``step`` looks at, as far as there are; the others pass as they are."""
    schema = StructType([*rows.schema.fields, *outputs.fields])
    names, at = [n for n in uses if n in rows.columns], [rows.columns.index(k) for k in keys]
    seen = [rows.columns.index(n) for n in names]
    kinds = [pa.string() if f.dataType.typeName() == "string" else pa.bool_() if f.dataType.typeName() == "boolean" else pa.int64() for f in outputs.fields]

    def run(batches):
        key, state = None, None
        for batch in batches:
            owns = zip(*(batch.column(i).to_pylist() for i in at))
            values_of = zip(*(batch.column(i).to_pylist() for i in seen))
            made = []
            for own, values in zip(owns, values_of):
                row = dict(zip(names, values))
                if own != key:
                    key, state = own, start()
                state, values = step(state, row)
                made.append(values)
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def next_band(before: str, size: int | None) -> str:
    """Pressure band with a tenth of hysteresis."""
    if size is None:
        return "low"
    mid, high = C.PRESSURE_MID, C.PRESSURE_HIGH
    stays = {"high": size >= 0.9 * high, "mid": 0.9 * mid <= size < 1.1 * high, "low": size < 1.1 * mid}
    if stays.get(before):
        return before
    return "low" if size < mid else "mid" if size < high else "high"


#: A row's ``reset``, where there is such a column: a compaction clears the band and the narration; a switch (of session
#: or branch) the handled calls too.
COMPACTION, SWITCH = "compaction", "switch"


def step_band(state: str | None, row: dict):
    if row.get("reset") in (COMPACTION, SWITCH):
        return "low", ("low",)
    band = next_band(state, row["bytes"])
    return band, (band,)


def step_handled(state: OrderedDict, row: dict):
    """The last 200 calls' hashes, oldest out first; a call seen again moves to the end."""
    if row.get("reset"):
        return (OrderedDict() if row["reset"] == SWITCH else state), (False,)
    key, own = row["call_id"], row["hash"]
    if own is None:  # a call that left no content
        return state, (False,)
    if state.get(key) == own:
        return state, (True,)
    state.pop(key, None)
    state[key] = own
    while len(state) > C.HANDLED_MAX:
        state.popitem(last=False)
    return state, (False,)


def step_narration(state: dict, row: dict, budget: int = C.NARRATION_BUDGET):
    """Words of a turn; the meter fires over the budget, then after each further quarter of it."""
    if row.get("reset") in (COMPACTION, SWITCH):
        return {}, (None, False)
    if row["profile"] not in ("eval", "autonomous-loop") or not row["words"] or row["blocker"]:
        return state, (None, False)
    if state.get("turn") != row["turn_key"]:
        state = {"turn": row["turn_key"], "words": 0, "fired": 0}
    total = state["words"] + row["words"]
    fires = total >= (state["fired"] + math.ceil(budget / 4) if state["fired"] else budget + 1)
    return {"turn": row["turn_key"], "words": total, "fired": total if fires else state["fired"]}, (total, fires)


def pressure_hysteresis(calls: DataFrame) -> DataFrame:
    return fold(calls, lambda: None, step_band, StructType().add("band", "string"), ("bytes", "reset"))


def repeated_calls(calls: DataFrame) -> DataFrame:
    return fold(calls, OrderedDict, step_handled, StructType().add("repeated", "boolean"), ("call_id", "hash", "reset"))


def narration_meter(turns: DataFrame) -> DataFrame:
    return fold(turns, dict, step_narration, StructType().add("total", "long").add("exceeded", "boolean"), ("profile", "words", "blocker", "turn_key", "reset"))
