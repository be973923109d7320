"""What each host runtime does with a call: route it, condense its blocks, gate them together, patch the result.

A call is a row, its result an array of blocks. Routing is an expression, session state comes from the session
operators, condensing and a call's totals are one Arrow pass over the calls, and the gate and the patch are expressions.
Blocks that are no text keep their place and their content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions import text as X
from . import condense as K
from . import sessions

BLOCK = "array<struct<type:string,text:string>>"
#: Columns that a call may bring; those missing count as null.
CALL = {
    "session": "string", "seq": "bigint", "call_id": "string", "tool": "string", "command": "string", "path": "string", "offset": "bigint", "limit": "bigint", "exit_code": "int",
    "is_error": "boolean", "truncated": "boolean", "full_path": "string", "prompt": "string", "profile": "string", "context_bytes": "bigint", "at": "bigint", "reset": "string", "blocks": BLOCK,
}


@dataclass(frozen=True)
class Runtime:
    """A host: which facts it gives about a result, and which state it keeps.

    ``host``: how completeness is told ("shell": by size and marks; "typed": by flags too; None: unknown). ``reads``:
    file reads are admitted by path. ``pressure``: "context" bytes are given, or "observed" ones are added up; None:
    no scale. ``repeats``: a call seen again with the same content is left alone. ``prompts``: the prompt decides on
    enumeration and terms. ``joined``: a result is one text.
    """

    name: str
    host: str | None = None
    reads: bool = False
    pressure: str | None = None
    repeats: bool = False
    prompts: bool = False
    joined: bool = False


RUNTIMES = {r.name: r for r in (Runtime("claude", "shell", True, "context", prompts=True), Runtime("pi", "typed", True, "observed", repeats=True), Runtime("opencode"), Runtime("codex", joined=True))}


@dataclass(frozen=True)
class Observed:
    """Calls of other servers' tools: ``mode`` off, observe or on; only tools that ``allow`` names and ``deny`` does not
    are ever rewritten."""

    mode: str = "observe"
    allow: str | None = None
    deny: str | None = None
    tools: str = "^mcp__"


def positive(value: str | None, default: int) -> int:
    """A setting's whole number over 0 as far as its text begins with one; else the default."""
    found = re.match(rf"[{C.WS}]*\+?([0-9]+)", value or "")
    return int(found[1]) if found and int(found[1]) > 0 else default


def telemetry(settings: dict) -> bool:
    """Whether any sink of records is configured."""
    return any(settings.get(k) for k in ("log", "metrics", "stats"))


def with_columns(calls: DataFrame) -> DataFrame:
    """``calls`` with every column of CALL."""
    return calls.withColumns({n: F.col(n).cast(t) if n in calls.columns else F.lit(None).cast(t) for n, t in CALL.items()})


def texts_of(blocks: Column) -> Column:
    """The texts of a result, in order."""
    return F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])


def whole_text(blocks: Column) -> Column:
    """The result's text blocks as one text; null without any."""
    texts = texts_of(blocks)
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def route(runtime: Runtime, mcp: Observed | None = None, folder: str = K.SIDECARS) -> Column:
    """Where a call goes: reset, bypass, skip, verbatim, observe, repeated (where the column says so) or condense."""
    raw = whole_text(F.col("blocks"))
    read = F.lower(F.col("tool")) == "read"
    admitted = K.admitted_read(F.col("path"), folder)
    way = F.when(F.col("reset").isNotNull(), "reset").when(X.is_bypass(F.col("command")), "bypass").when(raw.isNull(), "skip")
    if runtime.repeats:
        way = way.when(F.col("repeated"), "repeated")
    way = way.when(read & ~admitted, "skip") if runtime.reads else way.when(read, "skip")
    way = way.when(read & X.is_exact_range(F.col("path"), folder, F.col("offset"), F.col("limit"), raw), "verbatim")
    if mcp is not None:
        other = F.col("tool").rlike(mcp.tools)
        applies = F.lit(mcp.mode == "on" and mcp.allow is not None) & (F.col("tool").rlike(mcp.allow) if mcp.allow else F.lit(False))
        way = way.when(other & F.lit(mcp.mode == "off"), "skip").when(other & ~applies, "observe")
    return way.otherwise("condense")


def scaled(calls: DataFrame, runtime: Runtime) -> DataFrame:
    """``band`` and ``scale`` by the session's pressure, with its resets."""
    if runtime.pressure is None:
        return calls.withColumns({"band": F.lit("low"), "scale": F.lit(1.0)})
    size = F.col("context_bytes")
    if runtime.pressure == "observed":
        own = sessions.islands(calls, F.col("reset").isNotNull(), "__island")
        counted = F.when(F.col("__seen"), F.coalesce(F.octet_length(whole_text(F.col("blocks"))), F.lit(0))).otherwise(F.lit(0))
        seen = ~F.coalesce(X.is_bypass(F.col("command")), F.lit(False)) & ~F.col("repeated") & ((F.lower(F.col("tool")) != "read") | K.admitted_read(F.col("path")))
        own = own.withColumn("__seen", F.coalesce(seen, F.lit(False))).withColumn("__own", counted.cast("long"))
        calls = sessions.observed_bytes(own.withColumnRenamed("__island", "island"), "__own").drop("island", "__seen", "__own", "turn")
        size = F.coalesce(size, F.col("observed"))
    out = sessions.pressure_hysteresis(calls.withColumn("bytes", F.when(F.col("reset").isNull(), size)))
    return out.withColumn("scale", S.pressure_scale(F.col("band"))).drop("bytes", "observed")


def handle(calls: DataFrame, runtime: Runtime, mcp: Observed | None = None, folder: str = K.SIDECARS) -> DataFrame:
    """A row a call: ``session, seq, call_id, route, band, repeated, duplicate, note``, the result's ``blocks`` as the host
    gets them, ``applied``, and the totals ``in_bytes, out_bytes, in_tokens, out_tokens, strategy, lossy, sidecars``.

    Totals are of what was condensed or observed; a rewrite that the gate refuses counts its input as its output.
    ``strategy`` is the largest block's. Calls without blocks have null totals. Rows of resets stay.
    """
    rows = with_columns(calls)
    rows = rows.withColumn("hash", F.when(~F.coalesce(X.is_bypass(F.col("command")), F.lit(False)), F.sha2(whole_text(F.col("blocks")), 256)))
    if runtime.repeats:
        rows = sessions.repeated_calls(rows)
    else:
        rows = rows.withColumn("repeated", F.lit(False))
    rows = scaled(rows, runtime).withColumn("route", route(runtime, mcp, folder))
    read = F.lower(F.col("tool")) == "read"
    own_text = F.col("blocks") if not runtime.joined else F.when(whole_text(F.col("blocks")).isNotNull(), F.array(F.struct(F.lit("text").alias("type"), whole_text(F.col("blocks")).alias("text"))))
    rows = rows.withColumn("blocks", own_text)

    def asked(b):
        own = (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")
        if mcp is not None:
            denied = F.col("tool").rlike(mcp.deny) if mcp.deny else F.lit(False)
            own &= ~F.col("tool").rlike(mcp.tools) | ~(denied | X.already_condensed(b["text"]))
        return own

    def complete(text):
        return {"shell": lambda: X.host_complete_shell(text, read), "typed": lambda: X.host_complete_details(text, F.col("truncated"), F.col("full_path")), None: lambda: F.lit(None).cast("boolean")}[runtime.host]()

    block = lambda b, k: F.struct(k.cast("int").alias("block"), asked(b).alias("asked"), complete(b["text"]).alias("host_complete"))
    work = F.when(F.col("route").isin("condense", "observe"), F.filter(F.transform("blocks", block), lambda x: x["asked"]))
    prompt = F.col("prompt") if runtime.prompts else F.lit(None).cast("string")
    is_read = F.coalesce(read, F.lit(False))
    known = {
        "exit_code": F.when(F.coalesce("is_error", F.lit(False)), 1).otherwise(F.col("exit_code")), "is_dump": is_read | X.is_file_dump(F.col("command")), "enumerate": X.requests_enumeration(prompt),
        "no_sidecar": is_read & X.is_sidecar_path(F.col("path"), folder), "host_may_truncate": ~is_read, "profile": F.col("profile"), "command": F.col("command"), "session_id": F.col("session"),
        "scale": F.col("scale"), "tokens": S.prompt_tokens(prompt),
    }
    carried = ["session", "seq", "call_id", "at", "reset", "hash", "route", "band", "repeated", "blocks"]
    options = [f"k_{n}" for n in known]
    out = rows.select(*carried, work.alias("__work"), *(c.alias(f"k_{n}") for n, c in known.items()))
    out = K.condense_calls(out, F.col("__work"), {n: F.col(k) for n, k in zip(known, options)}, folder).drop("__work", *options)
    # windows that only some columns need come last, so a plan without these columns has no such window
    seen = F.col("route").isin("condense", "verbatim", "observe")  # only these calls enter the ring of the last hashes
    out = sessions.exact_duplicates(sessions.islands(out, F.col("reset").isNotNull()), among=seen)
    win = S.net_win(F.col("in_bytes"), F.col("would_bytes"), F.col("in_tokens"), F.col("would_tokens"))
    out = out.withColumn("applied", F.coalesce((F.col("route") == "condense") & F.col("differs") & win, F.lit(False)))
    patched = F.transform("blocks", lambda b, k: F.struct(b["type"].alias("type"), F.coalesce(F.try_element_at(F.map_from_entries("outs"), k), b["text"]).alias("text")))
    out = out.withColumn("blocks", F.when(F.col("applied"), patched).otherwise(F.col("blocks")))
    kept = lambda would, given: F.when(F.col("applied"), F.col(would)).otherwise(F.col(given))
    out = out.withColumns({"out_bytes": kept("would_bytes", "in_bytes"), "out_tokens": kept("would_tokens", "in_tokens"), "sidecars": F.when(F.col("applied"), F.col("sidecars")).when(F.col("sidecars").isNotNull(), 0)})
    out = sessions.note_once(out, F.col("applied") & F.coalesce(whole_text(F.col("blocks")), F.lit("")).contains("[trim"))
    return out.select("session", "seq", "call_id", "route", "band", "repeated", "duplicate", "note", "blocks", "applied", "in_bytes", "out_bytes", "would_bytes", "in_tokens", "out_tokens", "strategy", "lossy", "sidecars")


def records(handled: DataFrame, runtime: Runtime) -> DataFrame:
    """What goes to the metrics log: repeated, skipped and reset calls leave no record, a bypass a bare one, a verbatim
    read its bytes alone, an observed call what a rewrite would have given."""
    size = F.octet_length(F.coalesce(whole_text(F.col("blocks")), F.lit(""))).cast("long")
    bare = F.col("route") == "verbatim"
    seen = F.col("route") == "observe"
    return handled.where(F.col("route").isin("bypass", "verbatim", "observe", "condense")).select(
        "session", "seq", F.lit(runtime.name).alias("tag"), (F.col("route") == "bypass").alias("bypass"), bare.alias("verbatim"), F.when(~seen, F.col("strategy")).alias("strategy"),
        F.when(bare, size).when(~seen, F.col("in_bytes")).alias("in_bytes"), F.when(bare, size).when(~seen, F.col("out_bytes")).alias("out_bytes"),
        F.when(seen, F.col("in_bytes")).alias("would_in_bytes"), F.when(seen, F.col("would_bytes")).alias("would_out_bytes"), "applied", "duplicate",
    )


#: A session's state as a host keeps it, field by field, with what stands for a missing or corrupt value.
STATE = {"pressureBand": ("string", "low"), "observedBytes": ("bigint", 0), "compactionEpoch": ("bigint", 0), "profile": ("string", None), "orderMarkers": ("bigint", 0), "turnCounter": ("bigint", 0)}
_KINDS = {"string": "^STRING", "bigint": "^BIGINT"}


def state_of(value: Column) -> Column:
    """State from its JSON: each field with its own type or its default; a profile only if it is known."""
    v = F.try_parse_json(value)

    def read(name, kind, default):
        own = F.try_variant_get(v, f"$.{name}", "variant")
        typed = F.when(F.schema_of_variant(own).rlike(_KINDS[kind]), F.try_variant_get(v, f"$.{name}", kind))
        if name == "profile":
            typed = F.when(typed.isin(*C.PROFILES), typed)
        return F.coalesce(typed, F.lit(default).cast(kind)).alias(name)

    return F.struct(*(read(n, k, d) for n, (k, d) in STATE.items()))
