"""The composite: condensed views of tool results, gates over their blocks, and metrics records.

A result is condensed where it lies: one Arrow pass, no shuffle, whatever its format. Blocks of a call are judged
together by one window over the call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import scalars as S
from ..functions import text as X
from . import formats, textops

#: The result contract, field by field.
META = StructType(
    [
        StructField(name, kind)
        for name, kind in (
            ("changed", BooleanType()), ("strategy", StringType()), ("inputBytes", LongType()), ("outputBytes", LongType()), ("inputLines", LongType()),
            ("outputLines", LongType()), ("lossy", BooleanType()), ("preservedErrors", LongType()), ("preservedWarnings", LongType()), ("omittedLines", LongType()),
            ("sidecarPath", StringType()), ("hostComplete", BooleanType()), ("runtime", StringType()), ("profile", StringType()), ("reason", StringType()),
            ("inputTokenEstimate", LongType()), ("outputTokenEstimate", LongType()), ("tokenClass", StringType()), ("estimator", StringType()),
        )
    ]
)
#: Columns that a result may bring; those missing count as null.
OPTIONS = {
    "exit_code": IntegerType(), "is_dump": BooleanType(), "enumerate": BooleanType(), "no_sidecar": BooleanType(), "host_complete": BooleanType(), "host_may_truncate": BooleanType(),
    "profile": StringType(), "task_phase": StringType(), "command": StringType(), "session_id": StringType(), "runtime": StringType(), "scale": DoubleType(), "tokens": ArrayType(StringType()),
}
SIDECARS = "/tmp/trim-sidecar"


#: Bytes of a batch that a worker turns into rows at a time: what it holds does not grow with the batch.
SLICE_BYTES = 1 << 22


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch as slices of about SLICE_BYTES of ``column`` (texts, or lists that hold some); a row is never cut."""
    if not batch.num_rows:
        return
    rows = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.column(column).nbytes))
    own = batch.column(column)
    if pa.types.is_string(own.type) or pa.types.is_large_string(own.type):
        place = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        ends = [*(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    else:
        ends = [*range(rows, batch.num_rows, rows), batch.num_rows]
    for start, end in zip([0, *ends], ends):
        yield batch.slice(start, end - start)


def condense(results: DataFrame, keys: list[str], text: str = "text", folder: str = SIDECARS, registry: tuple = formats.REGISTRY, keep: str | None = None, keep_last: str | None = None) -> DataFrame:
    """``keys``, ``out``, the fields of META, and ``sidecar``: what a saved copy holds. Null and empty texts pass as they are.

    ``keep``: a pattern in place of the vocabulary of lines to keep; ``keep_last``: one for more lines that stay last.
    """
    given = [F.col(n).cast(t).alias(f"o_{n}") if n in results.columns else F.lit(None).cast(t).alias(f"o_{n}") for n, t in OPTIONS.items()]
    narrow = results.select(*keys, F.col(text).alias("__text"), *given)
    schema = StructType([*(results.schema[k] for k in keys), StructField("out", StringType()), *META.fields, StructField("sidecar", StringType())])
    names, n_keys = list(OPTIONS), len(keys)
    facts = [f.name for f in META.fields]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.dataType.typeName()] for f in META.fields]

    def first_match(s, o):
        return formats.first_match(s, o, registry)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, n_keys)):
            found = []
            columns = [batch.column(n_keys + 1 + k).to_pylist() for k in range(len(names))]
            for k, text in enumerate(batch.column(n_keys).to_pylist()):
                o = {n: c[k] for n, c in zip(names, columns) if c[k] is not None}
                found.append(textops.condense(text, textops.Options(**o, keep=keep, keep_last=keep_last), folder, first_match))
            own = [batch.column(k) for k in range(n_keys)]
            made = [pa.array([r.get(n) for r in found], t) for n, t in zip(["out", *facts, "sidecar"], [pa.string(), *types, pa.string()])]
            yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return narrow.mapInArrow(run, schema)


#: What condensing the blocks of a call gives: totals, the largest block's strategy, and the blocks that changed.
TOTALS = StructType(
    [
        StructField(n, t)
        for n, t in (
            ("in_bytes", LongType()), ("would_bytes", LongType()), ("in_tokens", LongType()), ("would_tokens", LongType()), ("strategy", StringType()), ("lossy", BooleanType()),
            ("sidecars", LongType()), ("differs", BooleanType()), ("outs", ArrayType(StructType([StructField("block", IntegerType()), StructField("out", StringType())]))),
        )
    ]
)
_TOTALS = [*[pa.int64()] * 4, pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("block", pa.int32()), ("out", pa.string())]))]
#: Characters of texts whose views a worker remembers.
MEMO_CHARS = 1 << 24
#: UTF-16 units below which no profile saves a copy, so no view names the session.
LEAST_DIGEST = min(caps[2] for caps in (C.DEFAULT_CAPS, *C.PROFILES.values()))


def condense_calls(calls: DataFrame, asked: Column, options: dict[str, Column], folder: str = SIDECARS) -> DataFrame:
    """``calls`` with the fields of TOTALS, null for calls without a block to condense: one pass where the calls lie.

    ``asked``: the blocks to condense, as structs of ``block`` (its place in ``blocks``) and ``host_complete``. A worker
    condenses equal texts about which the same is known once; what a view may name (the session) counts as known.
    """
    given = {n: c.cast(OPTIONS[n]) for n, c in options.items()}
    rows = calls.select("*", asked.alias("__asked"), *(c.alias(f"o_{n}") for n, c in given.items()))
    schema, width, names = StructType([*calls.schema.fields, *TOTALS.fields]), len(calls.columns), list(given)
    at = calls.columns.index("blocks")

    def view(text, known, complete, memo):
        o = {n: v for n, v in known.items() if v is not None}
        key = (text, complete, *(tuple(v) if isinstance(v, list) else v for n, v in o.items() if n != "session_id" or 2 * len(text) >= LEAST_DIGEST), *o)
        found = memo.get(key)
        if found is None:
            r = textops.condense(text, textops.Options(**o, host_complete=complete), folder, formats.first_match)
            found = (*(r[n] for n in ("inputBytes", "outputBytes", "inputTokenEstimate", "outputTokenEstimate", "strategy", "lossy")), r["sidecarPath"] is not None, r["changed"], r["out"])
            memo.kept += len(text) + len(r["out"])
            if memo.kept > MEMO_CHARS:
                memo.clear()
                memo.kept = 0
            memo[key] = found
        return found

    def call(texts, asked, known, memo):
        if not asked:
            return (None,) * len(_TOTALS)
        done = [(a["block"], view(texts[a["block"]], known, a["host_complete"], memo)) for a in asked]
        totals = [sum(v[k] for _, v in done) for k in range(4)]
        largest = max(done, key=lambda x: (x[1][0], -x[0]))[1]
        return (*totals, largest[4], any(v[5] for _, v in done), sum(v[6] for _, v in done), any(v[7] for _, v in done), [{"block": b, "out": v[8]} for b, v in done if v[7]])

    def run(batches):
        memo = Memo()
        for whole in batches:
            for batch in slices(whole, at):
                texts = [b and [x and x["text"] for x in b] for b in batch.column(at).to_pylist()]
                known = zip(*(batch.column(width + 1 + k).to_pylist() for k in range(len(names))))
                made = [call(t, a, dict(zip(names, o)), memo) for t, a, o in zip(texts, batch.column(width).to_pylist(), known)]
                new = [pa.array([m[k] for m in made], t) for k, t in enumerate(_TOTALS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=schema.names)

    return rows.mapInArrow(run, schema)


class Memo(dict):
    """Views of texts by what is known about them; ``kept``: their characters."""

    kept = 0


def fold_templates(docs: DataFrame) -> DataFrame:
    """``doc_id, text, collapsed``: runs of lines of one shape as their first line and a count."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [textops.fold_templates(t.split("\n")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(x) for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "text", "collapsed"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, text string, collapsed long")


def read_format(docs: DataFrame, reader: formats.Reader) -> DataFrame:
    """``doc_id, out, lossy, omitted`` where one format alone reads the text; no rows where it declines."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for key, text, command in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = formats.first_match(text or "", textops.Options(command=command), (reader,))
                if found:
                    rows.append((key, found[1], found[2], found[3]))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.bool_(), pa.int64()))], names=["doc_id", "out", "lossy", "omitted"])

    command = F.col("command") if "command" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", command.cast("string")).mapInArrow(run, "doc_id long, out string, lossy boolean, omitted long")


def gate(done: DataFrame, call: list[str]) -> DataFrame:
    """``applied`` for each block: all blocks of a call together must save bytes and tokens."""
    own = Window.partitionBy(*call)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(own)
    win = S.net_win(total("inputBytes"), total("outputBytes"), total("inputTokenEstimate"), total("outputTokenEstimate"))
    return done.withColumn("applied", win).withColumn("emitted", F.when(F.col("applied"), F.col("out")))


def block_eligible(kind: Column, text: Column, allow: str, deny: str, tool: Column) -> Column:
    """Text blocks of allowed tools that nobody has condensed; a denial wins."""
    return F.coalesce((kind == "text") & text.isNotNull() & ~X.already_condensed(text) & tool.rlike(allow) & ~tool.rlike(deny), F.lit(False))


def admitted_read(path: Column, folder: str = SIDECARS) -> Column:
    """File reads that may be condensed: logs, generated files, saved outputs."""
    return X.is_log_path(path) | X.is_generated_path(path) | X.is_sidecar_path(path, folder)


def metrics_records(done: DataFrame, ts_ms: Column, tag: Column, command: Column) -> DataFrame:
    """One record a call; figures of a rewrite that was not applied fall back to the input's."""
    applied = F.coalesce(F.col("applied"), F.lit(True))
    kept = lambda c, other: F.when(applied, F.col(c)).otherwise(other)
    no = F.lit(False)
    return done.select(
        ts_ms.alias("ts_ms"), tag.alias("tag"), "strategy",
        kept("changed", no).alias("changed"), kept("lossy", no).alias("lossy"), F.col("inputBytes").alias("inBytes"), kept("outputBytes", F.col("inputBytes")).alias("outBytes"),
        F.col("inputLines").alias("inLines"), kept("outputLines", F.col("inputLines")).alias("outLines"), kept("omittedLines", F.lit(0)).alias("omittedLines"),
        F.col("preservedErrors").alias("errors"), F.col("preservedWarnings").alias("warnings"), kept("sidecarPath", F.lit(None)).isNotNull().alias("sidecar"), (~F.col("hostComplete")).alias("hostTruncated"),
        "runtime", "profile", F.col("inputTokenEstimate").alias("inTokEst"), kept("outputTokenEstimate", F.col("inputTokenEstimate")).alias("outTokEst"), "tokenClass", "estimator",
        S.command_word(command).alias("cmdWord"), S.fnv1a(command).alias("cmdHash"), X.is_bypass(command).alias("bypass"), applied.alias("applied"),
    )


def profile_caps(results: DataFrame, profile: Column, overrides: dict | None = None) -> DataFrame:
    """``profile, cap_pass, cap_fail, sidecar_min`` by a join with the profiles; overrides come first, defaults last."""
    spark = results.sparkSession
    rows = [(name, *caps) for name, caps in C.PROFILES.items()]
    dim = spark.createDataFrame(rows, "known string, p long, f long, s long")
    out = results.withColumn("__profile", profile).join(F.broadcast(dim), F.col("__profile") == F.col("known"), "left")  # as many rows as profiles
    own = overrides or {}
    pick = lambda name, c, k: F.coalesce(F.lit(own.get(name)).cast("long"), F.col(c), F.lit(C.DEFAULT_CAPS[k]).cast("long")).alias(name)
    return out.select(*results.columns, F.col("known").alias("profile"), pick("cap_pass", "p", 0), pick("cap_fail", "f", 1), pick("sidecar_min", "s", 2))
