"""Sources and sinks: hook events, transcripts, metrics, saved outputs. Schemas are explicit; bad rows drop out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import scalars as S
from ..operators import textops

HOOK_EVENT = (
    "session_id string, transcript_path string, tool_name string, call_id string, "
    "tool_input struct<command:string,file_path:string,offset:bigint,limit:bigint>, "
    "tool_response struct<stdout:string,stderr:string,output:string,interrupted:boolean,exitCode:int,exit_code:int,code:int,"
    "file:struct<filePath:string,content:string>,content:array<struct<type:string,text:string>>>, tool_output string, _corrupt_record string"
)
TRANSCRIPT = "type string, isMeta boolean, isSidechain boolean, origin struct<kind:string>, message struct<role:string,content:string>, _corrupt_record string"
METRICS = (
    "ts string, tag string, strategy string, changed boolean, lossy boolean, inBytes bigint, outBytes bigint, inLines bigint, outLines bigint, omittedLines bigint, "
    "errors bigint, warnings bigint, sidecar boolean, hostTruncated boolean, runtime string, profile string, inTokEst bigint, outTokEst bigint, tokenClass string, "
    "estimator string, cmdWord string, cmdHash string, bypass boolean, applied boolean, durMs double, verbatim boolean, dupExact boolean, dupAgeMs bigint, "
    "narrationWords bigint, narrationExceeded boolean, recovery struct<candidate:boolean,kind:string,precedingMarkerKind:string,precedingLossy:boolean,"
    "precedingApplied:boolean,ageMs:bigint,seqGap:bigint>, mcp struct<mode:string,blocks:bigint,wouldInBytes:bigint,wouldOutBytes:bigint,lossy:boolean,strategies:array<string>>, _corrupt_record string"
)


#: Bytes a core below which dealing rows anew costs less than cores that wait for one file's only row group.
SPREAD_BYTES = 64 * 1024 * 1024


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores before work that is bound by CPU, if the input is small for the cluster; larger inputs
    have row groups enough and stay where they are."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < SPREAD_BYTES * cores else rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select(*rows.columns).where("_corrupt_record IS NULL").drop("_corrupt_record")


def shell_hook_events(spark: SparkSession, path: str) -> DataFrame:
    """A row for each field of a shell result, or for a read's content; malformed events drop out."""
    rows = _json(spark, path, HOOK_EVENT)
    r = F.col("tool_response")
    fields = F.array(F.struct(F.lit("stdout").alias("field"), r["stdout"].alias("text")), F.struct(F.lit("stderr").alias("field"), r["stderr"].alias("text")), F.struct(F.lit("content").alias("field"), r["file"]["content"].alias("text")))
    code = F.coalesce(r["exitCode"], r["exit_code"], r["code"], F.when(r["interrupted"], 1))
    return rows.select("session_id", "call_id", "tool_name", "tool_input.*", code.alias("exit_code"), F.explode(F.filter(fields, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("x")).select("*", "x.*").drop("x")


def joined_hook_events(spark: SparkSession, path: str) -> DataFrame:
    """One text an event: stdout, stderr and output where they are not empty, else the plain output."""
    rows = _json(spark, path, HOOK_EVENT)
    r = F.col("tool_response")
    parts = F.filter(F.array(r["stdout"], r["stderr"], r["output"]), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.col("tool_output"))
    return rows.select("session_id", "call_id", "tool_input.command", text.alias("text"))


def block_events(spark: SparkSession, path: str) -> DataFrame:
    """A row a content block, in order."""
    rows = _json(spark, path, HOOK_EVENT)
    return rows.select("session_id", "call_id", "tool_name", F.posexplode("tool_response.content").alias("block", "x")).select("session_id", "call_id", "tool_name", "block", "x.type", "x.text")


def content_text(blocks: Column) -> Column:
    """Text blocks of a message, joined by line ends; null without any."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def transcript(spark: SparkSession, path: str, tail_bytes: int | None = C.TAIL_BYTES) -> DataFrame:
    """Lines of a transcript by file, newest ``tail_bytes`` of each: ``path, pos, line`` and the parsed fields.

    Positions come from whole files, as readers of lines keep no order. A line that the limit cuts drops out.
    """
    files = whole_texts(spark, path)
    rows = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    if tail_bytes is not None:
        size = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy(F.desc("pos"))) - 1
        rows = rows.withColumn("after", size).where(F.col("after") <= tail_bytes).drop("after")
    rows = rows.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    get = lambda p, t: F.try_variant_get("v", p, t)
    return rows.select("path", "pos", "line", get("$.type", "string").alias("type"), get("$.isMeta", "boolean").alias("is_meta"), get("$.isSidechain", "boolean").alias("is_sidechain"), get("$.origin.kind", "string").alias("origin"), F.to_json(get("$.message.content", "variant")).alias("content"))


def is_user_prompt(rows: DataFrame) -> Column:
    """A prompt of a person: a plain text, or text blocks without tool results."""
    person = (F.col("type") == "user") & ~F.coalesce("is_meta", F.lit(False)) & ~F.coalesce("is_sidechain", F.lit(False)) & F.coalesce(F.col("origin") == "human", F.lit(True))
    blocks = F.from_json("content", "array<struct<type:string,text:string>>")
    typed = F.exists(blocks, lambda b: b["type"] == "text") & ~F.exists(blocks, lambda b: b["type"] == "tool_result")
    return person & F.coalesce(F.col("content").startswith('"') | typed, F.lit(False))


def last_prompt(rows: DataFrame) -> DataFrame:
    """``path, prompt``: the newest prompt's text; empty without one."""
    blocks = F.from_json("content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("content").startswith('"'), F.get_json_object(F.concat(F.lit('{"t":'), F.col("content"), F.lit("}")), "$.t")).otherwise(content_text(blocks))
    own = rows.withColumn("own", is_user_prompt(rows)).withColumn("text", text)
    return own.groupBy("path").agg(F.coalesce(F.max_by(F.when(F.col("own"), F.col("text")), F.when(F.col("own"), F.col("pos"))), F.lit("")).alias("prompt"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics records; blank and malformed lines drop out; ``ts_ms`` in milliseconds."""
    rows = _json(spark, path, METRICS)
    return rows.withColumn("ts_ms", F.unix_millis(F.try_to_timestamp("ts")))


def append_metrics(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def append_log(done: DataFrame, path: str) -> None:
    """Append a line a call: tag, bytes in and out."""
    done.select(F.format_string("%s %d -> %d", "tag", "inBytes", "outBytes").alias("value")).write.mode("append").text(path)


def record(done: DataFrame, metrics_path: str | None = None, log_path: str | None = None) -> bool:
    """Metrics records to the sinks that are configured; without any, nothing is computed. Says whether there was one."""
    if metrics_path:
        append_metrics(done, metrics_path)
    if log_path:
        append_log(done, log_path)
    return bool(metrics_path or log_path)


def positive_int(value: str | int | None, default: int) -> int:
    """A setting's leading whole number if it is above 0, else the default."""
    found = re.match(r"\s*[+-]?[0-9]+", str(value))
    return int(found[0]) if found and int(found[0]) > 0 else default


def write_sidecars(done: DataFrame, path: str) -> int:
    """Save what condensing moved out, once a name; returns how many were new. Runs again without effect.

    A saved output is a row: name, content, and its facts (schema 2): among them the errors and warnings it holds, the
    census that a digest showed, and the session, if ``done`` has ``session_id``.
    """
    spark = done.sparkSession
    session = F.col("session_id").cast("string") if "session_id" in done.columns else F.lit(None).cast("string")
    new = done.where("sidecar IS NOT NULL").select(
        F.element_at(F.split("sidecarPath", "/"), -1).alias("name"),
        F.col("sidecar").alias("content"),
        F.lit(2).alias("schema"),
        F.when(F.col("hostComplete"), "complete-cleaned").otherwise("host-truncated").alias("kind"),
        "runtime",
        F.size(F.split("sidecar", "\n", -1)).cast("long").alias("total_lines"),
        F.octet_length("sidecar").cast("long").alias("bytes"),
        "hostComplete",
        S.sha256_name(F.col("sidecar")).alias("content_hash"),
        (F.col("strategy") == "sidecar").alias("digested"),
        session.alias("session_id"),
        F.current_timestamp().alias("created_at"),
    ).dropDuplicates(["name"])
    known = _saved(spark, path)
    if known is not None:
        new = new.join(known.select("name"), "name", "left_anti")
    n = new.count()
    if n:
        _with_signals(new).write.mode("append").parquet(path)
    return n


def _with_signals(saved: DataFrame) -> DataFrame:
    """``errors, warnings, census`` of each content in one pass where it lies, in place of ``digested``."""
    fields = [f.simpleString().replace(":", " ", 1) for f in saved.drop("digested").schema]

    def run(batches):
        for batch in batches:
            texts = [t.split("\n") for t in batch.column("content").to_pylist()]
            signals = [[line for line in lines if textops.is_signal(line)] for lines in texts]
            plain = [textops.census(line for line in own if C.MARK not in line) for own in signals]
            words = [textops.census_words(textops.census(own)) if d else "" for own, d in zip(signals, batch.column("digested").to_pylist())]
            made = {"errors": pa.array([sum(n[:3]) for n in plain], pa.int64()), "warnings": pa.array([sum(n[3:]) for n in plain], pa.int64()), "census": pa.array(words, pa.string())}
            rest = batch.drop_columns(["digested"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *made.values()], names=[*rest.schema.names, *made])

    return saved.mapInArrow(run, ", ".join([*fields, "errors long", "warnings long", "census string"]))


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


#: Facts of a saved output in schema 2: name, path in its JSON, type, and what schema 1 stands for.
FACTS = (
    ("total_lines", "$.totalLinesObserved", "bigint", "$.totalLines"), ("bytes", "$.bytesObserved", "bigint", "$.bytes"), ("kind", "$.content", "string", "complete-cleaned"),
    ("runtime", "$.runtime", "string", "unknown"), ("host_complete", "$.hostComplete", "boolean", True), ("errors", "$.diagnostics.errors", "bigint", 0),
    ("warnings", "$.diagnostics.warnings", "bigint", 0), ("content_hash", "$.contentHash", "string", None), ("census", "$.census", "string", "$.census"),
    ("session_id", "$.sessionId", "string", "$.sessionId"), ("created_at", "$.createdAt", "string", "$.createdAt"),
)


def sidecar_meta(rows: DataFrame) -> DataFrame:
    """``facts`` of saved outputs from their JSON: schema 2 as it is, schema 1 in the same form, others null.

    A schema is a number, or a name that ends in ``sidecar-meta/`` and the number. An absent census of schema 1 is empty.
    """
    v = F.try_parse_json("meta")
    get = lambda p, t: F.try_variant_get(v, p, t)
    version = F.regexp_extract(F.coalesce(get("$.schema", "string"), F.lit("")), "^(?:[a-z-]+/sidecar-meta/)?([0-9]+)$", 1)
    first = lambda old, t: get(old, t) if str(old).startswith("$.") else F.lit(old).cast(t)
    made = [F.when(version == "2", get(new, t)).otherwise(F.coalesce(first(old, t), F.lit("")) if name == "census" else first(old, t)).alias(name) for name, new, t, old in FACTS]
    return rows.withColumn("facts", F.when(version.isin("1", "2"), F.struct(F.lit(2).alias("schema"), *made)))


def expired(saved: DataFrame, now: Column, hours: int | str | None = None, most: int = C.SWEEP_MAX) -> DataFrame:
    """Saved outputs to sweep: the oldest that are past their time, a bounded number a sweep. ``hours``: a setting; 72 by default."""
    hours = positive_int(hours, C.TTL_HOURS)
    return saved.where(F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS")).orderBy("created_at", "name").limit(most)


def hook_response(done: DataFrame) -> DataFrame:
    """``value``: a JSON answer for each applied rewrite."""
    body = F.to_json(F.struct(F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("emitted").alias("updatedToolOutput")).alias("hookSpecificOutput")))
    return done.where("applied AND emitted IS NOT NULL").select(body.alias("value"))
