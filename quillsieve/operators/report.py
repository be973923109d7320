"""The report over metrics records (``pos, ts_ms, tag, strategy, changed, lossy, inBytes, outBytes, ...``)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C


def _has_tokens():
    return F.col("inTokEst").isNotNull() & F.col("outTokEst").isNotNull()


def _flag(name: str):
    return F.coalesce(F.col(name), F.lit(False))


def with_tokens(records: DataFrame) -> DataFrame:
    """Token figures of a record, a quarter of its bytes where it has none."""
    quarter = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / 4 + 0.5).cast("long")
    return records.withColumns(
        {
            "in_tok": F.when(_has_tokens(), F.col("inTokEst")).otherwise(quarter("inBytes")),
            "out_tok": F.when(_has_tokens(), F.col("outTokEst")).otherwise(quarter("outBytes")),
            "cls": F.when(_has_tokens(), F.coalesce("tokenClass", F.lit("mixed"))),
            "by_class": F.when(_has_tokens(), F.coalesce("estimator", F.lit(C.ESTIMATOR)) == C.ESTIMATOR).otherwise(False),
        }
    )


def processed(records: DataFrame) -> DataFrame:
    return records.where(~_flag("bypass"))


def summary(records: DataFrame) -> DataFrame:
    """One row of headline figures."""
    live = ~_flag("bypass")
    rows = with_tokens(records)
    total = lambda c: F.coalesce(F.sum(F.when(live, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    some = lambda c: F.count_if(live & F.coalesce(c, F.lit(False)))
    ratio = F.round(total("outBytes") / F.when(total("inBytes") != 0, total("inBytes")), 3)
    return rows.agg(
        F.count_if(live).alias("calls_processed"),
        some(F.col("changed")).alias("calls_changed"),
        F.count_if(~live).alias("bypasses"),
        total("inBytes").alias("input_bytes"),
        total("outBytes").alias("output_bytes"),
        (total("inBytes") - total("outBytes")).alias("bytes_saved"),
        ratio.alias("ratio"),
        (total("in_tok") - total("out_tok")).alias("tokens_saved"),
        F.when(F.coalesce(F.bool_or(live & F.col("by_class")), F.lit(False)), C.ESTIMATOR).otherwise("bytes/4").alias("estimator"),
        some(F.col("lossy")).alias("lossy"),
        some(F.col("changed") & ~_flag("lossy")).alias("lossless"),
        some(F.col("sidecar")).alias("sidecars"),
        some(F.col("strategy").isNotNull() & (F.col("strategy") != "generic")).alias("detections"),
        some(F.col("dupExact")).alias("exact_duplicates"),
    )


def class_mix(records: DataFrame) -> DataFrame:
    return with_tokens(processed(records)).where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"))


def grouped(records: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``key, calls, in_bytes, out_bytes, saved``, most bytes saved first, ties by first record; ``most``: a top-k report."""
    name = F.when(F.coalesce(F.col(key), F.lit("")) == "", "(none)").otherwise(F.col(key))
    zero = F.lit(0)
    rows = processed(records).groupBy(name.alias("key")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("inBytes", zero)).alias("in_bytes"), F.sum(F.coalesce("outBytes", zero)).alias("out_bytes"), F.min("pos").alias("first")
    )
    rows = rows.withColumn("saved", F.col("in_bytes") - F.col("out_bytes")).orderBy(F.desc("saved"), "first")
    return (rows.limit(most) if most else rows).select("key", "calls", "in_bytes", "out_bytes", "saved")


def largest(records: DataFrame, most: int = 5) -> DataFrame:
    """The records of most input bytes, in their order."""
    return processed(records).orderBy(F.desc(F.coalesce("inBytes", F.lit(0))), "pos").limit(most).select("pos", "tag", "cmdWord", "strategy", "inBytes", "outBytes")


def possible_reruns(records: DataFrame) -> DataFrame:
    """Records of a command within five minutes of a lossy record just before it of the same command."""
    own = Window.partitionBy("cmdHash").orderBy("pos")
    rows = records.where("cmdHash IS NOT NULL AND ts_ms IS NOT NULL").withColumns({"was_lossy": F.lag(_flag("lossy")).over(own), "was_at": F.lag("ts_ms").over(own)})
    return rows.where(F.col("was_lossy") & (F.col("ts_ms") - F.col("was_at") < C.RERUN_MS)).select("pos", "cmdHash", "cmdWord", (F.col("ts_ms") - F.col("was_at")).alias("gap_ms"))


def recovery_rate(records: DataFrame) -> DataFrame:
    """Candidates after lossy and untouched results, with their bases."""
    live, candidate, after = ~_flag("bypass"), _flag("candidate"), _flag("preceding_lossy")
    n, all_ = F.count_if(candidate), F.count_if(live)
    return records.agg(
        n.alias("candidates"), all_.alias("total"), F.round(n / F.when(all_ != 0, all_), 3).alias("rate"), F.count_if(candidate & after).alias("after_lossy"),
        F.count_if(live & _flag("lossy")).alias("lossy_total"), F.count_if(candidate & ~after).alias("after_untouched"), F.count_if(live & ~_flag("lossy")).alias("untouched_total"),
    )


def recovery_kinds(records: DataFrame) -> DataFrame:
    return records.where(_flag("candidate")).groupBy("kind").agg(F.count("*").alias("n"))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``file, out_bytes, base_bytes, regressed``: a tenth and 64 bytes over the baseline; files without one pass."""
    joined = current.join(baseline.select("file", F.col("out_bytes").alias("base_bytes")), "file", "left")
    return joined.select("file", "out_bytes", "base_bytes", F.coalesce(F.col("out_bytes") > F.col("base_bytes") * 1.1 + 64, F.lit(False)).alias("regressed"))


def posture_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("posture").agg(F.count("*").alias("files"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"))


def latency(samples: DataFrame) -> DataFrame:
    """Median and 95th percentile by scenario."""
    return samples.groupBy("scenario").agg(F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"))


def compare_wiring(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """``event, status``: missing, extra, changed or same, by a full outer comparison."""
    both = wanted.select("event", F.col("command").alias("want")).join(installed.select("event", F.col("command").alias("have")), "event", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed").otherwise("same")
    return both.select("event", status.alias("status"))


def rendered(records: DataFrame, as_json: bool = False) -> str:
    """The report as text or JSON; figures carry their evidence level."""
    row = summary(records).first().asDict()
    if not row["calls_processed"] and not row["bypasses"]:
        return json.dumps({"message": "no data"}) if as_json else "  no data"
    level = lambda k: "L2-preservation" if k in ("lossy", "lossless") else "L1-component"
    if as_json:
        return json.dumps({k: {"value": v, "evidence": level(k)} for k, v in row.items()})
    groups = [f"  {r.key}: {r.calls} calls, {r.saved} bytes saved" for r in grouped(records, "strategy", 15).collect()]
    return "\n".join([*(f"  {k}: {v} [{level(k)}]" for k, v in row.items()), "by strategy:", *groups])
