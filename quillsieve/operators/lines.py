"""Line operators over ``(doc_id, ln, line)``: one row a line, numbered from 0. All share one partitioning by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.text import census_category, is_signal


def by_doc():
    return Window.partitionBy("doc_id")


def in_order():
    """A document's lines in order: the one window that all line operators share."""
    return by_doc().orderBy("ln")


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, the empty last one included."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("ln", "line"))


def join_lines(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """Documents from lines."""
    rows = F.array_sort(F.collect_list(F.struct("ln", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def dedupe_runs(lines: DataFrame) -> DataFrame:
    """Runs of three and more equal lines that are not empty become one line with a count; numbers are given anew."""
    new = F.coalesce(F.lag("line").over(in_order()) != F.col("line"), F.lit(True)) | (F.col("line") == "")
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(in_order()))
    own = Window.partitionBy("doc_id", "run")
    sized = runs.withColumns({"n": F.count("*").over(own), "k": F.row_number().over(own.orderBy("ln"))}).where("n < 3 OR k = 1")
    line = F.when(F.col("n") >= 3, F.concat("line", F.lit(C.REPEATED.split("{n}")[0]), F.col("n").cast("string"), F.lit(C.REPEATED.split("{n}")[1]))).otherwise(F.col("line"))
    return sized.select("doc_id", (F.row_number().over(in_order()) - 1).alias("ln"), line.alias("line"))


def with_signal(lines: DataFrame) -> DataFrame:
    return lines.withColumn("signal", is_signal(F.col("line")))


def cap_flags(lines: DataFrame, cap: Column) -> DataFrame:
    """``kept`` for each line of a capped view without relevance: signal lines, then 60/40 of the rest from head and tail.

    ``whole`` marks documents that fit or are nine tenths signal.
    """
    rows = with_signal(lines).withColumns({"n": F.count("*").over(by_doc()), "n_signal": F.sum(F.col("signal").cast("int")).over(by_doc()), "cap": cap.cast("long")})
    budget = F.greatest(F.lit(0).cast("long"), F.col("cap") - F.col("n_signal"))
    rows = rows.withColumn("head", F.ceil(budget * 0.6)).withColumn("tail", budget - F.col("head"))
    whole = (F.col("n") <= F.col("cap")) | (F.col("n_signal") >= F.col("n") * 0.9)
    kept = whole | F.col("signal") | (F.col("ln") < F.col("head")) | (F.col("ln") >= F.col("n") - F.col("tail"))
    return rows.withColumns({"whole": whole, "kept": kept})


def gap_rows(kept: DataFrame) -> DataFrame:
    """Kept rows (``doc_id, ln, line, n``) with ``gap``: lines left out before each, and ``rest``: after the last."""
    gap = F.col("ln") - F.coalesce(F.lag("ln").over(in_order()), F.lit(-1)) - 1
    rest = F.when(F.lead("ln").over(in_order()).isNull(), F.col("n") - 1 - F.col("ln")).otherwise(0)
    return kept.withColumns({"gap": gap.cast("long"), "rest": rest.cast("long")})


def _omitted(n: Column) -> Column:
    before, after = C.OMITTED.split("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def cap_lines(lines: DataFrame, cap: Column) -> DataFrame:
    """``doc_id, text, omitted``: capped views with gap marks and the closing hint."""
    rows = gap_rows(cap_flags(lines, cap).where("kept"))
    part = F.concat_ws(
        "\n",
        F.when(F.col("gap") > 0, _omitted(F.col("gap"))),
        F.col("line"),
        F.when(F.col("rest") > 0, _omitted(F.col("rest"))),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", part.alias("p")))), lambda x: x["p"]), "\n")
    out = rows.groupBy("doc_id").agg(body.alias("body"), F.sum(F.col("gap") + F.col("rest")).alias("omitted"), F.bool_and("whole").alias("whole"))
    return out.select("doc_id", F.when(F.col("whole"), F.col("body")).otherwise(F.concat("body", F.lit("\n" + C.SHORTENED))).alias("text"), "omitted")


def relevance_hits(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """``doc_id, token, ln`` for lines that hold a token (``doc_id, token``); tokens with over 50 lines of a document drop out."""
    met = lines.join(tokens, "doc_id").where(F.lower("line").contains(F.col("token")))
    n = F.count("*").over(Window.partitionBy("doc_id", "token"))
    return met.withColumn("n", n).where(F.col("n") <= C.RELEVANCE_COMMON).select("doc_id", "token", "ln")


def signal_census(lines: DataFrame) -> DataFrame:
    """``doc_id, n_signal, census``: signal lines by their first category, as words."""
    rows = with_signal(lines).where("signal").withColumn("k", census_category(F.col("line")))
    counts = [F.count_if(F.col("k") == k).alias(f"c{k}") for k in range(len(C.CENSUS))]
    words = [
        F.when(F.col(f"c{k}") > 0, F.concat(F.col(f"c{k}").cast("string"), F.lit(" "), F.when(F.col(f"c{k}") == 1, one).otherwise(many)))
        for k, (one, many, _) in enumerate(C.CENSUS)
    ]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_signal"), *counts).select("doc_id", "n_signal", F.concat_ws(", ", *words).alias("census"))


def count_signals(lines: DataFrame) -> DataFrame:
    """``doc_id, errors, warnings``; lines with our own mark do not count."""
    rows = lines.where(~F.col("line").contains(C.MARK) & is_signal(F.col("line"))).withColumn("k", census_category(F.col("line")))
    found = rows.groupBy("doc_id").agg(F.count_if(F.col("k") <= 2).alias("errors"), F.count_if(F.col("k") > 2).alias("warnings"))
    zero = F.lit(0).cast("long")
    return lines.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"))


def digest_rows(lines: DataFrame) -> DataFrame:
    """Lines of a digest without relevance: ``part`` is ``lead`` (first and last signal lines) or ``structure`` (head and tail)."""
    rows = with_signal(lines).withColumn("n", F.count("*").over(by_doc()))
    own = Window.partitionBy("doc_id", "signal")
    rows = rows.withColumns({"up": F.row_number().over(own.orderBy("ln")), "down": F.row_number().over(own.orderBy(F.desc("ln")))})
    lead = F.col("signal") & ((F.col("up") <= C.DIGEST_SIGNAL) | (F.col("down") <= C.DIGEST_SIGNAL))
    structure = (F.col("ln") < C.DIGEST_HEAD) | (F.col("ln") >= F.col("n") - C.DIGEST_TAIL)
    return rows.withColumn("part", F.when(lead, "lead").when(structure, "structure").when(F.col("signal"), "unshown")).where("part IS NOT NULL").select("doc_id", "ln", "line", "part", "n")


def collapse_lines(lines: DataFrame, noise: Column, least: int) -> DataFrame:
    """Without noise lines, a row with ``removed`` in place of the first; documents with fewer than ``least`` stay whole."""
    rows = lines.withColumn("noise", noise).withColumn("removed", F.sum(F.col("noise").cast("int")).over(by_doc()))
    first = F.min(F.when(F.col("noise"), F.col("ln"))).over(by_doc())
    rows = rows.withColumn("first", first)
    keep = (F.col("removed") < least) | ~F.col("noise") | (F.col("ln") == F.col("first"))
    return rows.where(keep).select("doc_id", "ln", F.when((F.col("removed") >= least) & F.col("noise"), F.lit(None)).otherwise(F.col("line")).alias("line"), F.when(F.col("removed") >= least, F.col("removed")).otherwise(0).alias("removed"))
