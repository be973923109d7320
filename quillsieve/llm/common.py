"""Shared helpers: table access, the shared folder, text batches and a bounded word cache."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own (tests).
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.quillsieve.shared.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillsieve-")
    spark.conf.set("spark.quillsieve.shared.dir", made)
    return made


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillsieve-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def released(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that nothing reads any more, with the shuffle files of the jobs that made them.

    What a later step still reads stays, so a lost executor's tasks can run again. Shuffle files go once the driver no
    longer knows the job, so its unreachable objects are collected here.
    """
    spark = None
    for t in tables:
        path = getattr(t, "_written_to", None) if t is not None else None
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)
            t._written_to = None
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def free_names(taken, *wanted: str) -> dict[str, str]:
    """Names for own columns that no column of a table has, by what they stand for (case does not tell names apart)."""
    lower, out = {c.lower() for c in taken}, {}
    for name in wanted:
        own = f"__{name}"
        while own in lower:
            own = "_" + own
        out[name] = own
        lower.add(own)
    return out


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def partitions_for(spark: SparkSession, least: int = 12) -> int:
    """How many partitions a keyed repartition gets: what the session set for shuffles."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


class WordCache:
    """Two generations of word results, so that memory stays under ``2 * limit`` entries."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words) -> list:
        """The distinct words without a result; those of the old generation are promoted."""
        young, old, out = self.young, self.old, []
        for w in set(words).difference(young):
            if (v := old.get(w)) is None:
                out.append(w)
            else:
                young[w] = v
        return out

    def put(self, words, values) -> dict:
        """Add results; returns the dict that holds every word asked for in this turn."""
        self.young.update(zip(words, values))
        return self.young

    def turn(self) -> None:
        """To be called between turns: ages the words once there are too many."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def slices(sizes: list[int], most: int):
    """Ranges of consecutive items whose sizes add up to ``most`` at most (or one item)."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
