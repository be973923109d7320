"""What both searches share: usable vectors, classes of equal vectors, blocks, and ranked lists.

Rows of equal vectors form a class, named by its smallest id. A class keeps its smallest ``k + 1`` ids: no query can
list more of them. Searches run between classes, so copies are scored once, and a hot group of copies costs as much
as one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def finite(vector: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable(rows: DataFrame, made: Column, keep: Column) -> DataFrame:
    """``vec_id long, v array``: one row an id. Null ids drop out; rows repeated under an id give its smallest vector."""
    return rows.where(F.col("vec_id").isNotNull() & keep).select(F.col("vec_id").cast("long").alias("vec_id"), made.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``cid long, v array, ids array<long>``: a row for each distinct vector, with its ``k + 1`` smallest ids in order.

    The rank limit also runs before the shuffle, so a hot vector sends ``k + 1`` rows from each task.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


def blocks_for(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def block_of(key: Column, n: int | Column) -> Column:
    """A stable block number under ``n``."""
    return F.pmod(F.xxhash64(key, F.lit(17)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are continued by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same number of columns."""
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def best_rows(scores: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores, ties to the smaller name."""
    if len(scores) > 4 * most:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((names[at], -scores[at]))][:most]


def ranked(found: DataFrame, members: DataFrame, queries: DataFrame, k: int, score_type: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` from scored classes ``qid, cid, score``.

    The best ``k + 1`` classes of a query class hold its best ``k + 1`` rows. Their ids are laid out once for each
    query class; each of its queries then takes the list without itself.
    """
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    rows = top.join(members.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = few.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).join(lists, "qid")
    return out.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", F.col("x.score").cast(score_type).alias("score"))


def query_classes(rows: DataFrame, groups: DataFrame, divisor: int = 20) -> tuple[DataFrame, DataFrame]:
    """Queries (``vec_id, cid``), and the classes (``cid, v``) that hold any."""
    asked = rows.where(F.col("vec_id") % divisor == 0).join(groups.select("v", "cid"), "v").select("vec_id", "cid")
    return asked, groups.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v")


