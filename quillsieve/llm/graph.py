"""Connected components of links, distributed: smallest neighbour labels and pointer jumps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: each node of a link with the smallest node that it reaches. No links: no rows.

    Every round is a written table that takes the last one's place; rounds grow with the logarithm of a component's
    diameter.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(both.union(both.select("v", "u")).distinct())
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node"))
    held = labels
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = written(hooked)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = written(hooked.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("moved")))
        released(hooked, held)
        labels, held = new.select("node", "label"), new
        if not new.where("moved").limit(1).count():
            released(edges)
            labels._written_to = new._written_to  # the caller's to release
            return labels
