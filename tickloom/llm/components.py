"""Connected components by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import forget, written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b); label is the smallest id reachable.

    Each round takes the least label among neighbours and then the label's own label, so the number of
    rounds is about the logarithm of the longest path. Rounds go on until no label changes.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("id", "to").distinct(), "edges")
    labels = written(edges.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "labels")
    used = [edges, labels]
    while True:
        near = edges.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        near = written(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("near")), "near")
        hop = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        after = written(near.join(hop, "near").select("id", F.least("near", "far").alias("label"), (F.col("label") > F.least("near", "far")).alias("moved")), "labels")
        if after.where("moved").isEmpty():
            forget(near, *used)
            return after
        forget(near, *used[1:])
        used, labels = [edges, after], after.select("id", "label")
