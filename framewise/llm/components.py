"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.storage import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """``node, comp`` for each end of ``links(a, b)``; comp is the least node that links reach.

    Every round takes the least label among a node's neighbours and then the
    label of that label, so chains shorten by halves.  Labels stay in tables of
    the shared folder, the last as ``name`` in ``scratch``; only whether any
    changed comes to the driver.
    """
    both = scratch.put(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "both")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = scratch.put(first.select("node", F.least("node", "low").alias("comp"), F.col("node").alias("was")), name)
    while not labels.where("comp <> was").isEmpty():
        low = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        taken = labels.join(low, labels["node"] == low["a"]).select("node", F.least("comp", "low").alias("next"), F.col("comp").alias("was"))
        of = labels.select(F.col("node").alias("at"), F.col("comp").alias("there"))
        jumped = scratch.put(taken.join(of, taken["next"] == of["at"]).select("node", F.least("next", "there").alias("comp"), "was"), "jumped")
        scratch.drop(name)
        scratch.paths[name] = scratch.paths.pop("jumped")
        labels = jumped
    scratch.drop("both")
    return labels.select("node", "comp")
