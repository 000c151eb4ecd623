"""Connected classes of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pactframe.sources.tables import stored


def classes(links: DataFrame) -> DataFrame:
    """(node, class) for every node of the links (a, b); the class is the smallest node reachable.

    Each round every node takes the smallest class among its neighbours, and
    then the class of its class, so classes spread in steps that double.  A
    round is written to the shared folder; a node with very many links is
    reduced by map tasks.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("class")), "classes")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("class").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("class").alias("was"), F.least("class", "least").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("class").alias("over"))
        now = stored(hooked.join(up, "mid").select("node", "was", F.least("mid", "over").alias("class")), "classes")
        changed = not now.where(F.col("class") != F.col("was")).isEmpty()
        labels = now.drop("was")
        if not changed:
            return labels
