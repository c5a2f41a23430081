"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.session import materialise

LINKS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node it reaches) for every end of a link (columns ``a``, ``b``).

    Every node points to its smallest neighbour or itself; pointers are followed
    until they rest; links between different roots are what the next round
    works on. Roots at least halve from round to round. Only counts reach the driver;
    each round starts from a written table.
    """
    spark = links.sparkSession
    links = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    # (node, comp) so far; nodes that are no key of a later round are done
    steps: list[DataFrame] = []
    while n_links := links.count():
        n = 1 + n_links // LINKS_A_TASK  # tasks that share what is written
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        pointer = materialise(pointer.coalesce(n), "pointers")
        while True:
            onward = pointer.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = pointer.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            jumped = materialise(jumped.coalesce(n), "pointers")
            pointer = jumped.select("node", "to")
            if jumped.where("moved").head() is None:
                break
        steps.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = pointer.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        crossing = (
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        links = materialise(crossing.coalesce(n), "links")
    if not steps:
        return spark.createDataFrame([], "node long, comp long")
    if len(steps) == 1:
        return steps[0].withColumnRenamed("to", "comp")
    found = steps[0].withColumnRenamed("to", "comp")
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("comp"), "to")
        found = found.join(onward, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return materialise(found, "components")
