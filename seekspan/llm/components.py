"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspan.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); a component is named after its smallest node.

    In each round every node hooks onto its smallest neighbour and that one's smallest neighbour, and the links are
    rewritten to the new names; links within one name vanish. Hubs do no harm: neighbours are folded to a minimum before
    they are shuffled, and nothing but one count a round comes to the driver.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names = stored(nodes.withColumn("component", F.col("node")), "names")
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        further = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hooks = stored(hooks.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "hooks")

        def renamed(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            to = hooks.select(F.col("a").alias(column), F.col("to").alias("_to"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        names = stored(renamed(names, "component"), "names")
        moved = renamed(renamed(links, "a"), "b").filter("a <> b")
        links = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return names
