"""Connected components over an edge table, by hooking to the smallest neighbour and contracting.

Each round hooks every node to its smallest neighbour, follows the hook once more and renames both ends
of every edge; edges that fall together vanish. Round tables lie in the shared folder. Nothing is collected:
the driver sees only whether edges are left. Hot nodes are handled because the aggregation combines on
the map side and both sides of each join are plain tables, whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import table


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``node, root``: for every node that has an edge to another node, the smallest node reachable.

    Null ends and self loops are ignored; repeated edges count once. An empty edge table gives no rows.
    """
    u, v = edges[src], edges[dst]
    live = table(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(),
        "edges",
    )
    root: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("to")), "hook")
        over = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = table(hook.join(over, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "hook2")
        if root is None:
            root = hook.withColumnRenamed("to", "root")
        else:
            step = hook.select(F.col("node").alias("root"), F.col("to"))
            root = root.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        root = table(root, "roots")
        names = [hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("u", "v")]
        live = table(
            live.join(names[0], "u").join(names[1], "v").where("u2 != v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(),
            "edges",
        )
    return root if root is not None else live.select(F.col("u").alias("node"), F.col("v").alias("root"))
