"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v), both long and not null.

    ``component`` is the smallest node reachable.  Each round points every node
    at its smallest neighbour, follows the pointers to their roots and keeps
    the links between different roots: at most half of the nodes are left as
    roots, so rounds grow with the logarithm of the nodes.  All steps are joins
    and minima that combine before they shuffle; results are written to the
    shared folder, so that a lost executor repeats one step only.
    """
    edges = stored(_between(links.select("u", "v")), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))
        roots = _roots(stored(parents.select("node", F.least("node", "parent").alias("parent")), "parents"))
        u, v = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv")
        edges = stored(
            _between(edges.join(u, "u").join(v, "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))),
            "links",
        )
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            step = roots.select(F.col("node").alias("component"), "root")
            labels = stored(
                labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
                "labels",
            )
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def _between(links: DataFrame) -> DataFrame:
    """Each link once, smaller end first, without loops."""
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at a root."""
    roots = parents.withColumnRenamed("parent", "root")
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = stored(
            roots.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")),
            "roots",
        )
        if roots.where("moved").isEmpty():
            return roots.select("node", "root")
