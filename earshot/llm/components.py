"""Connected components of links between longs, as DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links ``a[i] - b[i]``: (node, root), node != root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """(u, v), u > v: distinct links with the components of ``links``, never more of them.

    Of a node's lesser neighbours the least keeps its link and is linked with the others in the
    node's place.  Stars of many tasks over one group so fall together: a member keeps one link,
    the rest become links between the few roots of the stars."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.withColumn("least", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of every linked node.

    ``links``: columns u, v.  They are contracted first, since every round joins all of them.
    Labels spread to neighbours and then jump to their label's label, until nothing changes;
    each round is written, so a lost executor costs at most a round.
    """
    few = stage(contracted(contracted(links)), "links")
    both = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = stage(step, "labels")
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = stage(step.join(up, F.col("label") == F.col("n2")).select("node", F.least("label", "l2").alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            return labels


def name_rows(marked: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked`` (with a column fp) with component_id, the least id of the component of fp.

    ``nodes``: fp, n (rows), least (id); ``labels``: node, label of the linked ones."""
    named = labels.join(nodes, F.col("node") == F.col("fp")).select("fp", "label", "least")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(names, "label").select(F.col("fp").alias("f2"), "component_id")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    node_names = stage(
        nodes.join(named, F.col("fp") == F.col("f2"), "left").select(F.col("fp").alias("f3"), F.coalesce("component_id", "least").alias("component_id"), "n"),
        "component-names",
    )
    # A fingerprint of a thousandth of all rows or more would gather them in one task;
    # there are at most a thousand of those.
    hot = F.broadcast(node_names.filter(F.col("n") * 1000 >= total).drop("n"))
    cold = node_names.filter(F.col("n") * 1000 < total).drop("n")
    often = marked.join(hot, F.col("fp") == F.col("f3")).drop("f3")
    seldom = marked.join(hot, F.col("fp") == F.col("f3"), "left_anti").join(cold, F.col("fp") == F.col("f3")).drop("f3")
    return often.unionByName(seldom)
