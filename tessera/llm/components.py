"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stash import Stash

#: Links up to which one executor's task finds the components, 16 bytes each; beyond it all tasks do, by stars.
ONE_TASK = 1_000_000


def _roots(batches):
    """(node, root) of all links of a table of at most ``ONE_TASK`` rows: labels spread and jump until none changes."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in zip(*parts) for x in p]), return_inverse=True)
    u, v = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges(u, v) with u > v or u = v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
    below = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(below.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame, stash: Stash, label: str) -> DataFrame:
    """(node, root) for each end of ``links(a, b)``; root is the smallest node reachable.

    A table of few links is one task's work on an executor. Larger ones
    alternate large-star and small-star steps: every step is a shuffle with
    partial minima, so a node of very many links costs no task more than its
    share, and the number of rounds grows with the logarithm of the size. Each
    round is written. Self links keep a node as its own root; an empty table
    gives no row.
    """
    edges = stash.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0"
    )
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_roots, "node long, root long")
    state, step = None, 0
    while True:
        step += 1
        edges = stash.keep(_stars(edges), f"{label}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stash.drop(f"{label}-{step - 1}")
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now
