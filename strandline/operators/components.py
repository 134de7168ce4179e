"""Connected components of graphs and of pixel masks.

Graphs: large-star / small-star (Kiveris et al. 2014). Each round is two aggregations
over the edges; a star around a very large component is min-aggregated map-side, never
collected, and the number of rounds grows with the logarithm of the longest chain. Each
round is written to the shared folder, so a lost executor costs one round.

Masks: pixels are labelled inside their block first, by arrays of bounded size. Only the
labels that touch across block borders become a graph, which has a small part of the
pixels as nodes and is as wide as a region is in blocks, not in pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.blocks import BLOCK
from strandline.session import settled

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): the neighbours of u are tied to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    step = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return step.where("u <> v").distinct()


def _settled_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on exactly one root."""
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    torn = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return chained.union(torn).isEmpty()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the least node that can be reached; edges is (u, v).

    nodes (node) adds those without an edge.
    """
    current = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled_stars(current):
            break
        current = settled(_star(_star(current, large=True), large=False), "edges")
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    result = found.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return result
    return nodes.select("node").distinct().join(result, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least (row, col) of the region of each pixel inside one block: hook neighbours, halve paths, until all agree."""
    pdf = pdf.sort_values(["row", "col"], ignore_index=True)
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    eight = bool(pdf["eight"].iloc[0])
    place = np.full((row.max() - row.min() + 2, col.max() - col.min() + 3), -1, dtype=np.int64)
    r, c = row - row.min(), col - col.min() + 1
    own = np.arange(len(pdf))
    place[r, c] = own
    pairs = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    u = np.concatenate([own] * len(pairs))
    v = np.concatenate([place[r + dr, c + dc] for dr, dc in pairs])
    u, v = u[v >= 0], v[v >= 0]
    label = own.copy()
    while True:
        a, b = label[u], label[v]
        if np.array_equal(a, b):
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    pdf["lr"], pdf["lc"] = row[label], col[label]
    return pdf[["scene_id", "row", "col", "lr", "lc"]]


def label_pixels(mask: DataFrame, value: str = "m", eight: bool = True, block: int = 256) -> DataFrame:
    """(scene_id, row, col, component) of the pixels with value 1; component is the least (row, col) of its region.

    eight counts diagonal neighbours. A region may span any number of blocks.
    """
    kind = mask.schema["scene_id"].dataType.simpleString()
    ones = mask.where(F.col(value) == 1).select(
        "scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(eight).alias("eight"),
        F.expr(f"row div {block}").alias("block_row"), F.expr(f"col div {block}").alias("block_col"),
    )
    local = settled(
        ones.groupBy(*BLOCK).applyInPandas(_label_block, f"scene_id {kind}, row int, col int, lr int, lc int"), "labels"
    )
    root = F.struct("scene_id", F.col("lr").alias("row"), F.col("lc").alias("col"))
    # Pixels along block borders, and the neighbours they may have in the next block.
    on_border = (F.col("row") % block).isin(0, block - 1) | (F.col("col") % block).isin(0, block - 1)
    border = local.where(on_border).select("scene_id", "row", "col", root.alias("node"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    beside = F.inline(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps]))
    near = border.select("scene_id", F.col("node").alias("u"), "row", "col").select("scene_id", "u", beside)
    edges = near.join(border.withColumnRenamed("node", "v"), ["scene_id", "row", "col"]).where("u <> v").select("u", "v")
    merged = components(edges).select(
        F.col("node.scene_id").alias("scene_id"), F.col("node.row").alias("lr"), F.col("node.col").alias("lc"),
        F.struct(F.col("component.row").alias("row"), F.col("component.col").alias("col")).alias("merged"),
    )
    own = F.struct(F.col("lr").alias("row"), F.col("lc").alias("col"))
    return local.join(merged, ["scene_id", "lr", "lc"], "left").select(
        "scene_id", "row", "col", F.coalesce("merged", own).alias("component")
    )
