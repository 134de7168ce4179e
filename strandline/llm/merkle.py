"""Merkle manifest of a dataset: a digest tree of runs of three a source, and a tree over the sources.

Leaves are hashed in the JVM; texts are read there and never shuffled. Leaves get their place in their
source by two passes: rows are dealt by range of (source, id), and places count on from the totals of
the partitions before. SPAN consecutive leaves are a superblock, which is reduced by itself to one
outer node. Outer nodes are placed and proved by the same function, so a source of any size takes
log_SPAN(rows) rounds. Then leaves and the outer nodes they require (the siblings from their superblock
to the root) are cogrouped by superblock, and one applyInPandas finishes the local reduction, joins the
proofs and folds them. No task holds more than a superblock, however large a source is.

A path is a list of steps "place:siblings", one a level: the place of the node in its run, and the
digests of the run's other nodes from left to right.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.session import settled

#: Nodes of a run, levels of a superblock, and leaves of a superblock.
RUN, LEVELS = 3, 7
SPAN = RUN**LEVELS
#: Hex digits of a digest.
HEX = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    """'-' for null, else byte count, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def reduce_block(nodes: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """Steps of every level (one a node) and the last node; levels None: until one node remains."""
    steps: list[list[str]] = []
    while len(steps) < levels if levels is not None else len(nodes) > 1:
        level, above = [], []
        for i in range(0, len(nodes), RUN):
            run = nodes[i : i + RUN]
            above.append(digest("".join(run)))
            level += [f"{p}:" + "".join(run[:p] + run[p + 1 :]) for p in range(len(run))]
        steps.append(level)
        nodes = above
    return steps, nodes[0]


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        at = HEX * int(step[0])
        siblings = step[2:]
        leaf = digest(siblings[:at] + leaf + siblings[at:])
    return leaf


def _levels(size: int) -> int | None:
    return None if size <= SPAN else LEVELS


def _block_root(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_at")
    first = pdf.iloc[0]
    _, root = reduce_block(pdf["_digest"].tolist(), _levels(first["_size"]))
    return pd.DataFrame({"_g": [first["_g"]], "_at": [first["_at"] // SPAN], "_size": [-(-first["_size"] // SPAN)], "_digest": [root]})


def _local_paths(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]], str]:
    pdf = pdf.sort_values("_at", ignore_index=True)
    steps, root = reduce_block(pdf["_digest"].tolist(), _levels(pdf["_size"].iloc[0]))
    return pdf, [[level[i // RUN**k] for k, level in enumerate(steps)] for i in range(len(pdf))], root


def _proved(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of nodes up to the top of their group."""
    pdf, paths, root = _local_paths(pdf)
    above, top = (list(outer["_path"].iloc[0]), outer["_top"].iloc[0]) if len(outer) else ([], root)
    return pd.DataFrame({"_g": pdf["_g"], "_at": pdf["_at"], "_path": [p + above for p in paths], "_top": top})


def _finished(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Leaves with their whole path, its digest, and the root folded from the altered leaf."""
    pdf, paths, _ = _local_paths(pdf)
    above, top, root = list(outer["_path"].iloc[0]), outer["_top"].iloc[0], outer["_root"].iloc[0]
    paths = [p + above for p in paths]
    keep = bool(pdf["_keep"].iloc[0])
    leaves = [a if a is not None else d for a, d in zip(pdf["_altered"], pdf["_digest"], strict=True)]
    return pd.DataFrame({
        "_id": pdf["_id"], "_g": pdf["_g"], "leaf": pdf["_digest"], "subroot": top, "root": root,
        "proof_sha256": [digest("".join(s[2:] for s in p)) for p in paths], "proof": paths if keep else None,
        "folded_root": [fold(x, p) for x, p in zip(leaves, paths, strict=True)],
    })


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows (with _g) with _at, their place in their group by order (columns that tell rows apart), and _size, its rows.

    Groups of any size: rows are dealt by range, so a large group spreads over many partitions.
    """
    dealt = settled(rows.repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id()), label)
    counts = dealt.groupBy("_g", "_part").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("_g")
    ahead = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = settled(counts.select("_g", "_part", ahead.alias("_ahead"), F.sum("_n").over(whole).alias("_size")), f"{label}-bases")
    place = F.row_number().over(W.partitionBy("_g", "_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(bases, ["_g", "_part"]).select(*rows.columns, (F.col("_ahead") + F.col("_place")).alias("_at"), "_size")


def _block() -> Column:
    return F.floor(F.col("_at") / SPAN).alias("_block")


def outer_nodes(nodes: DataFrame) -> DataFrame:
    """One (_g, _at, _size, _digest) a superblock of nodes."""
    roots = nodes.select("_g", "_at", "_size", "_digest", _block()).groupBy("_g", "_block").applyInPandas(_block_root, "_g string, _at long, _size long, _digest string")
    return settled(roots, "outer-nodes")


def prove(nodes: DataFrame) -> DataFrame:
    """(_g, _at, _path, _top) of nodes (_g, _at, _size, _digest): the way up to the last node of their group."""
    wide = nodes.where(F.col("_size") > SPAN)
    above = prove(outer_nodes(wide)) if not wide.isEmpty() else None
    kind = "_g string, _at long, _path array<string>, _top string"
    if above is None:
        above = nodes.sparkSession.createDataFrame([], kind)
    left = nodes.select("_g", "_at", "_size", "_digest", _block()).groupBy("_g", "_block")
    right = above.select("_g", F.col("_at").alias("_block"), "_path", "_top").groupBy("_g", "_block")
    return settled(left.cogroup(right).applyInPandas(_proved, kind), "paths")


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "source", ident: str = "doc_id", altered: dict[str, Column] | None = None, proofs: bool = True) -> DataFrame:
    """One row per row of docs: _id, _group, leaf, subroot, root, proof_sha256, proof (steps; null without proofs), folded_root, verified.

    fields are hashed in the given order. altered (field -> changed column) gives the leaf that is folded
    with the siblings of the unchanged tree. Nulls: a null field is '-'; a null group is a group of its
    own, before all others; a null id comes first in its group. Repeated ids follow in the order of
    their leaves; rows repeated as a whole each have a leaf. Empty table: no rows. Other columns are not read.
    """
    fields, altered = fields or FIELDS, altered or {}
    kinds = {name: docs.schema[name].dataType.simpleString() for name in (ident, group)}
    own, other = (leaf_digest([change.get(f, F.col(f"`{f}`")) for f in fields]) for change in ({}, altered))
    # The first letter keeps the null group apart from, and before, the empty one.
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    found = docs.select(key.alias("_g"), F.col(f"`{ident}`").alias("_id"), own.alias("_digest"), other.alias("_altered"), F.monotonically_increasing_id().alias("_row"))
    leaves = settled(found.withColumn("_altered", F.when(F.col("_altered") != F.col("_digest"), F.col("_altered"))), "leaves")
    nodes = settled(placed(leaves, ["_id", "_digest", "_row"], "ranged").drop("_row"), "placed")
    outer = outer_nodes(nodes)
    # The way from every superblock to the last node of its source, then from there to the root.
    ways = prove(outer)
    subroots = ways.where("_at = 0").select(F.lit("").alias("_g"), F.col("_g").alias("_name"), F.col("_top").alias("_digest"))
    tops = settled(placed(subroots, ["_name"], "subroots"), "subroots-placed")
    last = prove(tops).select("_at", F.col("_path").alias("_on"), F.col("_top").alias("_root"))
    ends = settled(tops.join(last, "_at").select(F.col("_name").alias("_g"), "_on", "_root"), "subroot-paths")
    required = ways.join(ends, "_g").select("_g", F.col("_at").alias("_block"), F.concat("_path", "_on").alias("_path"), "_top", "_root")
    # Ids travel as text: a column of numbers with nulls would become floats in pandas.
    left = nodes.select("_g", "_at", "_size", "_digest", "_altered", F.col("_id").cast("string").alias("_id"), F.lit(proofs).alias("_keep"), _block()).groupBy("_g", "_block")
    kind = "_id string, _g string, leaf string, subroot string, root string, proof_sha256 string, proof array<string>, folded_root string"
    done = left.cogroup(required.groupBy("_g", "_block")).applyInPandas(_finished, kind)
    name = F.when(F.col("_g") != "0", F.expr("substring(_g, 2)")).cast(kinds[group])
    return done.select(F.col("_id").cast(kinds[ident]).alias("_id"), name.alias("_group"), "leaf", "subroot", "root", "proof_sha256", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
