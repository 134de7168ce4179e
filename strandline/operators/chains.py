"""Order of the links of chains and loops by pointer doubling.

After k rounds a link knows the link 2^k before it, so the number of rounds is the
logarithm of the longest chain. A link is pointed at by at most one other, so every join
key is unique and no chain is ever gathered in one place. Each round is written to the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import settled

MAX_ROUNDS = 64


def _walk_back(base: DataFrame) -> DataFrame:
    """(id, ptr, dist, head, least) from (id, prev, before), doubled until all chains reach their first link and all loops close.

    ptr stays set only in loops. There `least` is the least id of the loop: once no window
    of 2^k links finds a lesser id in the next one, the windows agree all the way round.
    """
    state = base.select(
        "id", F.col("prev").alias("ptr"), F.coalesce("before", F.lit(0)).cast("bigint").alias("dist"),
        F.coalesce("prev", "id").alias("head"), F.coalesce(F.least("id", "prev"), "id").alias("least"),
    )
    for _ in range(MAX_ROUNDS):
        behind = state.select(
            F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("head").alias("_h"), F.col("least").alias("_l")
        )
        on = F.col("ptr").isNotNull()
        step = state.join(behind, "ptr", "left").select(
            "id", F.col("_p").alias("ptr"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
            F.coalesce("_h", "head").alias("head"), F.coalesce(F.least("least", "_l"), "least").alias("least"),
            (on & (F.col("_p").isNull() | (F.col("_l") < F.col("least")))).alias("moved"),
        )
        step = settled(step, "walk")
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state
    raise RuntimeError("chains did not settle")


def order_chains(links: DataFrame) -> DataFrame:
    """(id, chain, seq, closed) for links (id, start, end, length); starts are unique and so are ends.

    A chain is named by its first link, a loop by its least; seq is the length before the link.
    """
    before = links.select(F.col("end").alias("start"), F.col("id").alias("prev"), F.col("length").alias("before"))
    base = settled(links.select("id", "start").join(before, "start", "left").select("id", "prev", "before"), "links")
    walked = _walk_back(base)
    chains = walked.where("ptr is null").select("id", F.col("head").alias("chain"), F.col("dist").alias("seq"), F.lit(False).alias("closed"))
    loops = walked.where("ptr is not null").select("id", "least")
    if loops.isEmpty():
        return chains
    # Cut every loop before its least link and walk again.
    kept = F.col("id") != F.col("least")
    cut = base.join(loops, "id").select("id", F.when(kept, F.col("prev")).alias("prev"), F.when(kept, F.col("before")).alias("before"))
    opened = _walk_back(cut).select("id", F.col("head").alias("chain"), F.col("dist").alias("seq"), F.lit(True).alias("closed"))
    return chains.unionByName(opened)


def _walk_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fragment, place in it and whether it closes, for the links of one block; the same doubling on arrays."""
    pdf = pdf.sort_values(["row", "col", "n"], ignore_index=True)
    span = int(max(pdf["x0"].max(), pdf["x1"].max())) + 1
    start = pdf["y0"].to_numpy(np.int64) * span + pdf["x0"].to_numpy()
    end = pdf["y1"].to_numpy(np.int64) * span + pdf["x1"].to_numpy()
    order = np.argsort(end)
    at = np.searchsorted(end, start, sorter=order).clip(max=len(end) - 1)
    prev = np.where(end[order[at]] == start, order[at], -1)
    closed = np.zeros(len(pdf), dtype=bool)

    def walk(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.arange(len(prev))
        ptr, dist, head = prev.copy(), (prev >= 0).astype(np.int64), np.where(prev >= 0, prev, own)
        least = np.minimum(own, head)
        for _ in range(len(prev).bit_length() + 1):
            go = ptr >= 0
            to = ptr[go]
            # all reads come before the writes
            d, h, low, nxt = dist[to], head[to], least[to], ptr[to]
            dist[go] += d
            head[go] = h
            least[go] = np.minimum(least[go], low)
            ptr[go] = nxt
        return ptr, dist, head, least

    ptr, dist, head, least = walk(prev)
    if (ptr >= 0).any():
        closed = ptr >= 0
        ptr, dist, head, _ = walk(np.where(closed & (least == np.arange(len(prev))), -1, prev))
    last = np.ones(len(pdf), dtype=bool)
    last[prev[prev >= 0]] = False
    for name in ("row", "col", "n"):
        pdf[f"f{name}"] = pdf[name].to_numpy()[head]
    pdf["place"], pdf["closed"], pdf["last"] = dist, closed, last
    return pdf.drop(columns=["block_row", "block_col"])


def order_pieces(pieces: DataFrame, block: int = 256) -> DataFrame:
    """Pieces (scene_id, row, col, n, y0, x0, y1, x1) with chain, seq and closed.

    Pieces are strung together inside their block, an array of bounded size; the
    fragments that leave a block are then ordered by doubling, so the rounds depend on
    how many blocks a line crosses.
    """
    kind = pieces.schema["scene_id"].dataType.simpleString()
    names = ("row", "col", "n", "y0", "x0", "y1", "x1")
    blocked = pieces.select(
        "scene_id", *[F.col(c).cast("int").alias(c) for c in names],
        F.expr(f"row div {block}").cast("int").alias("block_row"), F.expr(f"col div {block}").cast("int").alias("block_col"),
    )
    schema = f"scene_id {kind}, " + ", ".join(f"{c} int" for c in names) + ", frow int, fcol int, fn int, place long, closed boolean, last boolean"
    strung = settled(blocked.groupBy("scene_id", "block_row", "block_col").applyInPandas(_walk_block, schema), "fragments")
    frag = F.struct("scene_id", F.col("frow").alias("row"), F.col("fcol").alias("col"), F.col("fn").alias("n"))
    strung = strung.withColumn("frag", frag).drop("frow", "fcol", "fn")
    first = F.when(F.col("place") == 0, F.struct("scene_id", F.col("y0").alias("y"), F.col("x0").alias("x")))
    final = F.when(F.col("last"), F.struct("scene_id", F.col("y1").alias("y"), F.col("x1").alias("x")))
    links = strung.where(~F.col("closed")).groupBy(F.col("frag").alias("id")).agg(
        F.max(first).alias("start"), F.max(final).alias("end"), F.count("*").alias("length")
    )
    placed = order_chains(links).select(F.col("id").alias("frag"), "chain", F.col("seq").alias("_before"), F.col("closed").alias("_loop"))
    return strung.join(placed, "frag", "left").select(
        "scene_id", *names, F.coalesce("chain", "frag").alias("chain"), (F.coalesce("_before", F.lit(0)) + F.col("place")).alias("seq"),
        (F.col("closed") | F.coalesce("_loop", F.lit(False))).alias("closed"),
    )
