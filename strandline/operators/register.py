"""Whole-pixel co-registration of two planes by correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.blocks import along_col, along_row, core, with_halo

KEY = ["scene_id", "row", "col"]


def _correlation(a: str, b: str) -> Column:
    """Correlation over the rows where both have a value; NULL where either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, F.col(a))) * F.var_pop(F.when(both, F.col(b))))
    return F.try_divide(F.covar_pop(a, b), spread)


def shift_scores(base: DataFrame, target: DataFrame, value: str, reach: int = 2, block: int = 256) -> DataFrame:
    """(scene_id, dr, dc, score): correlation of base with target moved by each shift up to `reach`.

    A shift (dr, dc) says that the place (row, col) of base is (row + dr, col + dc) in
    target. All shifts are read off the neighbourhood in one pass and aggregated side by
    side, so the pixels are neither repeated nor shuffled for each shift. A flat scene has
    no correlation: its scores are NULL.
    """
    both = base.select(*KEY, F.col(value).alias("b")).join(target.select(*KEY, F.col(value).alias("t")), KEY)
    df = with_halo(both, ["b", "t"], reach, block)
    steps = range(-reach, reach + 1)
    df = df.withColumn("_row", F.array(*[F.lag("t", -d).over(along_row()) for d in steps]))
    df = df.withColumns({f"_s{i}": F.lag("_row", -d).over(along_col()) for i, d in enumerate(steps)})
    at = {(dr, dc): F.get(f"_s{i}", F.lit(j)) for i, dr in enumerate(steps) for j, dc in enumerate(steps)}
    flat = core(df, "b", *[c.alias(f"s{i}") for i, c in enumerate(at.values())])
    wide = flat.groupBy("scene_id").agg(*[_correlation("b", f"s{i}").alias(f"c{i}") for i in range(len(at))])
    rows = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.col(f"c{i}").alias("score")) for i, (dr, dc) in enumerate(at)])
    return wide.select("scene_id", F.inline(rows))


def best_shift(scores: DataFrame) -> DataFrame:
    """(scene_id, dr, dc, score) with the greatest score; the smaller shift on a tie."""
    order = F.struct("score", (-F.abs("dr") - F.abs("dc")).alias("near"), "dr", "dc")
    best = scores.where("score is not null").groupBy("scene_id").agg(F.max(order).alias("m"))
    return best.select("scene_id", "m.dr", "m.dc", "m.score")


def apply_shift(target: DataFrame, shift: DataFrame) -> DataFrame:
    """Target pixels moved to the places of the base; a scene without a shift stays where it is."""
    moved = target.join(shift.select("scene_id", "dr", "dc"), "scene_id", "left").fillna(0, ["dr", "dc"])
    return moved.withColumn("row", F.col("row") - F.col("dr")).withColumn("col", F.col("col") - F.col("dc")).drop("dr", "dc")
