"""Two-region segmentation by morphological active contours without edges.

Marquez-Neila, Baumela, Alvarez 2014: a level set of 0 and 1 is pulled, where it
changes, to the side whose mean is nearer, and smoothed by a morphological curvature
step. A step needs the two means, then three pixels of neighbourhood: one aggregate and
one exchange each, written to the shared folder before the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.blocks import along_col, along_row, core, with_halo
from strandline.session import settled

# Number of steps, side of the start squares.
STEPS = 5
SQUARE = 5


def checkerboard(side: int = SQUARE) -> Column:
    """Start level set: squares of 0 and 1 in turn."""
    return ((F.floor(F.col("row") / side) + F.floor(F.col("col") / side)) % 2).cast("int")


def _lines(df: DataFrame) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The pairs of neighbours on the four lines through each pixel; 0 outside the frame."""
    zero = F.lit(0)
    df = df.withColumn("_n", F.struct(
        F.coalesce(F.lag("u").over(along_row()), zero).alias("l"), F.col("u").alias("m"), F.coalesce(F.lead("u").over(along_row()), zero).alias("r")))
    df = df.withColumns({"_a": F.lag("_n").over(along_col()), "_b": F.lead("_n").over(along_col())})

    def at(c: str) -> Column:
        return F.coalesce(F.col(c), zero)

    return df, [(at("_n.l"), at("_n.r")), (at("_a.m"), at("_b.m")), (at("_a.l"), at("_b.r")), (at("_a.r"), at("_b.l"))]


def _sup_inf(df: DataFrame) -> DataFrame:
    """1 where some line of three is all 1."""
    df, lines = _lines(df)
    return df.withColumn("u", F.greatest(*[F.least(F.col("u"), a, b) for a, b in lines])).drop("_n", "_a", "_b")


def _inf_sup(df: DataFrame) -> DataFrame:
    """0 where some line of three is all 0."""
    df, lines = _lines(df)
    return df.withColumn("u", F.least(*[F.greatest(F.col("u"), a, b) for a, b in lines])).drop("_n", "_a", "_b")


def _changes(df: DataFrame) -> Column:
    """Whether the level set changes along a row or a column here."""
    def differs(window) -> Column:
        u = F.col("u")
        return F.coalesce(F.lag("u").over(window), u) != F.coalesce(F.lead("u").over(window), u)

    return reduce(lambda a, b: a | b, [differs(along_row()), differs(along_col())])


def segment(pixels: DataFrame, value: str, steps: int = STEPS, smoothing: int = 1, start: Column | None = None, block: int = 256) -> DataFrame:
    """(scene_id, row, col, u): the level set after `steps` steps on a dense plane."""
    state = pixels.select("scene_id", "row", "col", F.col(value).cast("double").alias("v"), (checkerboard() if start is None else start).alias("u"))
    turn = 0
    for _ in range(steps):
        means = settled(
            state.groupBy("scene_id").agg(
                (F.sum(F.col("v") * (1 - F.col("u"))) / (F.sum(1 - F.col("u")) + 1e-8)).alias("c0"),
                (F.sum(F.col("v") * F.col("u")) / (F.sum("u") + 1e-8)).alias("c1"),
            ),
            "means",
        )
        pull = state.join(means, "scene_id").withColumn(
            "pull", F.signum((F.col("v") - F.col("c1")) ** 2 - (F.col("v") - F.col("c0")) ** 2).cast("int")
        )
        df = with_halo(pull, ["v", "u", "pull"], 1 + 2 * smoothing, block)
        df = df.withColumn("_edge", _changes(df))
        df = df.withColumn("u", F.when(F.col("_edge") & (F.col("pull") < 0), 1).when(F.col("_edge") & (F.col("pull") > 0), 0).otherwise(F.col("u"))).drop("_edge")
        for _ in range(smoothing):
            df = _sup_inf(_inf_sup(df)) if turn % 2 == 0 else _inf_sup(_sup_inf(df))
            turn += 1
        state = settled(core(df, "v", "u"), "levels")
    return state.select("scene_id", "row", "col", "u")
