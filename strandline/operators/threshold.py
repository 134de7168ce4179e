"""Thresholds from histograms.

Everything here works on (keys, bin, n): the pixels are counted first, with map-side
combine, and all later steps see at most 256 rows for each key, whatever the scene size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCENE = ("scene_id",)


def histogram(pixels: DataFrame, code: Column | str, keys: tuple[str, ...] = SCENE) -> DataFrame:
    code = F.col(code) if isinstance(code, str) else code
    return pixels.where(code.isNotNull()).groupBy(*keys, code.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def _running(hist: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts and weighted sums up to each bin, and over all bins, as doubles."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    n, s = F.col("n").cast("double"), F.col("n").cast("double") * F.col("bin")
    return hist.select(
        *keys, "bin", n.alias("n"),
        F.sum(n).over(upto).alias("n1"), F.sum(s).over(upto).alias("s1"), F.sum(n * n).over(upto).alias("q1"),
        F.sum(n).over(every).alias("nt"), F.sum(s).over(every).alias("st"), F.sum(n * n).over(every).alias("qt"),
    )


def otsu(hist: DataFrame, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """Bin with the greatest between-class variance, the lowest on a tie; 0 when all pixels are alike.

    Otsu 1979. An empty bin splits as the bin below it does, so occupied bins suffice.
    """
    gain = (F.col("nt") * F.col("s1") - F.col("n1") * F.col("st")) ** 2 / (F.col("n1") * (F.col("nt") - F.col("n1")))
    split = F.when(F.col("n1") < F.col("nt"), F.struct(gain.alias("gain"), (-F.col("bin")).alias("low")))
    return _running(hist, keys).groupBy(*keys).agg(
        F.coalesce(F.max_by("bin", split), F.lit(0)).cast("int").alias("threshold")
    )


def yen(hist: DataFrame, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """Bin that maximises the correlation criterion (Yen, Chang, Chang 1995), the lowest on a tie."""
    crit = (F.col("n1") * (F.col("nt") - F.col("n1"))) ** 2 / (F.col("q1") * (F.col("qt") - F.col("q1")))
    split = F.when(F.col("n1") < F.col("nt"), F.struct(crit.alias("crit"), (-F.col("bin")).alias("low")))
    return _running(hist, keys).groupBy(*keys).agg(
        F.coalesce(F.max_by("bin", split), F.min("bin")).cast("int").alias("threshold")
    )


def exact_means(hist: DataFrame, k: int = 3, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """Optimal one-dimensional k-means: the k - 1 highest bins of the lower classes, as array `cuts`.

    Classes are intervals of bins, so the best partition follows from a recursion over
    the occupied bins (Wang, Song 2011): no random starts and no rows per cut pair. The
    least within-class spread is the greatest sum of (class sum)^2 / (class count).
    """
    c = F.array_sort(F.collect_list(F.struct("bin", F.col("n1").alias("n"), F.col("s1").alias("s"))))
    table = _running(hist, keys).groupBy(*keys).agg(c.alias("c")).withColumn("m", F.size("c"))
    cell = lambda i: F.get("c", i)

    def spread(n: Column, s: Column) -> Column:
        return s * s / n

    no_cut = F.array().cast("array<int>")
    bad = F.lit(float("-inf"))
    first = F.transform(
        F.col("c"), lambda x: F.struct(spread(x["n"], x["s"]).alias("score"), no_cut.alias("cuts"))
    )

    def add_class(best: Column, _: Column) -> Column:
        def upto(j: Column) -> Column:
            def cut_at(i: Column) -> Column:
                gain = spread(cell(j)["n"] - cell(i)["n"], cell(j)["s"] - cell(i)["s"])
                return F.struct(
                    (F.get(best, i)["score"] + gain).alias("score"),
                    F.concat(F.get(best, i)["cuts"], F.array((-i).cast("int"))).alias("cuts"),
                )

            return F.when(
                j > 0, F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(j - 1, F.lit(0))), cut_at))
            ).otherwise(F.struct(bad.alias("score"), no_cut.alias("cuts")))

        return F.transform(F.sequence(F.lit(0), F.col("m") - 1), upto)

    steps = F.aggregate(F.sequence(F.lit(2), F.lit(k)), first, add_class)
    chosen = F.transform(F.element_at(steps, -1)["cuts"], lambda i: cell(-i)["bin"])
    few = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.get("c", F.least(i, F.col("m") - 1))["bin"])
    return table.select(*keys, F.when(F.col("m") >= k, chosen).otherwise(few).alias("cuts"))


def class_of(code: Column | str, cuts: Column | str, k: int = 3) -> Column:
    """0 for the darkest class; classes are ordered by their centre."""
    code = F.col(code) if isinstance(code, str) else code
    return sum(((code > F.get(cuts, i)).cast("int") for i in range(k - 1)), F.lit(0)).cast("int")


def class_shares(hist: DataFrame, cuts: DataFrame, k: int = 3, keys: tuple[str, ...] = SCENE) -> DataFrame:
    """Pixels and share of each class, empty classes included, and the class in doubt (the smallest, lowest on a tie)."""
    labelled = hist.join(cuts, list(keys)).withColumn("class", class_of("bin", "cuts", k))
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("class") == i, F.col("n"))), F.lit(0)) for i in range(k)])
    wide = labelled.groupBy(*keys).agg(counts.alias("counts"), F.sum("n").alias("total"))
    doubt = F.array_position("counts", F.array_min("counts")) - 1
    return wide.select(*keys, F.posexplode("counts").alias("class", "n"), "total", doubt.cast("int").alias("doubt")).select(
        *keys, "class", "n", (F.col("n") / F.col("total")).alias("share"), "doubt"
    )
