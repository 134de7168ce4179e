"""File catalogs: which files there are, which to take, which were done already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import names

# Marks in file names.
IMAGE_END = ".tif"
SURFACE_MARK = "_SR_"
OUTPUT_MARK = "output"
EIGHT_BIT_MARK = "8bit"


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "modificationTime")


def imagery(files: DataFrame) -> DataFrame:
    """Surface reflectance images outside output folders, encoded copies left out, in path order."""
    name = names.base_name("path")
    return files.where(
        ~names.dir_name("path").contains(OUTPUT_MARK)
        & name.endswith(IMAGE_END)
        & name.contains(SURFACE_MARK)
        & ~F.col("path").contains(EIGHT_BIT_MARK)
    ).orderBy("path")


def with_exclusions(files: DataFrame, ending: str, marks: list[str]) -> DataFrame:
    """Files with an ending, minus those whose name holds one of the marks."""
    name = names.base_name("path")
    excluded = reduce(lambda a, b: a | b, [name.contains(m) for m in marks], F.lit(False))
    return files.where(name.endswith(ending) & ~excluded)


def minus(files: DataFrame, other: DataFrame) -> DataFrame:
    """Set difference of two file lists."""
    return files.select("path").exceptAll(other.select("path"))


def unprocessed(candidates: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Candidates whose output is not there yet; overwrite takes them all."""
    return candidates if overwrite else candidates.join(done.select(key).distinct(), key, "left_anti")


def reviewed(scenes: DataFrame, review: DataFrame) -> DataFrame:
    """Scenes without those a reviewer rejected; review is (scene_id, keep)."""
    return scenes.join(review.where(~F.col("keep")).select("scene_id").distinct(), "scene_id", "left_anti")
