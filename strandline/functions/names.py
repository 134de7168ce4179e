"""Dates and parts carried in file names and scene ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.spectral import col

# Name patterns and id layouts (pattern, characters of the id that hold it).
DAY_IN_NAME = r"(\d{4}-\d{2}-\d{2})"
MONTH_IN_NAME = r"(\d{4}_\d{2})"
ID_LAYOUTS = {"scene": ("yyyyMMdd_HHmmss", 15), "strip": ("yyyy-MM-dd'T'HHmmss", 17)}


def date_in_name(name: Column | str) -> Column:
    """First yyyy-mm-dd in the name, else first yyyy_mm, else NULL."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(col(name), pattern, 1), F.lit(""))

    return F.coalesce(found(DAY_IN_NAME), found(MONTH_IN_NAME))


def id_time(scene_id: Column | str, layout: str = "scene") -> Column:
    """Acquisition time at the start of a scene id; NULL when it does not parse."""
    pattern, length = ID_LAYOUTS[layout]
    return F.try_to_timestamp(F.substring(col(scene_id), 1, length), F.lit(pattern))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dir_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def first_part(path: Column | str) -> Column:
    """File name up to its first dot."""
    return F.split(base_name(path), r"\.")[0]


def extension(path: Column | str) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def staged(path: Column | str, stage: str) -> Column:
    """Name of the output of a stage: <dir>/<first part>_<stage>.tif."""
    return F.concat(dir_name(path), F.lit("/"), first_part(path), F.lit(f"_{stage}.tif"))


def zero_padded(n: Column | str, width: int = 2) -> Column:
    """At least `width` digits; longer numbers are kept whole."""
    text = col(n).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def tile_name(path: Column | str, number: Column, total: Column) -> Column:
    return F.concat(
        stem(path), F.lit("_"), zero_padded(number), F.lit("-of-"), total.cast("string"), extension(path)
    )


def day_text(day: Column | str) -> Column:
    return F.date_format(col(day), "MM-dd-yyyy")


def day_key(day: Column | str, transect: Column | str) -> Column:
    """MM-dd-yyyy_<transect>, the row id of the daily tables."""
    return F.concat_ws("_", day_text(day), col(transect).cast("string"))


def key_tail(transect: Column | str) -> Column:
    """The part of day_key after a day that is there; a null transect adds nothing."""
    return F.coalesce(F.concat(F.lit("_"), col(transect).cast("string")), F.lit(""))
