"""Daily series: merging, totals by year, comparisons, station overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import weather

# Days shown on each side of a year change, station rows laid against them.
EDGE_DAYS = 90
STATION_ROWS = (2579, 2759)


def with_position(df: DataFrame, group: str, lead: str, rest: list[str]) -> DataFrame:
    """Row position (from 0) in each group, ordered by (lead, rest).

    Counted in two levels, rows before each lead value plus the rank inside it, so that no
    sort group is larger than the rows of one (group, lead).
    """
    counts = df.groupBy(group, lead).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, lead, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(group, lead).orderBy(*rest)
    ranked = df.withColumn("_rank", F.row_number().over(inner) - 1)
    return ranked.join(offsets, [group, lead]).withColumn("position", F.col("_before") + F.col("_rank")).drop("_before", "_rank")


def merge_by_position(base: DataFrame, extra: DataFrame, column: str, new_name: str, at: int = 9, group: str = "year",
                      lead: str = "date", rest: tuple[str, ...] = ("transect",)) -> DataFrame:
    """base with `column` of extra, matched by row order within each group, inserted at index `at`.

    Both sides must hold the same groups; rows past the end of extra get NULL.
    """
    missing = base.select(group).distinct().exceptAll(extra.select(group).distinct()).limit(1).count()
    if missing or extra.select(group).distinct().exceptAll(base.select(group).distinct()).limit(1).count():
        raise ValueError(f"both tables need the same values of {group}")
    a = with_position(base, group, lead, list(rest))
    b = with_position(extra, group, lead, list(rest)).select(group, "position", F.col(column).alias(new_name))
    columns = [c for c in base.columns if c != group]
    order = [*columns[:at], new_name, *columns[at:], group]
    return a.join(b, [group, "position"], "left").select(*order)


def merge_by_key(base: DataFrame, extra: DataFrame, column: str, new_name: str, at: int = 9,
                 keys: tuple[str, ...] = ("date", "transect")) -> DataFrame:
    """The same by key; equal to the positional form when both sides hold the same keys in the same order."""
    order = [*base.columns[:at], new_name, *base.columns[at:]]
    return base.join(extra.select(*keys, F.col(column).alias(new_name)), list(keys), "left").select(*order)


def yearly_total(daily: DataFrame, value: str, date: str = "date") -> DataFrame:
    """(year, total) in order of year."""
    return daily.groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("total")).orderBy("year")


def annual_mean_celsius(daily: DataFrame, value: str, date: str = "date", keys: tuple[str, ...] = ("transect",)) -> DataFrame:
    """Mean of each year that has every day, in degrees Celsius."""
    days = F.dayofyear(F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    return (
        daily.groupBy(*keys, F.year(date).alias("year"))
        .agg(F.avg(value).alias("mean"), F.count(value).alias("days"))
        .where(F.col("days") == days)
        .select(*keys, "year", weather.kelvin_to_celsius("mean").alias("celsius"))
    )


def in_years(daily: DataFrame, years: list[int], closed: bool = False, date: str = "date") -> DataFrame:
    """Days of the given years; unless closed, December 31 is left out, as the year comparisons do."""
    kept = daily.where(F.year(date).isin(years))
    return kept if closed else kept.where(~((F.month(date) == 12) & (F.day(date) == 31)))


def year_comparison(daily: DataFrame, values: list[str], years: list[int], date: str = "date",
                    keys: tuple[str, ...] = ("transect",)) -> DataFrame:
    """One row a calendar day with a column for each value and year."""
    return (
        in_years(daily, years, date=date)
        .groupBy(*keys, F.date_format(date, "MM-dd").alias("mmdd"))
        .pivot("_year" if "_year" in daily.columns else "year", years)
        .agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])
    )


def transect_comparison(daily: DataFrame, value: str, year: int, transects: list[int], date: str = "date") -> DataFrame:
    """One row a day of the year with a Celsius column for each transect."""
    return (
        in_years(daily, [year], date=date)
        .where(F.col("transect").isin(transects))
        .groupBy(F.date_format(date, "MM-dd").alias("mmdd"))
        .pivot("transect", transects)
        .agg(F.first(weather.kelvin_to_celsius(value), ignorenulls=True))
    )


def year_change(daily: DataFrame, year: int, days: int = EDGE_DAYS, date: str = "date", keys: tuple[str, ...] = ("transect",)) -> DataFrame:
    """Last days of a year and first days of the next, numbered 0 .. 2 * days - 1 in order of time."""
    open_years = in_years(daily, [year, year + 1], date=date)
    first = Window.partitionBy(*keys, F.year(date)).orderBy(date)
    last = Window.partitionBy(*keys, F.year(date)).orderBy(F.desc(date))
    n = F.row_number()
    ranked = open_years.withColumn("_up", n.over(first)).withColumn("_down", n.over(last))
    old = F.when((F.year(date) == year) & (F.col("_down") <= days), days - F.col("_down"))
    new = F.when((F.year(date) == year + 1) & (F.col("_up") <= days), days + F.col("_up") - 1)
    return ranked.withColumn("ordinal", F.coalesce(old, new)).where("ordinal is not null").drop("_up", "_down")


def station_overlay(change: DataFrame, station: DataFrame, rows: tuple[int, int] = STATION_ROWS) -> DataFrame:
    """Days around a year change with the station mean of the row at the same place; station is (seq, tmax, tmin)."""
    cut = station.where((F.col("seq") >= rows[0]) & (F.col("seq") < rows[1]))
    kelvin = weather.daily_mean_kelvin("tmax", "tmin")
    laid = cut.select((F.col("seq") - rows[0]).cast("int").alias("ordinal"), weather.kelvin_to_celsius(kelvin).alias("station_celsius"))
    return change.join(laid, "ordinal", "left")


def station_overlay_by_date(daily: DataFrame, station: DataFrame, date: str = "date") -> DataFrame:
    """The same joined on the date, for stations that carry one."""
    kelvin = weather.daily_mean_kelvin("tmax", "tmin")
    return daily.join(station.select(date, weather.kelvin_to_celsius(kelvin).alias("station_celsius")), date, "left")
