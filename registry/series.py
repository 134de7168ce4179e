"""Daily series: merges, unions, totals, comparisons, station overlay, CSV files."""

from pyspark.sql import functions as F

from registry import query
from strandline.operators import series as se
from strandline.session import new_folder
from strandline.sources import tables as tb

LINES = """lines as (select l_shipdate::date d, l_linenumber transect, avg(l_quantity) + 250 tsk, round(avg(l_discount) - 0.05::double, 9) + 0.0::double u10, sum(l_extendedprice) / 1000 seaice,
    min(l_quantity) t2 from lineitem group by 1, 2)"""
STATION = """station as (select (row_number() over (order by d) - 1)::bigint seq, d, tmax, tmin from
    (select o_orderdate::date d, max(o_totalprice) / 10000 tmax, min(o_totalprice) / 10000 tmin from orders group by 1))"""


def lines(t):
    """Daily series of seven places, with a row for nearly every day."""
    return t.raw("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("transect")).agg(
        (F.avg("l_quantity") + 250).alias("tsk"), (F.round(F.avg("l_discount") - 0.05, 9) + 0.0).alias("u10"),
        (F.sum("l_extendedprice") / 1000).alias("seaice"), F.min("l_quantity").alias("t2"))


def station(t):
    day = t.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.max("o_totalprice") / 10000).alias("tmax"), (F.min("o_totalprice") / 10000).alias("tmin"))
    keyed = day.withColumn("all", F.lit(0)).withColumn("year", F.year("date"))
    return se.with_position(keyed, "all", "year", ["date"]).select(F.col("position").alias("seq"), "date", "tmax", "tmin")


@query("d6_yearly_sea_ice", f"""with {LINES} select year(d)::int "year", round(sum(seaice), 4) total from lines group by 1""")
def _(t):
    return se.yearly_total(lines(t), "seaice").withColumn("total", F.round("total", 4))


@query("d7_annual_mean_temperature", """select transect, year(d)::int "year", round(avg(tsk) - 273.1::double, 7) celsius from
    (select l_shipdate::date d, ascii(l_returnflag)::int transect, avg(l_quantity) + 250 tsk from lineitem group by 1, 2) group by 1, 2
    having count(*) = any_value(dayofyear(make_date(year(d)::bigint, 12, 31)))""")
def _(t):
    daily = t.raw("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.ascii("l_returnflag").alias("transect")).agg(
        (F.avg("l_quantity") + 250).alias("tsk"))
    return se.annual_mean_celsius(daily, "tsk").withColumn("celsius", F.round("celsius", 7))


@query("d7_annual_mean_one_series", """select 0::int transect, year(d)::int "year", round(avg(tsk) - 273.1::double, 7) celsius from
    (select l_shipdate::date d, avg(l_quantity) + 250 tsk from lineitem group by 1) group by 2 having count(*) = any_value(dayofyear(make_date(year(d)::bigint, 12, 31)))""")
def _(t):
    day = t.raw("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.avg("l_quantity") + 250).alias("tsk"))
    return se.annual_mean_celsius(day.withColumn("transect", F.lit(0)), "tsk").withColumn("celsius", F.round("celsius", 7))


@query("c4_merge_by_position", f"""with {LINES}, a as (select *, row_number() over (partition by year(d) order by d, transect) p from lines),
    b as (select year(d) y, t2, row_number() over (partition by year(d) order by d, transect) p from lines where tsk > 265)
    select d::varchar "date", a.transect, round(tsk, 9) tsk, b.t2 t2z, year(d)::int "year" from a left join b on year(a.d) = b.y and a.p = b.p""")
def _(t):
    base = lines(t).select("date", "transect", "tsk").withColumn("year", F.year("date"))
    extra = lines(t).where("tsk > 265").select("date", "transect", "t2").withColumn("year", F.year("date"))
    m = se.merge_by_position(base, extra, "t2", "t2z", at=3)
    return m.withColumn("date", F.col("date").cast("string")).withColumn("tsk", F.round("tsk", 9))


@query("c4_merge_by_key", f"""with {LINES} select d::varchar "date", a.transect, round(a.tsk, 9) tsk, b.t2 t2z from lines a left join (select d, transect, t2 from lines where tsk > 265) b using (d, transect)""")
def _(t):
    m = se.merge_by_key(lines(t).select("date", "transect", "tsk"), lines(t).where("tsk > 265"), "t2", "t2z", at=3)
    return m.withColumn("date", F.col("date").cast("string")).withColumn("tsk", F.round("tsk", 9))


@query("g1_union_of_years", f"""with {LINES} select d::varchar "date", transect, round(tsk, 9) tsk, case when year(d) < 1998 then t2 end t2z, case when year(d) >= 1998 then u10 end u10 from lines""")
def _(t):
    early = lines(t).where(F.year("date") < 1998).select("date", "transect", "tsk", F.col("t2").alias("t2z"))
    late = lines(t).where(F.year("date") >= 1998).select("date", "transect", "u10", "tsk")
    return tb.union_years([early, late]).withColumn("date", F.col("date").cast("string")).withColumn("tsk", F.round("tsk", 9))


@query("d24_year_comparison", f"""with {LINES} select transect, strftime(d, '%m-%d') mmdd, """ + ", ".join(
    f'round(max(case when year(d) = {y} then {v} end), 7) "{y}_{v}"' for y in (1996, 1997, 1998) for v in ("tsk", "u10", "seaice")
) + """ from lines where year(d) in (1996, 1997, 1998) and strftime(d, '%m-%d') <> '12-31' group by 1, 2""")
def _(t):
    wide = se.year_comparison(lines(t).withColumn("year", F.year("date")), ["tsk", "u10", "seaice"], [1996, 1997, 1998])
    return wide.select("transect", "mmdd", *[F.round(c, 7).alias(c) for c in wide.columns[2:]])


@query("d24_transect_comparison", f"""with {LINES} select strftime(d, '%m-%d') mmdd, """ + ", ".join(
    f'round(max(case when transect = {k} then tsk end) - 273.1::double, 7) "{k}"' for k in range(1, 7)
) + """ from lines where year(d) = 1997 and transect between 1 and 6 and strftime(d, '%m-%d') <> '12-31' group by 1""")
def _(t):
    wide = se.transect_comparison(lines(t), "tsk", 1997, list(range(1, 7)))
    return wide.select("mmdd", *[F.round(c, 7).alias(c) for c in wide.columns[1:]])


CHANGE = """change as (select transect, d, tsk, case when year(d) = 1997 then 90 - dn else 90 + up - 1 end::int ordinal from
    (select *, row_number() over (partition by transect, year(d) order by d) up, row_number() over (partition by transect, year(d) order by d desc) dn
     from lines where year(d) in (1997, 1998) and strftime(d, '%m-%d') <> '12-31') where case when year(d) = 1997 then dn <= 90 else up <= 90 end)"""


@query("f3_year_change_slices", f"""with {LINES}, {CHANGE} select transect, d::varchar "date", ordinal from change""")
def _(t):
    return se.year_change(lines(t), 1997).select("transect", F.col("date").cast("string").alias("date"), "ordinal")


@query("f4_open_and_closed_ranges", f"""with {LINES} select transect, count(*) closed_days, sum((strftime(d, '%m-%d') <> '12-31')::int)::bigint open_days from lines where year(d) in (1996, 1999) group by 1""")
def _(t):
    closed = se.in_years(lines(t), [1996, 1999], closed=True).groupBy("transect").agg(F.count("*").alias("closed_days"))
    opened = se.in_years(lines(t), [1996, 1999]).groupBy("transect").agg(F.count("*").alias("open_days"))
    return closed.join(opened, "transect")


@query("c15_station_by_ordinal", f"""with {LINES}, {CHANGE}, {STATION} select transect, c.d::varchar "date", ordinal, round(c.tsk - 273.1::double, 7) celsius,
    round(((tmax + tmin) / 2 + 459.67::double) * 5 / 9 - 273.1::double, 7) station_celsius from change c left join station s on s.seq - 1000 = ordinal and s.seq >= 1000 and s.seq < 1180""")
def _(t):
    from strandline.functions.weather import kelvin_to_celsius

    laid = se.station_overlay(se.year_change(lines(t), 1997), station(t), rows=(1000, 1180))
    return laid.select("transect", F.col("date").cast("string").alias("date"), "ordinal", F.round(kelvin_to_celsius("tsk"), 7).alias("celsius"),
                       F.round("station_celsius", 7).alias("station_celsius"))


@query("c15_station_by_date", f"""with {LINES}, {STATION} select transect, d::varchar "date", round(((tmax + tmin) / 2 + 459.67::double) * 5 / 9 - 273.1::double, 7) station_celsius from lines left join station using (d)""")
def _(t):
    laid = se.station_overlay_by_date(lines(t), station(t))
    return laid.select("transect", F.col("date").cast("string").alias("date"), F.round("station_celsius", 7).alias("station_celsius"))


@query("f1_sorted_years", f"""with {LINES} select year(d)::int "year", count(*) n from lines group by 1 order by 1""")
def _(t):
    return lines(t).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@query("f2_arg_extremes", f"""with {LINES} select transect, arg_min(d, {{'a': tsk, 'b': d}})::varchar coldest, arg_max(d, {{'a': tsk, 'b': d}})::varchar warmest from lines group by 1""")
def _(t):
    order = F.struct("tsk", "date")
    return lines(t).groupBy("transect").agg(F.min_by("date", order).cast("string").alias("coldest"), F.max_by("date", order).cast("string").alias("warmest"))


@query("b13_single_transect", f"""with {LINES} select d::varchar "date", round(tsk, 9) tsk from lines where transect = 3""")
def _(t):
    return lines(t).where("transect = 3").select(F.col("date").cast("string").alias("date"), F.round("tsk", 9).alias("tsk"))


CSV_SCHEMA = "_c0 bigint, date string, transect int, tsk double, seaice double"


@query("a10_csv_scan", f"""with {LINES} select strftime(d, '%m-%d-%Y') "date", transect, round(tsk, 6) tsk, round(seaice, 6) seaice from lines""")
def _(t):
    folder = new_folder(t.spark, "csv")
    rows = lines(t).select(F.lit(0).alias("_c0"), F.date_format("date", "MM-dd-yyyy").alias("date"), "transect", "tsk", "seaice")
    rows.write.option("header", "true").csv(folder)
    back = tb.read_daily_csv(t.spark, folder, schema=CSV_SCHEMA)
    return back.select("date", "transect", F.round("tsk", 6).alias("tsk"), F.round("seaice", 6).alias("seaice"))


@query("a11_csv_by_year", f"""with {LINES} select year(d)::int "year", count(*) n, round(sum(tsk), 4) tsk from lines group by 1""")
def _(t):
    folder = new_folder(t.spark, "csv")
    tb.write_daily_csv(lines(t).withColumn("year", F.year("date")), folder)
    back = t.spark.read.schema("date date, transect int, tsk double, u10 double, seaice double, t2 double, year int").option("header", "true").csv(folder)
    return back.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("tsk"), 4).alias("tsk"))


@query("a14_tolerant_input", f"""with {LINES} select year(d)::int "year", count(*) n from lines where year(d) not in (1997, 1999) group by 1""")
def _(t):
    folder = new_folder(t.spark, "csv")
    rows = lines(t).select(F.lit(0).alias("_c0"), F.date_format("date", "MM-dd-yyyy").alias("date"), "transect", "tsk", "seaice", F.year("date").alias("year"))
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    rows.where(~F.col("year").isin(1997, 1999)).write.partitionBy("year").option("header", "true").csv(folder)
    back = tb.read_daily_csv(t.spark, *[f"{folder}/year={y}" for y in range(first, last + 1)], schema=CSV_SCHEMA)
    return back.groupBy(F.right("date", F.lit(4)).cast("int").alias("year")).agg(F.count("*").alias("n"))
