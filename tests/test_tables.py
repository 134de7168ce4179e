import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import names, spectral, weather
from strandline.operators import climate as cl
from strandline.operators import labels as lb
from strandline.operators import scenes as sc
from strandline.operators import series as se
from strandline.session import new_folder, shared_dir
from strandline.sources import catalog as ca
from strandline.sources import metadata as md
from strandline.sources import tables as tb


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_names(spark):
    assert one(spark, "in/2016-09-06_x_2017_05.tif", names.date_in_name("x")) == ("2016-09-06",)
    assert one(spark, "gsw_2017_05.tif", names.date_in_name("x")) == ("2017_05",)
    assert one(spark, "none.tif", names.date_in_name("x")) == (None,)
    assert one(spark, "20160909_213103_0e19", names.id_time("x")) == (dt.datetime(2016, 9, 9, 21, 31, 3),)
    assert one(spark, "bad", names.id_time("x")) == (None,)
    assert one(spark, "2016-09-09T213103", names.id_time("x", "strip")) == (dt.datetime(2016, 9, 9, 21, 31, 3),)
    assert one(spark, "a/b/c.d.tif", names.base_name("x"), names.dir_name("x"), names.stem("x"), names.first_part("x"), names.extension("x")) == ("c.d.tif", "a/b", "c.d", "c", ".tif")
    assert one(spark, "a/t.tif", names.tile_name("x", F.lit(7), F.lit(120)), names.tile_name("x", F.lit(107), F.lit(120))) == ("t_07-of-120.tif", "t_107-of-120.tif")


def test_expressions(spark):
    df = spark.createDataFrame([(0, 0), (300, 100)], "g int, n int")
    assert [tuple(r) for r in df.select(spectral.water_index("g", "n"), spectral.water_index("g", "n", 0.0)).collect()] == [(None, 0.0), (0.5, 0.5)]
    wind = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "u double, v double").select(weather.wind_speed("u", "v"), weather.wind_direction("u", "v")).collect()
    assert wind[0][1] is None and wind[1][0] == 5.0 and wind[1][1] == pytest.approx(-0.6435011)
    wrapped = spark.createDataFrame([(-1.7,), (256.0,), (70000.0,)], "x double").select(spectral.narrow("x", "uint8"), spectral.narrow("x", "uint16")).collect()
    assert [tuple(r) for r in wrapped] == [(255, 65535), (0, 256), (112, 4464)]


def test_search_reaches_the_scan(spark, tables):
    folder = new_folder(spark, "test")
    tables.scenes().select("scene_id", F.col("acquired").cast("timestamp").alias("acquired"), "cloud_cover").write.parquet(folder)
    plan = sc.search(spark.read.parquet(folder), "2024-01-05", "2024-01-09")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(acquired" in plan and "LessThanOrEqual(cloud_cover" in plan


def test_window_scan_prunes_folders(spark, tables):
    from strandline.operators.pixels import pixel_window

    folder = new_folder(spark, "test")
    tb.write_pixels(tables.grid(), folder)
    plan = pixel_window(tb.read_pixels(spark, folder), 0, 0, 10, 10).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_row" in plan and "GreaterThanOrEqual(row,0)" in plan


def test_crop_reaches_the_scan(spark, tables):
    folder = new_folder(spark, "test")
    tb.write_grid(tables.climate(), folder)
    grid = tb.read_grid(spark, folder).where("var = 'tsk' and year = 2005")
    plan = cl.crop(grid, -476545.0, -2517900.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(yi" in plan and "LessThanOrEqual(xi" in plan and "PartitionFilters: [isnotnull(var" in plan


def test_winter_bounds(spark):
    days = [(f"2023{d:%m%d}_000000_x",) for d in (dt.date(2023, 5, 16), dt.date(2023, 5, 17), dt.date(2023, 10, 16), dt.date(2023, 10, 17))] + [("broken",)]
    assert [r.scene_id[:8] for r in sc.outside_winter(spark.createDataFrame(days, "scene_id string")).collect()] == ["20230517", "20231016"]


def test_requests(spark):
    rows = [("2023-08-01", "2023-08-10"), ("2008-01-01", "2010-01-01"), ("2023-02-30", "2023-03-01"), ("2023-08-10", "2023-08-10"), ("x", "2023-08-10")]
    got = sc.checked_requests(spark.createDataFrame(rows, "start_text string, end_text string")).collect()
    assert [r.valid for r in got] == [True, False, False, False, False] and got[2].start is None


def test_first_image_with_data_wins(spark):
    rows = [(1, "b", 0, 0, 7), (1, "a", 0, 0, 0), (1, "c", 0, 0, 9), (1, "a", 0, 1, 5), (1, "c", 0, 2, 0)]
    got = sc.mosaic(spark.createDataFrame(rows, "day int, path string, wy int, wx int, b int"), ["b"], ["day"])
    assert {(r.wx, r.b) for r in got.collect()} == {(0, 7), (1, 5), (2, 0)}


def test_files_are_listed_and_left_out(spark):
    folder = new_folder(spark, "test")
    spark.range(2).write.parquet(f"{folder}/a")
    listed = ca.list_files(spark, folder, "*.parquet")
    assert listed.count() >= 1 and ca.unprocessed(listed, listed, "path").count() == 0
    assert ca.unprocessed(listed, listed, "path", overwrite=True).count() == listed.count()


def test_broken_boundary_gives_no_row(spark):
    folder = new_folder(spark, "test")
    good = '{"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]}'
    spark.createDataFrame([("good", good), ("bad", "{nothing")], "k string, value string").write.partitionBy("k").text(folder)
    assert md.read_boundaries(spark, f"{folder}/k=*").count() == 4


def test_labels_on_a_tie_and_outside(spark):
    d = dt.date
    inputs = spark.createDataFrame([(d(2016, 1, 10),), (d(2016, 1, 20),), (d(2000, 1, 1),), (d(2020, 1, 1),)], "input_date date")
    labels = spark.createDataFrame([(d(2016, 1, 15), "a"), (d(2016, 1, 15), "b"), (d(2016, 1, 25), "c")], "label_date date, label string")
    got = {r.input_date: r.label for r in lb.nearest_label(inputs, labels).collect()}
    assert got == {d(2016, 1, 10): "b", d(2016, 1, 20): "b", d(2000, 1, 1): "b", d(2020, 1, 1): "c"}


def test_daily_means_drop_the_tail(spark):
    rows = [("t", 2005, h, 0, 0, float(h)) for h in range(50)]
    got = cl.daily_means(spark.createDataFrame(rows, "var string, year int, hour int, yi int, xi int, value double")).orderBy("day").collect()
    assert [(r.day, r.value) for r in got] == [(0, 11.5), (1, 35.5)]


def test_weights_sum_to_one_and_reproduce_a_plane(spark, tables):
    from strandline.functions.projection import REGION_CENTER, stereo_point

    x, y = stereo_point(REGION_CENTER[1], REGION_CENTER[0])
    pos = cl.cell_positions(cl.crop(tables.climate(), x, y))
    w = cl.interpolation_weights(tables.stations_at(), pos)
    plane = w.join(pos, "k").groupBy("transect").agg(F.sum("w").alias("s"), F.sum(F.col("w") * (F.col("x") * 2 - F.col("y"))).alias("v"))
    off = plane.join(tables.stations_at(), "transect").where((F.abs(F.col("s") - 1) > 1e-9) | (F.abs(F.col("v") - (F.col("lat") * 2 - F.col("lon"))) > 1e-6))
    assert plane.count() > 0 and off.count() == 0


def test_spine_covers_leap_years(spark):
    s = cl.spine(spark.createDataFrame([(1,), (2,)], "transect int"), spark.createDataFrame([(2004,), (2005,), (2005,)], "year int"))
    assert s.count() == 2 * (366 + 365) and s.distinct().count() == s.count()


def test_merge_needs_the_same_years(spark):
    a = spark.createDataFrame([(dt.date(2000, 1, 1), 1, 2000, 5.0)], "date date, transect int, year int, t2 double")
    with pytest.raises(ValueError):
        se.merge_by_position(a, a.withColumn("year", F.lit(2001)), "t2", "t2z", at=2)


def test_years_with_a_missing_day_are_dropped(spark):
    days = spark.range(0, 731).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(1).alias("transect"), F.lit(280.1).alias("tsk"))
    got = se.annual_mean_celsius(days.where("date <> '2001-06-01'"), "tsk").collect()
    assert [(r.year, round(r.celsius, 6)) for r in got] == [(2000, 7.0)]


def test_grid_without_files_is_empty(spark):
    assert tb.read_grid(spark, shared_dir(spark) + "/absent").count() == 0


class NoFolder:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})


def test_work_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    assert shared_dir(NoFolder("local[2]")) == shared_dir(NoFolder("local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(NoFolder("yarn"))


def test_spine_work_is_dealt_over_the_tasks(spark):
    """Stations of one task unfold to their days in many; ids as names.day_key makes them, also of a null and a repeated station."""
    from strandline.functions.names import day_key

    points = spark.createDataFrame([(i if i else None,) for i in [*range(200), 7]], "transect int").coalesce(1)
    s = cl.spine(points, spark.createDataFrame([(2004,), (2005,), (None,)], "year int"))
    parts = s.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 201 * 731
    assert len(parts) > 1 and max(r["count"] for r in parts) < 201 * 731 / 2
    assert s.where((F.col("id") != day_key("date", "transect")) | (F.col("day") != F.col("date").cast("string"))).count() == 0


def test_blocks_and_groups_stay_bounded():
    """A block and a group have a bounded size, every task has a pair, and the rows shuffled stay far below rows times years."""
    for rows, years, tasks in ((0, 0, 4), (1, 1, 200), (100, 3, 8), (1000, 214, 12), (60000, 425, 100), (360000, 2550, 600), (5, 4000, 100)):
        blocks, groups = cl._dealt(rows, years, tasks)
        assert rows <= blocks * cl.BLOCK_ROWS and years <= groups * cl.GROUP_YEARS
        assert blocks <= max(rows, 1) and groups <= max(years, 1)
        assert blocks * groups >= min(tasks, max(rows, 1) * max(years, 1))
    blocks, groups = cl._dealt(60000, 425, 100)
    assert 60000 * groups + 425 * 366 * blocks < 60000 * 425 / 4


def test_rows_of_a_day_lie_together(spark, tmp_path):
    """Stations follow one another within a day, so files of the result hold a date once a run; no rows or no years give none."""
    points = spark.createDataFrame([(i,) for i in [*range(1500), 7, None]], "transect int")
    s = cl.spine(points, spark.createDataFrame([(2004,), (2005,), (2005,)], "year int"))
    s.write.parquet(f"{tmp_path}/spine")
    assert s.count() == 1502 * 731
    assert s.where("transect = 7").count() == 2 * 731 and s.where("transect is null").count() == 731
    at = F.monotonically_increasing_id()
    turns = spark.read.parquet(f"{tmp_path}/spine").coalesce(1).select("date", at.alias("n")).withColumn("d", F.lag("date").over(Window.orderBy("n")))
    assert turns.where("date <> d").count() < 1502 * 731 / 100
    assert cl.spine(points.limit(0), spark.createDataFrame([(2004,)], "year int")).count() == 0
    assert cl.spine(points, spark.createDataFrame([], "year int")).count() == 0


def test_half_up_equals_round(spark):
    from strandline.functions.rounding import half_up

    odd = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 5e-324, -1e-7, 5e-6, -5e-6, 1.000005, -2.5e-5, 123456.789015, 1e11 + 5e-6]
    ties = [k * 5e-6 for k in range(-3001, 3001, 7)] + [100000 + k * 5e-6 for k in range(1, 900, 2)]
    df = spark.createDataFrame([(v,) for v in odd + ties], "v double")
    for digits in (5, 6):
        assert df.where(~F.round("v", digits).cast("string").eqNullSafe(half_up("v", digits).cast("string"))).count() == 0
    plan = df.select(half_up("v", 5).alias("v"))
    assert plan.where("v is null").count() == 1


def test_values_at_transects_take_little_room(spark, tmp_path):
    """Days without reading are 0, a missing cell gives NULL; values of many days and stations are written in few bytes."""
    from strandline.plans.climate import at_transects

    cells = lambda a, gap=None: [None if k == gap else a + k for k in range(9)]
    none = [None] * (len(cl.VARIABLES) - 2)
    vectors = spark.createDataFrame([(dt.date(2004, 1, d), cells(1.0 + d, 4 if d == 2 else None), cells(0.5) if d > 1 else None, *none) for d in (1, 2, 3)],
                                    "date date, " + ", ".join(f"{v} array<double>" for v in cl.VARIABLES))
    points = spark.createDataFrame([(i,) for i in range(2000)], "transect int")
    weights = points.where("transect > 0").select("transect", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(w) + F.col("transect") * (c * 1e-4)).alias("w")) for k, w, c in ((0, 0.5, 1), (1, 0.25, -1), (4, 0.25, 0))])).alias("s")).select("transect", "s.*")
    out = at_transects(vectors, points, spark.createDataFrame([(2004,), (2005,)], "year int"), weights).drop("id")
    out.write.parquet(f"{tmp_path}/values")
    got = spark.read.parquet(f"{tmp_path}/values")
    assert got.count() == 2000 * 731
    first, second, later = (got.where(F.col("date") == F.lit(d)) for d in ("2004-01-01", "2004-01-02", "2005-03-01"))
    assert first.where("transect = 0 and tsk is null and u10 = 0").count() == 1 and second.where("tsk is null").count() == 2000
    assert first.where("transect > 0 and abs(tsk - (0.5 * 2 + 0.25 * 3 + 0.25 * 6 + transect * 1e-4 * (2 - 3))) < 1e-9 and u10 = 0").count() == 1999
    assert second.where("transect > 0 and u10 is not null").count() == 1999 and later.where("tsk = 0 and u10 = 0 and t2 = 0").count() == 2000
    assert sum(f.stat().st_size for f in (tmp_path / "values").glob("*.parquet")) < 2000 * 731 * 0.3
