"""Registered queries against their SQL. STRANDLINE_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA

QUICK = """a1_imagery_scan a5_band_coefficients_xml a7_boundary_json_roundtrip a12_raster_roundtrip a15_unprocessed_scenes
b1_toa_reflectance b2_water_index b9_narrow_types b12_skip_void_tiles b16_search_with_geometry b18_checked_requests c3_daily_by_transect
c4_merge_by_position c5_nearest_label c9_scenes_in_polygons c10_clip_lines c12_interpolation_weights c14_paired_distances c16_shift_scores
d5_day_mosaic d8_nodata_limit d10_otsu_global d12_yen_threshold d13_exact_three_means d22_rmse_by_region e2_half_overlap_tiles
e4_blur_9_sigma_6 e5_open_close_3 e6_window_classification e7_point_labels e8_edges e10_fill_gaps e11_region_segmentation e12_components
e13_polylines i1_utm_zone_3 i2_polar_stereographic i6_upsample_spline j1_scene_intake j2_streamed_daily_means flagship_water_share""".split()
NAMES = list(entry.queries()) if os.environ.get("STRANDLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.execute(sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
