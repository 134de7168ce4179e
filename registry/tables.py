"""The data model tables as Spark reads them from the given Parquet files, with SQL twins.

Every table here covers its whole source table. The SQL twins are used by the oracle
only: with_tables() puts the ones a statement mentions in front of it as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raster geometry of the tables below: fixed values.
SCENE_ROWS = 250
GRID_COLS = 64
BAND_COLS = 16
PIXEL = 3.0
ORIGIN_X = 600000.0
ORIGIN_Y = 7330000.0
SCENE_STEP = 1000.0


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _elements(self) -> DataFrame:
        return self.raw("embeddings").select(
            (F.expr("vec_id div 250")).cast("int").alias("scene_id"),
            (F.col("vec_id") % SCENE_ROWS).cast("int").alias("row"),
            F.transform("embedding", lambda x: x.cast("double")).alias("e"),
        )

    def grid(self) -> DataFrame:
        """One plane of index-like values, 250 x 64 pixels a scene."""
        return self._elements().select("scene_id", "row", F.posexplode("e").alias("col", "v"))

    def bands4(self) -> DataFrame:
        """Four integer bands, 250 x 16 pixels a scene."""
        e = self._elements()
        cols = F.explode(F.sequence(F.lit(0), F.lit(BAND_COLS - 1)))
        return e.select("scene_id", "row", "e", cols.alias("col")).select(
            "scene_id", "row", "col",
            *[
                F.floor((F.get("e", F.col("col") + BAND_COLS * k) + 1) * 5000).cast("int").alias(f"b{k + 1}")
                for k in range(4)
            ],
        )

    def chips(self) -> DataFrame:
        """Many 8 x 8 scenes."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("scene_id"),
            F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "v"),
        ).select(
            "scene_id", F.expr("cast(i div 8 as int)").alias("row"),
            (F.col("i") % 8).cast("int").alias("col"), "v",
        )

    def coeffs(self) -> DataFrame:
        """Band coefficients of each scene, derived from the label of its rows."""
        return (
            self.raw("embeddings")
            .groupBy(F.expr("vec_id div 250").cast("int").alias("scene_id"))
            .agg(F.avg(F.col("label").cast("double")).alias("m"))
            .select("scene_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("band"), "m")
            .select("scene_id", "band", ((F.col("band") + F.round("m", 3)) * 1e-5).alias("coeff"))
        )

    def scenes(self) -> DataFrame:
        """Scene list: id with its time, cloud cover, path and centre."""
        scene = F.concat(
            F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("user_id").cast("string"), 4, "0")
        )
        tail = (
            F.when(F.col("value") < 50, "_3B_AnalyticMS_SR_clip.tif")
            .when(F.col("value") < 100, "_3B_AnalyticMS_SR_8bit.tif")
            .when(F.col("value") < 150, "_3B_udm_clip.tif")
            .otherwise("_3B_AnalyticMS_SR.xml")
        )
        folder = F.when(F.col("event_type") == "error", "data/output/").otherwise("data/input/")
        return self.raw("events").select(
            "event_id", scene.alias("scene_id"), F.col("ts").alias("acquired"),
            (F.col("value") / 1000).alias("cloud_cover"), F.col("event_type"), F.col("user_id"),
            F.concat(folder, scene, tail).alias("path"),
            (F.lit(-162.85) + (F.col("user_id") % 40) * 0.005).alias("lon"),
            (F.lit(66.05) + (F.col("event_id") % 35) * 0.002).alias("lat"),
        )

    def climate(self) -> DataFrame:
        """Hourly grid of six variables, 8 x 8 cells, 240 hours a year, the last year cut short."""
        e = self.raw("embeddings").select(
            F.expr("cast(2005 + vec_id div 240 as int)").alias("year"),
            (F.col("vec_id") % 240).cast("int").alias("hour"),
            F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"),
        )
        variables = F.array(
            *[
                F.struct(F.lit(n).alias("var"), (F.lit(a) + F.lit(b) * F.col("x")).alias("value"))
                for n, (a, b) in CLIMATE_SCALE.items()
            ]
        )
        return e.select(
            "year", "hour",
            F.expr("cast(i div 8 as int)").alias("yi"), (F.col("i") % 8).cast("int").alias("xi"),
            F.inline(variables),
        ).select(
            "var", "year", "hour", "yi", "xi",
            (F.lit(CELL_Y0) + F.col("yi") * CELL_SIZE).alias("yc"),
            (F.lit(CELL_X0) + F.col("xi") * CELL_SIZE).alias("xc"), "value",
        )

    def stations_at(self) -> DataFrame:
        """Transect points (id, lat, lon) around the region centre; the outer ones leave the 3 x 3 hull."""
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("transect"),
            (F.lit(66.0756) + (F.col("s_suppkey") % 7 - 3) * 0.05).alias("lat"),
            (F.lit(-162.7172) + (F.col("s_suppkey") % 11 - 5) * 0.09).alias("lon"),
        )

    def transect_daily(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_shipdate").cast("date").alias("d"), F.col("l_suppkey").alias("transect"))
            .agg(
                F.avg("l_quantity").alias("tsk"),
                (F.round(F.avg("l_discount") - 0.05, 9) + 0.0).alias("u10"),
                (F.round(F.avg("l_tax") - 0.04, 9) + 0.0).alias("v10"),
                F.sum("l_extendedprice").alias("seaice"),
                F.avg("l_extendedprice").alias("psfc"),
                F.avg(F.col("l_quantity") * 2).alias("t2"),
            )
        )

    def label_pixels(self) -> DataFrame:
        """Monthly label images: one row a pixel, value 0 means no data."""
        return self.raw("orders").select(
            F.date_format("o_orderdate", "yyyy_MM").alias("image_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("time_start"),
            F.col("o_orderkey").alias("pixel_id"),
            (F.col("o_orderkey") % 3).cast("int").alias("value"),
            (F.lit(-162.85) + (F.col("o_custkey") % 200) * 0.001).alias("lon"),
            (F.lit(66.04) + (F.col("o_orderkey") % 80) * 0.001).alias("lat"),
        )

    def transects(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("transect_id"), (k * 10.0).alias("x0"), F.lit(0.0).alias("y0"),
            (k * 10.0 + (k % 7 - 3) * 2.0).alias("x1"), F.lit(100.0).alias("y1"),
            F.col("s_nationkey").alias("baseline_id"),
        )

    def coast_vertices(self, predicted: bool) -> DataFrame:
        k = F.col("c_custkey")
        fold = 30 if predicted else 20
        shift = F.col("c_nationkey") * 0.05 if predicted else F.lit(0.0)
        return self.raw("customer").select(
            F.lit(1).alias("feature_id"), k.alias("seq"),
            (k * 0.7 - F.when(k % fold == 0, 4.0).otherwise(0.0)).alias("x"),
            (F.lit(50.0) + 20.0 * F.sin(k / 50.0) + (k % 5) * 3.0 + shift).alias("y"),
        )

    def buffer_points(self) -> DataFrame:
        """Points in world coordinates of the grid scenes."""
        k = F.col("s_suppkey")
        scene = F.expr("cast(s_suppkey div 50 as int)")
        return self.raw("supplier").select(
            k.alias("point_id"), scene.alias("scene_id"),
            (F.lit(ORIGIN_X) + scene * SCENE_STEP + ((k * 29) % 64 + 0.5) * PIXEL).alias("x"),
            (F.lit(ORIGIN_Y) - ((k * 37) % 250 + 0.5) * PIXEL).alias("y"),
        )

    def ring(self) -> DataFrame:
        """Closed boundary polygons, one for each region, around a common centre."""
        return self.raw("region").select(
            F.col("r_regionkey").alias("poly_id"),
            F.posexplode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in RING])),
        ).select(
            "poly_id", F.col("pos").alias("seq"),
            (F.lit(-162.75) + F.col("col.dx") * (1 + F.col("poly_id") * 0.25)).alias("x"),
            (F.lit(66.08) + F.col("col.dy") * (1 + F.col("poly_id") * 0.25)).alias("y"),
        )


# Fixed values of the derived climate grid: offset and factor of each variable, cell geometry.
CLIMATE_SCALE = {
    "tsk": (270.0, 20.0), "u10": (0.5, 10.0), "v10": (-0.5, 8.0),
    "seaice": (0.5, 0.5), "psfc": (100000.0, 1000.0), "t2": (268.0, 18.0),
}
CELL_X0, CELL_Y0, CELL_SIZE = -560000.0, -2630000.0, 20000.0

# Offsets of the boundary ring, closed: fixed values.
RING = [(-0.04, -0.012), (0.03, -0.015), (0.035, 0.004), (0.0, 0.02), (-0.01, 0.006), (-0.045, 0.011), (-0.04, -0.012)]


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"(values {body}) t({names})"


SQL_TABLES = {
    "elements": """select (vec_id // 250)::int scene_id, (vec_id % 250)::int "row", embedding e from embeddings""",
    "grid": """select scene_id, "row", i::int col, e[i+1]::double v from elements, range(64) r(i)""",
    "bands4": """select scene_id, "row", i::int col, """
    + ", ".join(f"floor((e[{16 * k}+i+1]::double + 1) * 5000)::int b{k + 1}" for k in range(4))
    + " from elements, range(16) r(i)",
    "chips": """select vec_id scene_id, (i // 8)::int "row", (i % 8)::int col, embedding[i+1]::double v
                from embeddings, range(64) r(i)""",
    "coeffs": """select scene_id, b::int band, (b + round(m, 3)) * 1e-5::double coeff from
                 (select (vec_id // 250)::int scene_id, avg(label::double) m from embeddings group by 1), range(1, 5) r(b)""",
    "scenes": """select event_id, sid scene_id, ts acquired, value / 1000 cloud_cover, event_type, user_id,
        (case when event_type = 'error' then 'data/output/' else 'data/input/' end) || sid ||
        (case when value < 50 then '_3B_AnalyticMS_SR_clip.tif' when value < 100 then '_3B_AnalyticMS_SR_8bit.tif'
              when value < 150 then '_3B_udm_clip.tif' else '_3B_AnalyticMS_SR.xml' end) path,
        -162.85::double + (user_id % 40) * 0.005::double lon, 66.05::double + (event_id % 35) * 0.002::double lat
        from (select *, strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(user_id::varchar, 4, '0') sid from events)""",
    "climate": f"""select var, (2005 + vec_id // 240)::int "year", (vec_id % 240)::int "hour", (i // 8)::int yi, (i % 8)::int xi,
        {CELL_Y0}::double + (i // 8) * {CELL_SIZE}::double yc, {CELL_X0}::double + (i % 8) * {CELL_SIZE}::double xc,
        a::double + b::double * embedding[i+1]::double "value"
        from embeddings, range(64) r(i), {_values([(n, a, b) for n, (a, b) in CLIMATE_SCALE.items()], "var, a, b")}""",
    "stations_at": """select s_suppkey transect, 66.0756::double + (s_suppkey % 7 - 3) * 0.05::double lat,
        -162.7172::double + (s_suppkey % 11 - 5) * 0.09::double lon from supplier""",
    "transect_daily": """select l_shipdate::date d, l_suppkey transect, avg(l_quantity) tsk, round(avg(l_discount) - 0.05::double, 9) + 0.0::double u10,
        round(avg(l_tax) - 0.04::double, 9) + 0.0::double v10, sum(l_extendedprice) seaice, avg(l_extendedprice) psfc, avg(l_quantity * 2) t2
        from lineitem group by 1, 2""",
    "label_pixels": """select strftime(o_orderdate, '%Y_%m') image_id, date_trunc('month', o_orderdate)::date time_start,
        o_orderkey pixel_id, (o_orderkey % 3)::int "value", -162.85::double + (o_custkey % 200) * 0.001::double lon,
        66.04::double + (o_orderkey % 80) * 0.001::double lat from orders""",
    "transects": """select s_suppkey transect_id, s_suppkey * 10.0::double x0, 0.0::double y0,
        s_suppkey * 10.0::double + (s_suppkey % 7 - 3) * 2.0::double x1, 100.0::double y1, s_nationkey baseline_id from supplier""",
    "coast_true": """select 1 feature_id, c_custkey seq,
        c_custkey * 0.7::double - (case when c_custkey % 20 = 0 then 4.0::double else 0.0::double end) x,
        50.0::double + 20.0::double * sin(c_custkey / 50.0::double) + (c_custkey % 5) * 3.0::double + 0.0::double y from customer""",
    "coast_pred": """select 1 feature_id, c_custkey seq,
        c_custkey * 0.7::double - (case when c_custkey % 30 = 0 then 4.0::double else 0.0::double end) x,
        50.0::double + 20.0::double * sin(c_custkey / 50.0::double) + (c_custkey % 5) * 3.0::double + c_nationkey * 0.05::double y
        from customer""",
    "buffer_points": f"""select s_suppkey point_id, (s_suppkey // 50)::int scene_id,
        {ORIGIN_X}::double + (s_suppkey // 50) * {SCENE_STEP}::double + ((s_suppkey * 29) % 64 + 0.5::double) * {PIXEL}::double x,
        {ORIGIN_Y}::double - ((s_suppkey * 37) % 250 + 0.5::double) * {PIXEL}::double y from supplier""",
    "ring": f"""select r_regionkey poly_id, k::int seq, -162.75::double + dx::double * (1 + r_regionkey * 0.25::double) x,
        66.08::double + dy::double * (1 + r_regionkey * 0.25::double) y
        from region, {_values([(i, x, y) for i, (x, y) in enumerate(RING)], "k, dx, dy")}""",
}


def with_tables(sql: str) -> str:
    """Put the CTEs that sql mentions (and those they mention) in front of it."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in SQL_TABLES and name not in wanted:
                visit(SQL_TABLES[name])
                wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} as ({SQL_TABLES[n]})" for n in wanted)
    body = sql.strip()
    if re.match(r"with\s+recursive\s", body, re.I):
        return f"with recursive {ctes},\n{body.split('recursive', 1)[1].lstrip()}"
    if re.match(r"with\s", body, re.I):
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"
