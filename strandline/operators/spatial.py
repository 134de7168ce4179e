"""Segments, points and rings: joins by grid cell with an exact test on the coordinates.

Tables: vertices (feature_id, part, seq, x, y), segments (id..., x0, y0, x1, y1),
points (id..., x, y), rings (poly_id, ring, seq, x, y). Every join is an equi-join on
cells, so it hashes or broadcasts as Catalyst sees fit, and adaptive execution splits a
crowded cell. A pair that shares several cells is taken in one of them only, which
spares a DISTINCT over the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import settled, spread

# Distance under which a point lies on a transect; digits that make points equal.
EPSILON = 2.0**-16
POINT_DIGITS = 9
CHUNK = 4096


def segments(vertices: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Consecutive vertices of each line as segments (keys..., seg, x0, y0, x1, y1).

    Missing numbers in seq are bridged, wherever they lie. Lines are cut into chunks, so a line with
    very many vertices does not become one sort group; a chunk also gets the first vertex of the next
    chunk that has any.
    """
    placed = vertices.select(*keys, "seq", "x", "y", F.floor(F.col("seq") / chunk).alias("_chunk"))
    heads = placed.groupBy(*keys, "_chunk").agg(F.min(F.struct("seq", "x", "y")).alias("_head"))
    before = F.lag("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
    ends = heads.withColumn("_chunk", before).where("_chunk is not null").select(*keys, "_head.*", "_chunk")
    w = Window.partitionBy(*keys, "_chunk").orderBy("seq")
    return (
        placed.unionByName(ends)
        .select(
            *keys, F.col("seq").alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"),
            F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"),
        )
        .where("x1 is not null")
    )


def with_length(segs: DataFrame) -> DataFrame:
    return segs.withColumn("length", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2))


def midpoints(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Point halfway along each line, a point that is always on it (keys..., x, y)."""
    w = Window.partitionBy(*keys).orderBy("seg")
    run = with_length(segs).withColumn("upto", F.sum("length").over(w)).withColumn(
        "total", F.sum("length").over(Window.partitionBy(*keys))
    )
    half = F.col("total") / 2
    t = F.coalesce(F.try_divide(half - (F.col("upto") - F.col("length")), F.col("length")), F.lit(0.0))
    hit = run.where((F.col("upto") >= half) & (F.col("upto") - F.col("length") <= half)).select(
        *keys, "seg", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"),
        (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"),
    )
    return hit.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "seg").alias("p")).select(*keys, "p.x", "p.y")


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


#: Part of a cell by which walks are widened, so that rounding never loses a cell.
PAD = 1e-6


def _segment_cells(segs: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """One row (_cx, _cy) for each cell that a segment passes, or comes closer to than margin.

    The segment is walked column by column, each with the rows it passes there, so rows grow with its
    length, not with its box.
    """
    pad = margin + PAD * size
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    low, high = F.least(x0, x1), F.greatest(x0, x1)
    across = segs.withColumn("_cx", F.explode(F.sequence(_cell(low - pad, size), _cell(high + pad, size))))

    def at(x: Column, otherwise: Column) -> Column:
        """y of the segment at x, held to its ends; otherwise where it is vertical."""
        t = F.try_divide(F.least(F.greatest(x, low), high) - x0, x1 - x0)
        return F.coalesce(y0 + t * (y1 - y0), otherwise)

    left, right = at(F.col("_cx") * size - pad, y0), at((F.col("_cx") + 1) * size + pad, y1)
    return across.withColumn("_cy", F.explode(F.sequence(_cell(F.least(left, right) - pad, size), _cell(F.greatest(left, right) + pad, size))))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _meeting(left: DataFrame, right: DataFrame, cell: float) -> tuple[DataFrame, tuple[Column, ...]]:
    """Pairs of segments that pass one cell, as l_<name> and r_<name>, and the terms ax, ay, bx, by, ox, oy of their lines."""
    a, b = _prefixed(_segment_cells(left, cell), "l_"), _prefixed(_segment_cells(right, cell), "r_")
    pairs = a.join(b, (F.col("l__cx") == F.col("r__cx")) & (F.col("l__cy") == F.col("r__cy")))
    ax, ay = F.col("l_x1") - F.col("l_x0"), F.col("l_y1") - F.col("l_y0")
    bx, by = F.col("r_x1") - F.col("r_x0"), F.col("r_y1") - F.col("r_y0")
    return pairs, (ax, ay, bx, by, F.col("r_x0") - F.col("l_x0"), F.col("r_y0") - F.col("l_y0"))


def _once(x: Column, y: Column, cell: float) -> Column:
    """A pair that shares several cells counts in the one its result lies in."""
    return (_cell(x, cell) == F.col("l__cx")) & (_cell(y, cell) == F.col("l__cy"))


CELLS = [f"{p}{c}" for p in ("l_", "r_") for c in ("_cx", "_cy")]


def segment_crossings(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of crossing segments with the parameters t (left), u (right) and the point x, y.

    End points count. Columns come back as l_<name> and r_<name>. Segments on one line have no
    single point; see segment_overlaps. cell should be near the length of most segments.
    """
    pairs, (ax, ay, bx, by, ox, oy) = _meeting(left, right, cell)
    det = ax * by - ay * bx
    hit = pairs.withColumn("t", F.try_divide(ox * by - oy * bx, det)).withColumn("u", F.try_divide(ox * ay - oy * ax, det))
    on_both = F.col("t").between(0, 1) & F.col("u").between(0, 1)
    placed = hit.where(on_both).withColumn("x", F.col("l_x0") + F.col("t") * ax).withColumn("y", F.col("l_y0") + F.col("t") * ay)
    return placed.where(_once(F.col("x"), F.col("y"), cell)).drop(*CELLS)


#: Steps into which a half turn and a cell are cut to tell lines apart, copies of a row on each side of a crowded line, and rows of a packed chunk.
LINE_STEPS = 256
COPIES = 4
PACK = 1024


def _line_keys(segs: DataFrame, cell: float) -> tuple[Column, Column]:
    """Fractional bins of a segment in its cell: direction, and distance of its line from the corner of the cell.

    Segments of one line agree in both up to rounding. The direction of a line that stands upright may
    come out at either end of the half turn; the distance changes its sign with it, so it is taken without.
    Bins are shifted by half, so that upright, level and diagonal lines and those along the cells lie within one.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = F.pmod(F.atan2(dy, dx) / math.pi, F.lit(1.0)) * LINE_STEPS
    ox, oy = F.col("x0") - F.col("_cx") * cell, F.col("y0") - F.col("_cy") * cell
    away = F.abs(ox * dy - oy * dx) / F.sqrt(dx * dx + dy * dy) / cell * LINE_STEPS
    return turn + 0.5, away + 0.5


def _overlap_sides(segs: DataFrame, prefix: str, cell: float, starts: bool) -> DataFrame:
    """Rows of segments by cell and line as <prefix><name>; starts: only in the cell of the lesser end, in the bin itself, else in all cells and near bins."""
    segs = segs.where("x0 <> x1 or y0 <> y1")
    ends = [F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (0, 1)]
    segs = segs.withColumn("_at", F.least(*ends))
    near = lambda v: F.array_distinct(F.array(*[F.floor(v + e).cast("bigint") for e in (-PAD, PAD)]))
    copies = F.sequence(F.lit(0), F.lit(COPIES - 1))
    if starts:
        rows = segs.withColumn("_cx", _cell(F.col("_at.x"), cell)).withColumn("_cy", _cell(F.col("_at.y"), cell))
        turn, away = _line_keys(rows, cell)
        rows = rows.withColumn("_turn", F.pmod(F.floor(turn).cast("bigint"), F.lit(LINE_STEPS))).withColumn("_away", F.floor(away).cast("bigint"))
    else:
        rows = _segment_cells(segs, cell)
        turn, away = _line_keys(rows, cell)
        rows = rows.withColumn("_turn", F.explode(F.transform(near(turn), lambda k: F.pmod(k, F.lit(LINE_STEPS))))).withColumn("_away", F.explode(near(away)))
    # Every row of one side meets every row of the other in one of COPIES x COPIES parts of their line.
    mine = F.pmod(F.xxhash64(*segs.columns), F.lit(COPIES))
    part = F.transform(copies, lambda k: F.struct((mine if starts else k.cast("bigint")).alias("a"), (k.cast("bigint") if starts else mine).alias("b")))
    rows = rows.withColumn("_part", F.explode(part)).select("*", F.col("_part.a").alias("_pa"), F.col("_part.b").alias("_pb")).drop("_part")
    return _prefixed(rows, prefix)


def _later_starts(left: DataFrame, right: DataFrame, cell: float, late: str) -> DataFrame:
    """Pairs that meet where the segment of the side late ("l_" or "r_") begins, no earlier than the other one."""
    a, b = (_overlap_sides(df, p, cell, p == late) for df, p in ((left, "l_"), (right, "r_")))
    names = ["_cx", "_cy", "_turn", "_away", "_pa", "_pb"]
    a, b = spread(a, *[f"l_{n}" for n in names]), spread(b, *[f"r_{n}" for n in names])
    keys = [f"l_{n}" for n in names]
    # The left rows of a part lie in packed chunks: a right row is held beside one after the other, and what repeats lies together in the result.
    place = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("l__at")) - 1) / PACK)
    whole = [c for c in a.columns if c not in keys]
    packed = a.withColumn("_chunk", place).groupBy(*keys, "_chunk").agg(F.collect_list(F.struct(*whole)).alias("_pack"))
    on = F.lit(True)
    for n in names:
        on = on & (F.col(f"r_{n}") == F.col(f"l_{n}"))
    later = F.col("r__at") >= F.col("l__at") if late == "r_" else F.col("l__at") > F.col("r__at")
    # A left join goes through the right rows whichever side is small; those without a left row fall to the next test.
    met = b.join(packed, on, "left").select(*b.columns, F.inline_outer("_pack")).where(later)
    return met.select(*[c for c in [*whole, *b.columns] if c not in ("l__at", "r__at", *[f"r_{n}" for n in names])])


def segment_overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of segments on one line that share a piece: t0 < t1 along the left one, and its ends x0, y0, x1, y1.

    Columns of the segments come back as l_<name> and r_<name>. The later of the two beginnings lies on
    both segments, so a pair meets only there: in its cell, among segments of about the same direction and place.
    """
    pairs = _later_starts(left, right, cell, "r_").unionByName(_later_starts(left, right, cell, "l_"))
    ax, ay = F.col("l_x1") - F.col("l_x0"), F.col("l_y1") - F.col("l_y0")
    bx, by = F.col("r_x1") - F.col("r_x0"), F.col("r_y1") - F.col("r_y0")
    ox, oy = F.col("r_x0") - F.col("l_x0"), F.col("r_y0") - F.col("l_y0")
    length = ax * ax + ay * ay
    first = F.try_divide(ox * ax + oy * ay, length)
    last = F.try_divide((ox + bx) * ax + (oy + by) * ay, length)
    same = (length > 0) & (ax * by - ay * bx == 0) & (ax * oy - ay * ox == 0)
    run = pairs.where(same).withColumn("t0", F.greatest(F.least(first, last), F.lit(0.0))).withColumn("t1", F.least(F.greatest(first, last), F.lit(1.0)))
    run = run.where("t0 < t1")
    ends = [(F.col(f"l_{c}0") + F.col(t) * d).alias(f"{c}{i}") for i, t in ((0, "t0"), (1, "t1")) for c, d in (("x", ax), ("y", ay))]
    return run.select(*run.columns, *ends)


def crossing_points(lines: DataFrame, transects: DataFrame, cell: float) -> DataFrame:
    """Distinct points (x, y) where a line meets a transect, the union of both layers first.

    Equal segments collapse before the join, equal points (a vertex shared by two
    segments) after it.
    """
    only = ["x0", "y0", "x1", "y1"]
    hits = segment_crossings(transects.select(*only).distinct(), lines.select(*only).distinct(), cell)
    # + 0.0 turns -0.0 into 0.0
    return hits.select(*[(F.round(c, POINT_DIGITS) + 0.0).alias(c) for c in ("x", "y")]).distinct()


def shared_lines(lines: DataFrame, transects: DataFrame, cell: float) -> DataFrame:
    """Distinct pieces (x0, y0, x1, y1) that a line and a transect have in common, from the lesser end to the greater."""
    only = ["x0", "y0", "x1", "y1"]
    found = segment_overlaps(transects.select(*only).distinct(), lines.select(*only).distinct(), cell)
    end = lambda i: F.struct(*[(F.round(f"{c}{i}", POINT_DIGITS) + 0.0).alias(c) for c in ("x", "y")])
    ends = found.select(F.least(end(0), end(1)).alias("a"), F.greatest(end(0), end(1)).alias("b")).distinct()
    return ends.select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def points_near(points: DataFrame, segs: DataFrame, cell: float, within: float = EPSILON) -> DataFrame:
    """Points closer than `within` to a segment: all columns of both, with the distance.

    A point has one cell and a segment each cell once, so no pair comes twice.
    """
    p = points.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    s = _segment_cells(segs, cell, within)
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    return (
        p.join(s, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") < within).drop("_cx", "_cy")
    )


def paired_distances(transects: DataFrame, first: DataFrame, second: DataFrame, cell: float) -> DataFrame:
    """Distance between the two lines along each transect that either meets exactly once.

    transects (transect_id, x0, y0, x1, y1); first and second are line segments.
    Counting needs no list of the points: min, max and a count are enough.
    """
    def single(lines: DataFrame, tag: str) -> DataFrame:
        near = points_near(crossing_points(lines, transects, cell), transects, cell)
        return (
            near.groupBy("transect_id")
            .agg(F.count("*").alias("n"), F.min(F.struct("x", "y")).alias("p"))
            .where("n = 1")
            .select("transect_id", F.col("p.x").alias(f"{tag}x"), F.col("p.y").alias(f"{tag}y"))
        )

    both = single(first, "a").join(single(second, "b"), "transect_id")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return both.select("transect_id", d.alias("distance"))


def rmse(distances: DataFrame, by: str | None = None) -> DataFrame:
    """Root mean square of `distance`, overall and for each value of `by` (NULL in the overall row)."""
    value = F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse")
    n = F.count("distance").alias("pairs")
    if by is None:
        return distances.agg(value, n)
    return distances.rollup(by).agg(value, n)


def ring_edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of closed rings; the vertex table repeats the first vertex at the end."""
    return segments(rings, keys)


def polygon_cover(rings: DataFrame, cell: float, poly_key: str = "poly_id") -> tuple[DataFrame, DataFrame]:
    """Cells of polygons under the even-odd rule over all their rings: (border, inside).

    border (poly, _cx, _cy, _odd, x0, y0, x1, y1): one row for each edge in each cell an edge passes;
    _odd tells whether the lower left corner of the cell is inside. inside (poly, _level, _cx, _cy): cells
    without an edge that lie inside, in each row of cells joined to the largest aligned runs of 2^_level.
    Both grow with the outline, not with the area.
    """
    keys = [poly_key] + (["ring"] if "ring" in rings.columns else [])
    edges = settled(_segment_cells(ring_edges(rings, keys).select(poly_key, "x0", "y0", "x1", "y1"), cell), "cover")
    # Cuts of the lower side of a cell: their running number along the row is the parity of the corners.
    y = F.col("_cy") * cell
    cut = F.col("x0") + F.try_divide((y - F.col("y0")) * (F.col("x1") - F.col("x0")), F.col("y1") - F.col("y0"))
    here = ((F.col("y0") > y) != (F.col("y1") > y)) & (_cell(cut, cell) == F.col("_cx"))
    cells = edges.groupBy(poly_key, "_cx", "_cy").agg(F.sum(F.coalesce(here, F.lit(False)).cast("long")).alias("_cuts"))
    row = Window.partitionBy(poly_key, "_cy").orderBy("_cx")
    upto = F.sum("_cuts").over(row.rowsBetween(Window.unboundedPreceding, 0))
    cells = settled(cells.select(poly_key, "_cx", "_cy", ((upto - F.col("_cuts")) % 2 == 1).alias("_odd"), (upto % 2 == 1).alias("_after"), F.lead("_cx").over(row).alias("_next")), "cover-cells")
    border = edges.join(cells.select(poly_key, "_cx", "_cy", "_odd"), [poly_key, "_cx", "_cy"])
    runs = cells.where("_after and _next > _cx + 1").select(poly_key, "_cy", (F.col("_cx") + 1).alias("a"), F.col("_next").alias("b"))
    # [a, b) as aligned runs: at most one before and one after the middle for each power of two.
    up = lambda v, k: F.expr(f"shiftleft(shiftright({v} + shiftleft(1L, {k}) - 1, {k}), {k})")
    down = lambda v, k: F.expr(f"shiftleft(shiftright({v}, {k}), {k})")
    levels = runs.withColumn("_level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2((F.col("b") - F.col("a")).cast("double") + 1)).cast("int"))))
    la, lb_, ha, hb = up("a", "_level"), down("b", "_level"), up("a", "_level + 1"), down("b", "_level + 1")
    # A run of this level is taken where the next level does not cover it.
    whole = la < lb_
    first = F.when(whole & ((la < ha) | (ha >= hb)), la)
    last = F.when(whole & ((lb_ > hb) | (ha >= hb)), lb_ - F.expr("shiftleft(1L, _level)"))
    taken = levels.select(poly_key, "_cy", "_level", F.explode(F.array_distinct(F.array_compact(F.array(first, last)))).alias("_start"))
    inside = taken.select(poly_key, "_level", F.expr("shiftright(_start, _level)").alias("_cx"), "_cy")
    return border, settled(inside, "cover-inside")


def in_polygons(points: DataFrame, key: str, rings: DataFrame, poly_key: str = "poly_id", strip: float = 0.01) -> DataFrame:
    """(key, poly_key) for every point inside a polygon, by the even-odd rule over all its rings.

    Polygons are covered by cells of side strip (see polygon_cover). A point meets one cell of a polygon at
    most: in an inner one it is inside; in a border cell the way from the corner to the point counts the
    few edges of that cell. key is unique.
    """
    border, inner = polygon_cover(rings, strip, poly_key)
    p = points.select(key, "x", "y").withColumn("_cx", _cell(F.col("x"), strip)).withColumn("_cy", _cell(F.col("y"), strip))
    x, y, low = F.col("x"), F.col("y"), F.col("_cy") * strip
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    meets = lambda v: (F.col("y0") > v) != (F.col("y1") > v)
    cut = lambda v: F.col("x0") + F.try_divide((v - F.col("y0")) * dx, dy)
    right = lambda v: _cell(v, strip) >= F.col("_cx")
    # Up the left side of the cell, then across: an edge on the way changes the side. Where an edge passes
    # a corner of the way is told by its cut alone, so both parts of the way agree to the last bit.
    rising = (dx > 0) == (dy > 0)
    below = F.when(meets(y), right(cut(y)) == rising).otherwise(F.col("y0") <= y)
    above = F.when(meets(low), right(cut(low)) != rising).otherwise(F.col("y0") > low)
    up = (right(F.col("x0")) != right(F.col("x1"))) & above & below
    across = meets(y) & right(cut(y)) & (cut(y) <= x)
    steps = F.coalesce(up.cast("int"), F.lit(0)) + F.coalesce(across.cast("int"), F.lit(0))
    near = p.join(border, ["_cx", "_cy"]).groupBy(key, poly_key).agg(F.sum(steps).alias("n"), F.max(F.col("_odd").cast("int")).alias("odd"))
    on_border = near.where("(n + odd) % 2 = 1").select(key, poly_key)
    # The levels in use are few: the logarithm of the widest run.
    used = [r[0] for r in inner.select("_level").distinct().collect()]
    if not used:
        return on_border
    at = p.select(key, F.col("_cy"), F.inline(F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_cx", k).alias("_cx")) for k in sorted(used)])))
    return on_border.union(at.join(inner, ["_level", "_cx", "_cy"]).select(key, poly_key))


def clip_segments(segs: DataFrame, key: str, rings: DataFrame, cell: float, strip: float, poly_key: str = "poly_id") -> DataFrame:
    """Pieces of segments inside each polygon (key, poly_key, t0, t1, x0, y0, x1, y1).

    A segment is cut where it crosses an edge; a piece stays when its middle is inside. Segments that cross
    no edge of a polygon concern it only if they begin inside.
    """
    keys = [poly_key] + (["ring"] if "ring" in rings.columns else [])
    edges = ring_edges(rings, keys)
    segs = segs.select(key, "x0", "y0", "x1", "y1")
    hits = settled(segment_crossings(segs, edges.select(poly_key, "x0", "y0", "x1", "y1"), cell).select(F.col(f"l_{key}").alias(key), F.col(f"r_{poly_key}").alias(poly_key), "t"), "cuts")
    begun = in_polygons(segs.select(key, F.col("x0").alias("x"), F.col("y0").alias("y")), key, rings, poly_key, strip)
    ends = hits.select(key, poly_key).union(begun.select(key, poly_key)).distinct()
    cuts = ends.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).unionByName(hits).distinct().join(segs, key)
    w = Window.partitionBy(key, poly_key).orderBy("t")
    pieces = cuts.withColumn("t1", F.lead("t").over(w)).where("t1 is not null and t1 > t").withColumnRenamed("t", "t0")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    mid = (F.col("t0") + F.col("t1")) / 2
    pieces = pieces.withColumn("_id", F.struct(key, poly_key, "t0")).withColumn("x", F.col("x0") + mid * dx).withColumn(
        "y", F.col("y0") + mid * dy
    )
    inside = in_polygons(pieces.select("_id", "x", "y"), "_id", rings, poly_key, strip)
    kept = inside.where(F.col(f"_id.{poly_key}") == F.col(poly_key)).select("_id")
    return pieces.join(kept, "_id", "left_semi").select(
        key, poly_key, "t0", "t1",
        (F.col("x0") + F.col("t0") * dx).alias("x0"), (F.col("y0") + F.col("t0") * dy).alias("y0"),
        (F.col("x0") + F.col("t1") * dx).alias("x1"), (F.col("y0") + F.col("t1") * dy).alias("y1"),
    )


def to_degrees_cell(metres: float, lat: float) -> float:
    """Cell size in degrees of longitude for a size in metres at a latitude."""
    return metres / (111320.0 * math.cos(math.radians(lat)))
