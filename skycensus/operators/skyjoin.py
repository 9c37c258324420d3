"""Neighbour joins on the sky: cells give an equi-join, the exact box test comes after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import contour_scale, ellipse_halfwidths, ra_offset
from ..sources.storage import stored

FRAME_ARCSEC, CELL_DEG, SIGMA = 120.0, 0.05, 5.0
#: Half-width (arcsec) of a component's box up to which sources look for it; wider ones look for the sources.
ROOM_ARCSEC = 15.0
#: Components or sources of a cell beyond which it is split, and levels of the quadtree in a cell.
MOST_IN_CELL, DEPTH = 4000, 4
#: What rounding may add to a reach, as a share of it and in degrees.
SLACK = 1e-9


def _cell(dec: Column, cell: float) -> Column:
    return F.floor(dec / cell)


def _turn(ra: Column) -> Column:
    """Degrees from 0 to below 360; the remainder of a small negative angle rounds to 360 and goes to 0."""
    return F.pmod(F.pmod(ra, F.lit(360.0)), F.lit(360.0))


def _least_cos(band: Column, cell: float) -> Column:
    """Least size of the cosine in a row of cells; 0 where it crosses a pole."""
    a, b = F.cos(F.radians(band * cell)), F.cos(F.radians((band + 1) * cell))
    return F.when(a * b > 0, F.least(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))


def _lanes(band: Column, cell: float) -> Column:
    """Number of cells in a row around the circle."""
    return F.greatest(F.lit(1).cast("long"), F.floor(360.0 / cell * _least_cos(band, cell)))


def _placed(df: DataFrame, ra: str, dec: str, up: Column, wide: Callable[[Column], Column], cell: float) -> DataFrame:
    """A row (band, lane) for each cell within ``up`` degrees of declination and ``wide(band)`` of right ascension; each cell once."""
    rows = df.withColumn("band", F.explode(F.sequence(_cell(F.col(dec) - up, cell), _cell(F.col(dec) + up, cell))))
    n, at = F.col("_n"), _turn(F.col(ra))
    rows = rows.withColumn("_n", _lanes(F.col("band"), cell)).withColumn("_r", wide(F.col("band")))
    rows = rows.withColumns({"_lo": F.floor((at - F.col("_r")) / 360.0 * n), "_hi": F.floor((at + F.col("_r")) / 360.0 * n)})
    return rows.withColumn("lane", F.explode(F.sequence("_lo", F.least(F.col("_hi"), F.col("_lo") + n - 1)))).withColumn("lane", F.pmod("lane", n)).drop("_n", "_r", "_lo", "_hi")


def neighbours(sources: DataFrame, components: DataFrame, frame: float = FRAME_ARCSEC, cell: float = CELL_DEG, most: int = MOST_IN_CELL) -> DataFrame:
    """Pairs of a source and a component whose ellipse's box overlaps the source's square frame.

    Each component goes to its own cell; each source to the cells that its frame and ``ROOM_ARCSEC`` around it reach.  A row of cells has
    its own number of cells around the circle, so that a cell is at least ``cell`` wide anywhere in it; declinations beyond a pole
    go on, with the size of their cosine.  A component wider than ``ROOM_ARCSEC`` goes to
    all cells within its reach instead and meets sources in their own cells only.  So no overlap is missed and every pair meets once,
    in one join; rows that are repeated in a table count as often as they occur.  Cells of more than ``most`` components or sources are split into the
    nodes of a quadtree, so no task of the join has more than that of them or of the sources that meet them.
    """
    half = frame / 2
    more = lambda degrees: degrees * (1 + SLACK) + SLACK
    floor_cos = lambda c: F.greatest(F.lit(1e-12), c)
    dx, dy = ellipse_halfwidths(F.col("maj"), F.col("min"), F.col("pa"))
    comps = components.select(F.col("parent"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), "peak", "maj", "min", "pa", dx.alias("dx"), dy.alias("dy"))
    comps = comps.withColumn("_reach", F.when(F.greatest("dx", "dy") > ROOM_ARCSEC, F.lit(1)).otherwise(F.lit(0)))
    if_wide = lambda c: F.when(F.col("_reach") > 0, more(c)).otherwise(F.lit(0.0))
    comps = _placed(comps, "c_ra", "c_dec", if_wide((half + F.col("dy")) / 3600.0), lambda band: if_wide((half + F.col("dx")) / 3600.0 / floor_cos(_least_cos(band, cell))), cell)
    reach = F.lit((half + ROOM_ARCSEC) / 3600.0)
    near = _placed(sources, "ra", "dec", more(reach), lambda band: more(reach / floor_cos(F.abs(F.cos(F.radians("dec"))))), cell)
    lanes = lambda band: _lanes(band, cell)
    lane = lambda ra, n: F.pmod(F.floor(_turn(ra) / 360.0 * n), n)
    near = near.withColumn("_own", (F.col("band") == _cell(F.col("dec"), cell)) & (F.col("lane") == lane(F.col("ra"), lanes(F.col("band")))))
    x, y = ra_offset(F.col("c_ra"), F.col("ra"), F.col("dec")), (F.col("c_dec") - F.col("dec")) * 3600.0
    touches = lambda pairs: pairs.withColumns({"x0": x, "y0": y}).where((F.abs("x0") <= half + F.col("dx")) & (F.abs("y0") <= half + F.col("dy")))
    meet = lambda n, c, by: n.hint("merge").join(c, by).where((F.col("_reach") == 0) | F.col("_own"))
    # cells that hold more components or sources than a task should: few, or none
    at = lambda df: df.select(_cell(F.col("dec"), cell).alias("band"), "ra").select("band", lane(F.col("ra"), lanes(F.col("band"))).alias("lane"))
    heavy = lambda df: at(df).groupBy("band", "lane").agg(F.count("*").alias("n")).where(F.col("n") > most).select("band", "lane")
    full = stored(heavy(components).unionByName(heavy(sources)).distinct(), "full-cells")
    # several rows a source: more than the size estimate of a broadcast knows
    if full.isEmpty():
        return touches(meet(near, comps, ["band", "lane"])).drop("band", "lane", "_reach", "_own")
    thin = touches(meet(near.join(full, ["band", "lane"], "left_anti"), comps.join(full, ["band", "lane"], "left_anti"), ["band", "lane"]))
    # the full cells' rows are few and read several times
    crowd, seen = _quarters(stored(near.join(full, ["band", "lane"]), "crowd-sources"), stored(comps.join(full, ["band", "lane"]), "crowd"), lanes, half, cell, most)
    dense = touches(meet(seen, crowd, ["band", "lane", "level", "qx", "qy", "part", "salt"])).drop("level", "qx", "qy", "part", "salt")
    return thin.unionByName(dense).drop("band", "lane", "_reach", "_own")


def _quarters(near: DataFrame, comps: DataFrame, lanes: Callable[[Column], Column], half: float, cell: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(components, sources) of full cells, keyed by the nodes of a loose quadtree in each cell.

    A component belongs to the first node on its way down that holds ``most`` components or fewer, but to none smaller than itself; one
    that comes from another cell belongs to the node -1.  A source visits, on each level, the nodes within its frame and one node's
    width.  A node of more components or visitors still is cut into parts and salts, so no key has more than ``most`` of either.
    """
    n, side = lanes(F.col("band")), F.lit(cell * 3600.0)
    # degrees of right ascension of a lane, and a node's least width in arcsec at the cell's upper or lower border
    shrink = F.greatest(F.lit(1e-6), _least_cos(F.col("band"), cell))
    width = F.least(360.0 / n * 3600.0 * shrink, side)
    steps = 1 << DEPTH
    fx = _turn(F.col("c_ra")) / 360.0 * n - F.col("lane")
    fy = F.col("c_dec") / cell - F.col("band")
    place = lambda f: F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(f * steps))).cast("int")
    # a node of level l is width / 2^l wide: no narrower than the component's half-widths
    fits = F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(width / F.greatest(F.col("dx"), F.col("dy"), F.lit(1e-3)))))).cast("int")
    coded = comps.withColumns({"_fx": place(fx), "_fy": place(fy), "_fits": fits})
    at = lambda c, level: F.floor(c / F.pow(F.lit(2.0), DEPTH - level)).cast("int")
    by = ["band", "lane", "level", "qx", "qy"]
    # counts of all nodes from those of the smallest
    small = coded.where("_reach = 0").groupBy("band", "lane", "_fx", "_fy").agg(F.count("*").alias("_k"))
    up = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")).withColumns({"qx": at(F.col("_fx"), F.col("level")), "qy": at(F.col("_fy"), F.col("level"))})
    heavy = up.groupBy(*by).agg(F.sum("_k").alias("_k")).where(F.col("_k") > most)
    # a component lies in one node of each level: it goes below the heavy ones
    depth = up.join(heavy.select(*by), by).groupBy("band", "lane", "_fx", "_fy").agg((F.max("level") + 1).alias("_deep"))
    dealt = coded.join(depth, ["band", "lane", "_fx", "_fy"], "left")
    level = F.when(F.col("_reach") > 0, F.lit(-1)).otherwise(F.least(F.col("_fits"), F.lit(DEPTH), F.coalesce("_deep", F.lit(0)))).cast("int")
    inside = lambda c: F.when(F.col("level") < 0, F.lit(0)).otherwise(at(F.col(c), F.col("level")))
    dealt = stored(dealt.withColumn("level", level).withColumns({"qx": inside("_fx"), "qy": inside("_fy")}).drop("_fx", "_fy", "_fits", "_deep"), "nodes")

    own_y = F.col("dec") / cell - F.col("band")
    own_x = _turn(F.col("ra")) / 360.0 * n - F.col("lane")
    across = lambda l: (half + side / (1 << l)) / side * (1 + 1e-9)
    along = lambda l: (half + side / (1 << l)) / 3600.0 / F.greatest(F.lit(1e-12), F.abs(F.cos(F.radians("dec")))) / 360.0 * n * (1 + 1e-9)

    def touched(l: int) -> Column:
        most_x = F.lit(float(1 << l))
        span = lambda c, r: F.sequence(F.greatest(F.lit(0.0), F.floor(F.greatest(F.lit(0.0), (c - r) * most_x))).cast("int"), F.least(F.lit((1 << l) - 1), F.floor(F.least(most_x, (c + r) * most_x))).cast("int"))
        empty = F.array().cast("array<int>")
        # the frame may lie across the circle's zero, and in a row of few lanes reach a lane from both sides
        turns = [F.when((x + along(l) >= 0) & (x - along(l) < 1), span(x, along(l))).otherwise(empty) for x in (own_x - n, own_x, own_x + n)]
        columns = F.array_distinct(F.concat(*turns))
        nodes = F.flatten(F.transform(columns, lambda i: F.transform(span(own_y, across(l)), lambda j: F.struct(F.lit(l).alias("level"), i.alias("qx"), j.alias("qy")))))
        return F.when((own_y + across(l) >= 0) & (own_y - across(l) < 1), nodes).otherwise(F.array().cast("array<struct<level:int,qx:int,qy:int>>"))

    other = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("qx"), F.lit(0).alias("qy")))
    visits = near.select("*", F.explode(F.concat(*[touched(l) for l in range(DEPTH + 1)], F.when(F.col("_own"), other).otherwise(F.array().cast("array<struct<level:int,qx:int,qy:int>>")))).alias("_node")).select("*", "_node.*").drop("_node")
    held = dealt.groupBy(*by).agg(F.count("*").alias("_held"))
    called = visits.join(held.select(*by), by, "left_semi").groupBy(*by).agg(F.count("*").alias("_called"))
    share = lambda c: F.ceil(F.col(c) / most)
    nodes = stored(held.join(called, by).select(*by, share("_held").alias("parts"), share("_called").alias("salts")), "node-sizes")
    any_of = lambda c: F.floor(F.rand(7) * F.col(c)).cast("long")
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    crowd = stored(dealt.join(nodes, by).withColumn("part", any_of("parts")), "parts").select("*", all_of("salts").alias("salt")).drop("parts", "salts")
    seen = stored(visits.join(nodes, by).withColumn("salt", any_of("salts")), "salts").select("*", all_of("parts").alias("part")).drop("parts", "salts")
    return crowd, seen


def foreign_flags(sources: DataFrame, components: DataFrame, sigma: float = SIGMA, frame: float = FRAME_ARCSEC) -> DataFrame:
    """One row for each source: foreign components in its frame, those above ``sigma``, the brightest one, and the flag."""
    # narrow rows go through the join's cells; what else a source has joins last
    pairs = neighbours(sources.select("source_id", "source_name", "ra", "dec", "isl_rms"), components, frame).where(F.col("parent") != F.col("source_name"))
    ratio = F.when(F.col("isl_rms") > 0, F.col("peak") / F.col("isl_rms")).otherwise(F.lit(0.0))
    best = F.max(F.struct("peak", ratio.alias("snr"), "parent"))
    got = pairs.groupBy("source_id").agg(F.count("*").alias("n_foreign_components"), F.count_if(ratio >= sigma).alias("n_foreign_detected"), best.alias("b"))
    out = sources.join(got, "source_id", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return out.select(*sources.columns, zero("n_foreign_components", 0).alias("n_foreign_components"), zero("n_foreign_detected", 0).alias("n_foreign_detected"), zero("b.peak", 0.0).alias("brightest_foreign_flux"), zero("b.snr", 0.0).alias("brightest_foreign_snr"), zero("b.parent", "").alias("brightest_foreign_parent"), (zero("n_foreign_detected", 0) > 0).alias("foreign_contaminant"))


def cropped_flags(sources: DataFrame, components: DataFrame, boundary_sigma: float | None = None, frame: float = FRAME_ARCSEC) -> DataFrame:
    """One row for each source: its own components, whether they cross the frame, and the larger side of their box."""
    half = frame / 2
    comps = components.select(F.col("parent").alias("source_name"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), "peak", "maj", "min", "pa")
    own = sources.select("source_id", "source_name", "ra", "dec", "isl_rms").join(comps, "source_name")
    if boundary_sigma is not None:
        grow = F.when(F.col("isl_rms") > 0, contour_scale(F.col("peak"), boundary_sigma * F.col("isl_rms"))).otherwise(F.lit(1.0))
        own = own.withColumn("g", grow).withColumns({"maj": F.col("maj") * F.col("g"), "min": F.col("min") * F.col("g")})
    dx, dy = ellipse_halfwidths(F.col("maj"), F.col("min"), F.col("pa"))
    own = own.withColumns({"x0": ra_offset(F.col("c_ra"), F.col("ra"), F.col("dec")), "y0": (F.col("c_dec") - F.col("dec")) * 3600.0, "dx": dx, "dy": dy})
    box = own.groupBy("source_id").agg(F.count("*").alias("n"), F.min(F.col("x0") - F.col("dx")).alias("x_lo"), F.max(F.col("x0") + F.col("dx")).alias("x_hi"), F.min(F.col("y0") - F.col("dy")).alias("y_lo"), F.max(F.col("y0") + F.col("dy")).alias("y_hi"))
    outside = (F.col("x_lo") < -half) | (F.col("x_hi") > half) | (F.col("y_lo") < -half) | (F.col("y_hi") > half)
    side = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    return sources.join(box, "source_id", "left").select(*sources.columns, F.coalesce("n", F.lit(0)).alias("n_own_components"), F.coalesce(outside, F.lit(False)).alias("cropped"), F.coalesce(side, F.lit(0.0)).alias("own_extent"))


def lookup(df: DataFrame, key: str, table: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """``out``: the value of a trimmed name in a table, "" for a blank or unknown name; the table's names count once."""
    once = table.select(F.trim(name).alias("_name"), F.col(value).alias("_value")).groupBy("_name").agg(F.min("_value").alias("_value"))
    return df.withColumn("_key", F.trim(key)).join(once, F.col("_key") == F.col("_name"), "left").withColumn(out, F.coalesce(F.when(F.col("_key") != "", F.col("_value")), F.lit(""))).drop("_key", "_name", "_value")


def missplit_flags(sources: DataFrame, components: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Foreign flags, both optical names and the mis-split flag (the brightest foreign parent has the source's own optical name)."""
    ids = sources.select("source_name", "id_name")
    foreign = foreign_flags(sources, components, sigma).drop("id_name")
    both = lookup(lookup(foreign, "source_name", ids, "source_name", "id_name", "target_id"), "brightest_foreign_parent", ids, "source_name", "id_name", "foreign_id")
    return both.withColumn("optical_missplit", (F.col("target_id") != "") & (F.col("target_id") == F.col("foreign_id")))


def quality_table(sources: DataFrame, components: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Foreign and cropped flags and the mis-split flag."""
    cropped = cropped_flags(sources, components).select("source_id", "n_own_components", "cropped", "own_extent")
    return missplit_flags(sources, components, sigma).join(cropped, "source_id")
