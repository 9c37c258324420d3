"""Queries on images: array expressions, pixels in long form, image kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import transforms
from ..functions.transforms import Asinh
from ..operators import imaging
from ..operators.dist import uniform, uniform_sql
from ..operators.evaluate import density_coverage, kth_distance, memorisation_report, nearest
from ..operators.pixel_match import match
from ..operators.quantiles import mad
from ..sources import adapters as A
from ..sources import storage
from .registry import query

NAN_IMAGES = "nan_images AS (SELECT idx, CASE WHEN idx % 50 = 0 THEN list_transform(image, lambda v: CAST('NaN' AS FLOAT)) WHEN idx % 7 = 0 THEN list_transform(range(64), lambda k: CASE WHEN k = idx % 64 THEN CAST('NaN' AS FLOAT) ELSE image[k + 1] END) ELSE image END AS image FROM images)"
PX = "px AS (SELECT idx, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CAST(image[k + 1] AS DOUBLE) AS v FROM images, range(64) t(k))"


def nan_images(spark: SparkSession, d: str) -> DataFrame:
    nan = F.lit(float("nan")).cast("float")
    some = F.transform("image", lambda v, k: F.when(k == F.col("idx") % 64, nan).otherwise(v))
    return A.images(spark, d).withColumn("image", F.when(F.col("idx") % 50 == 0, F.transform("image", lambda v: nan)).when(F.col("idx") % 7 == 0, some).otherwise(F.col("image")))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _sum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))


@query("s08_padded_image", "SELECT idx, CAST(len(p) AS INTEGER) AS n, CAST(len(list_filter(p, lambda v: isnan(v))) AS INTEGER) AS n_nan, round(list_sum(list_filter(p, lambda v: NOT isnan(v))), 4) AS s FROM (SELECT idx, list_transform(range(100), lambda k: CASE WHEN k // 10 < 8 AND k % 10 < 8 THEN CAST(image[(k // 10) * 8 + k % 10 + 1] AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END) AS p FROM images)")
def s08(spark: SparkSession, d: str) -> DataFrame:
    p = A.images(spark, d).select("idx", I.padded(F.col("image"), 8, 8, 10).alias("p"))
    return p.select("idx", F.size("p").alias("n"), I.n_missing(F.col("p")).alias("n_nan"), F.round(I.total(F.col("p")), 4).alias("s"))


@query("s10_unreadable_is_nan", "SELECT idx, CAST(CASE WHEN idx % 9 = 0 THEN 64 ELSE 0 END AS INTEGER) AS n_nan FROM images")
def s10(spark: SparkSession, d: str) -> DataFrame:
    missing = F.array_repeat(F.lit(float("nan")).cast("float"), 64)
    read = F.when(F.col("idx") % 9 != 0, F.col("image"))
    return A.images(spark, d).select("idx", I.n_missing(F.coalesce(read, missing)).alias("n_nan"))


@query("s11_aligned_stack", "SELECT CAST(r.i AS BIGINT) AS idx, i.idx IS NULL AS missing FROM range((SELECT max(idx) + 20 FROM images)) r(i) LEFT JOIN (SELECT idx FROM images WHERE idx % 11 <> 0) i ON i.idx = r.i")
def s11(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d)
    n = im.agg(F.max("idx")).first()[0] + 20
    there = im.where("idx % 11 <> 0").select("idx", F.lit(True).alias("_there"))
    return spark.range(n).select(F.col("id").alias("idx")).join(there, "idx", "left").select("idx", F.col("_there").isNull().alias("missing"))


@query("s23_peaks", "SELECT idx, round(list_max(image)::DOUBLE, 6) AS peak FROM images")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", r6(F.array_max("image").cast("double"), "peak"))


@query("s24_seeded_subset", f"SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY {uniform_sql('idx', '17')}, idx) AS r FROM images) WHERE r <= 100")
def s24(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", uniform(F.col("idx"), F.lit(17)).alias("u")).orderBy("u", "idx").limit(100).select("idx")


@query("s26_slice", "SELECT idx, grp FROM images WHERE idx IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def s26(spark: SparkSession, d: str) -> DataFrame:
    wanted = A.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("idx"))
    return A.images(spark, d).select("idx", "grp").join(wanted, "idx", "left_semi")


@query("s27_ordered_by_peak", "SELECT idx, CAST(row_number() OVER (PARTITION BY grp ORDER BY list_max(image) DESC, idx) AS INTEGER) AS place FROM images")
def s27(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("grp").orderBy(F.desc("top"), "idx")
    return A.images(spark, d).select("idx", "grp", F.array_max("image").alias("top")).select("idx", F.row_number().over(w).alias("place"))


@query("s28_measurement_bundle", "SELECT idx, round(list_max(image)::DOUBLE, 6) AS peak, e.value, e.user_id FROM images JOIN events e ON e.event_id = idx")
def s28(spark: SparkSession, d: str) -> DataFrame:
    values = A.read(spark, d, "events").select(F.col("event_id").alias("idx"), "value", "user_id")
    return A.images(spark, d).select("idx", r6(F.array_max("image").cast("double"), "peak")).join(values, "idx")


@query("s29_peak_metadata", "SELECT idx, CAST(floor(idx / 100) * 100 AS BIGINT) AS bin, round(asinh(list_max(image)::DOUBLE / 2e-1), 6) AS peak_t FROM images")
def s29(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", (F.floor(F.col("idx") / 100) * 100).alias("bin"), r6(F.asinh(F.array_max("image").cast("double") / 0.2), "peak_t"))


@query("p23_linear_scale", "SELECT idx, round(list_sum(list_transform(image, lambda v: CAST(v AS DOUBLE)*25e-1)), 4) AS s FROM images")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.round(_sum(I.scaled(F.col("image"), 2.5)), 4).alias("s"))


@query("p24_asinh_scale", "SELECT idx, round(list_sum(list_transform(image, lambda v: 5e-1*asinh(CAST(v AS DOUBLE)/1e-1))), 4) AS s, true AS back FROM images")
def p24(spark: SparkSession, d: str) -> DataFrame:
    t = I.asinh_scaled(F.col("image"), 0.5, 0.1)
    back = F.zip_with(I.asinh_unscaled(t, 0.5, 0.1), F.col("image"), lambda a, b: F.abs(a - b.cast("double")) < 1e-6)
    return A.images(spark, d).select("idx", F.round(_sum(t), 4).alias("s"), F.forall(back, lambda x: x).alias("back"))


@query("p26_min_max", "SELECT idx, round(list_sum(list_transform(image, lambda v: CASE WHEN list_max(image) = list_min(image) THEN v::DOUBLE ELSE (greatest(v::DOUBLE, 0) - list_min(image)::DOUBLE)/(list_max(image)::DOUBLE - list_min(image)::DOUBLE) END)), 4) AS s FROM images")
def p26(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.round(_sum(I.min_max(F.col("image"))), 4).alias("s"))


@query("p27_rescaled", "SELECT idx, round(list_sum(list_transform(image, lambda v: v::DOUBLE * (2e0 / list_max(image)::DOUBLE))), 3) AS s FROM images WHERE list_max(image) > 1e-2")
def p27(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).where(F.array_max("image") > 0.01).select("idx", F.round(_sum(I.scaled(F.col("image"), F.try_divide(F.lit(2.0), F.array_max("image").cast("double")))), 3).alias("s"))


@query("p28_peak_flux", "SELECT idx, round(list_max(image)::DOUBLE*1000, 3) AS peak_mjy FROM images")
def p28(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.round(I.peak(F.col("image")).cast("double") * 1000, 3).alias("peak_mjy"))


@query("i01_missing_pixels", f"WITH {NAN_IMAGES} SELECT idx, CAST(n AS INTEGER) AS n, n = 64 AS broken, n > 0 AND n < 64 AS incomplete FROM (SELECT idx, len(list_filter(image, lambda v: isnan(v))) AS n FROM nan_images)")
def i01(spark: SparkSession, d: str) -> DataFrame:
    n = I.n_missing(F.col("image"))
    return nan_images(spark, d).select("idx", n.alias("n"), (n == F.size("image")).alias("broken"), ((n > 0) & (n < F.size("image"))).alias("incomplete"))


@query("i02_peak_mean_std", f"WITH {NAN_IMAGES}, f AS (SELECT idx, list_transform(list_filter(image, lambda v: NOT isnan(v)), lambda v: v::DOUBLE) AS a FROM nan_images) SELECT idx, round(list_max(a), 6) AS peak, round(list_avg(a), 6) AS mean, round(list_stddev_pop(a), 6) AS std FROM f")
def i02(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("image")
    return nan_images(spark, d).select("idx", r6(I.peak(c).cast("double"), "peak"), r6(I.mean(c), "mean"), r6(I.std(c), "std"))


@query("i03_positive_residual", "SELECT idx, round(list_sum(list_transform(image, lambda v: greatest(v::DOUBLE / 2e0, 0))), 5) AS s FROM images")
def i03(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.round(I.positive_sum(F.col("image"), 2.0), 5).alias("s"))


@query("i05_background")
def i05(spark: SparkSession, d: str) -> DataFrame:
    return imaging.map_images(A.images(spark, d), imaging.background, {"level": "double", "noise": "double"})


@query("i06_properties")
def i06(spark: SparkSession, d: str) -> DataFrame:
    return imaging.map_images(A.images(spark, d), lambda m: imaging.properties(m, 2.0), {"peak": "double", "total_flux": "double", "extent": "double", "n_components": "int"})


@query("i08_size_proxy", f"WITH {PX}, s AS (SELECT idx, median(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY idx) SELECT px.idx, round(sqrt(count(*) FILTER (v > m + 1*sd)), 6) AS size FROM px JOIN s ON s.idx = px.idx GROUP BY px.idx")
def i08(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d))
    s = px.groupBy("idx").agg(F.median("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return px.join(s, "idx").groupBy("idx").agg(r6(F.sqrt(F.count_if(F.col("v") > F.col("m") + F.col("sd"))), "size"))


@query("i09_ellipse_cover", "WITH g AS (SELECT a.idx, y, x FROM images a, range(16) t(y), range(16) s(x)), e AS (SELECT idx, 4 + idx % 8 AS cx, 5 + idx % 6 AS cy, 3e0 + idx % 4 AS a, 2e0 AS b, radians((idx * 17 % 180)*1e0) AS t FROM images) SELECT g.idx, count(*) AS n FROM g JOIN e ON e.idx = g.idx WHERE pow(((x-cx)*cos(t)+(y-cy)*sin(t))/a, 2) + pow((-(x-cx)*sin(t)+(y-cy)*cos(t))/b, 2) <= 1 GROUP BY g.idx")
def i09(spark: SparkSession, d: str) -> DataFrame:
    e = A.images(spark, d).select("idx", (4 + F.col("idx") % 8).alias("cx"), (5 + F.col("idx") % 6).alias("cy"), (3.0 + F.col("idx") % 4).alias("a"), F.lit(2.0).alias("b"), F.radians((F.col("idx") * 17 % 180).cast("double")).alias("t"))
    grid = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    dx, dy, t = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("t")
    inside = F.pow((dx * F.cos(t) + dy * F.sin(t)) / F.col("a"), 2) + F.pow((-dx * F.sin(t) + dy * F.cos(t)) / F.col("b"), 2) <= 1
    return grid.where(inside).groupBy("idx").agg(F.count("*").alias("n"))


@query("i10_islands", f"""WITH RECURSIVE {PX}, m AS (SELECT idx, y, x, y * 8 + x AS p FROM px WHERE v > 1e-1),
r AS (SELECT idx, p, p AS l FROM m UNION SELECT b.idx, b.p, r.l FROM r JOIN m a ON a.idx = r.idx AND a.p = r.p JOIN m b ON b.idx = a.idx AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE r.l < b.p)
SELECT idx, CAST(count(DISTINCT l) AS INTEGER) AS n FROM (SELECT idx, p, min(l) AS l FROM r GROUP BY idx, p) GROUP BY idx""")
def i10(spark: SparkSession, d: str) -> DataFrame:
    found = imaging.map_images(A.images(spark, d), lambda m: (int(imaging.labels(m.astype("float32") > 0.1).max()),), {"n": "int"})
    return found.where("n > 0").select("idx", "n")


@query("i12_widest", f"WITH {PX}, m AS (SELECT * FROM px WHERE v > 15e-2) SELECT a.idx, round(sqrt(max((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))), 6) AS widest FROM m a JOIN m b ON a.idx = b.idx GROUP BY a.idx")
def i12(spark: SparkSession, d: str) -> DataFrame:
    got = imaging.map_images(A.images(spark, d), lambda m: (imaging.widest(m > 0.15), bool((m > 0.15).any())), {"w": "double", "some": "boolean"})
    return got.where("some").select("idx", r6(F.col("w"), "widest"))


@query("i13_full_neighbours", f"WITH {PX}, s AS (SELECT *, v > 0 AND coalesce(lag(v) OVER a, 0) > 0 AND coalesce(lead(v) OVER a, 0) > 0 AND coalesce(lag(v) OVER b, 0) > 0 AND coalesce(lead(v) OVER b, 0) > 0 AS full_ FROM px WINDOW a AS (PARTITION BY idx, x ORDER BY y), b AS (PARTITION BY idx, y ORDER BY x)) SELECT idx, count(*) FILTER (full_) AS n_full, count(*) FILTER (full_) < 5 AS bad FROM s GROUP BY idx")
def i13(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d))
    a, b = Window.partitionBy("idx", "x").orderBy("y"), Window.partitionBy("idx", "y").orderBy("x")
    near = lambda w: (F.coalesce(F.lag("v").over(w), F.lit(0.0)) > 0) & (F.coalesce(F.lead("v").over(w), F.lit(0.0)) > 0)
    full = px.withColumn("full", (F.col("v") > 0) & near(a) & near(b))
    return full.groupBy("idx").agg(F.count_if("full").alias("n_full"), (F.count_if("full") < 5).alias("bad"))


@query("i14_flood_fill")
def i14(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    def measure(m: np.ndarray) -> tuple:
        y, x = np.indices(m.shape)
        own = (x - 3) ** 2 + (y - 3) ** 2 <= 2
        mask = imaging.flood_mask(m, own, (x > 6) & (y > 6), max(0.1, np.nanmax(m) / 5))
        return imaging.widest(mask) * 1.5, float(m[mask].sum())

    return imaging.map_images(A.images(spark, d), measure, {"size": "double", "flux": "double"})


@query("i15_block_means", "SELECT idx, list_transform(range(4), lambda k: round(list_sum(list_transform(range(16), lambda j: image[((k // 2) * 4 + j // 4) * 8 + (k % 2) * 4 + j % 4 + 1]::DOUBLE)) / 16, 5)) AS means FROM images")
def i15(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.transform(I.block_means(F.col("image"), 8, 2), lambda v: I.rounded(v, 5)).alias("means"))


@query("i18_half_light", f"WITH {PX}, w AS (SELECT idx, v, y * 8 + x AS p, coalesce(sum(v) OVER (PARTITION BY idx ORDER BY v DESC, y * 8 + x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(v) OVER (PARTITION BY idx) AS total FROM px WHERE v > 0) SELECT idx, count(*) AS n FROM w WHERE before <= total / 2 GROUP BY idx")
def i18(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d)).where("v > 0")
    w = Window.partitionBy("idx").orderBy(F.desc("v"), F.col("y") * 8 + F.col("x")).rowsBetween(Window.unboundedPreceding, -1)
    run = px.withColumns({"before": F.coalesce(F.sum("v").over(w), F.lit(0.0)), "total": F.sum("v").over(Window.partitionBy("idx"))})
    return run.where(F.col("before") <= F.col("total") / 2).groupBy("idx").agg(F.count("*").alias("n"))


@query("i19_turned", "SELECT idx, round(list_sum(list_transform(range(64), lambda k: image[k + 1]::DOUBLE * CASE idx % 4 WHEN 0 THEN k WHEN 1 THEN (7 - k % 8) * 8 + k // 8 WHEN 2 THEN 63 - k ELSE (k % 8) * 8 + 7 - k // 8 END)), 3) AS s FROM images")
def i19(spark: SparkSession, d: str) -> DataFrame:
    t = I.turned(F.col("image"), 8, (F.col("idx") % 4).cast("int"), F.lit(False))
    return A.images(spark, d).select("idx", F.round(_sum(F.transform(t, lambda v, k: v.cast("double") * k)), 3).alias("s"))


@query("j10_nearest_neighbour", "SELECT a.idx AS q, round(sqrt(min(list_sum(list_transform(list_zip(a.image, b.image), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE)*(z[1]::DOUBLE - z[2]::DOUBLE))))), 5) AS distance FROM images a JOIN images b ON a.grp = 0 AND b.grp <> 0 GROUP BY a.idx")
def j10(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d)
    return nearest(im.where("grp = 0"), im.where("grp <> 0"), "idx", "image").select("q", F.round("distance", 5).alias("distance"))


#: Images as vectors of 4 x 4 block means over the peak; the nearest of grp >= 2 to those of grp 0 (generated) and 1 (held out).
MEMORY_SQL = """
bm AS (SELECT idx, grp, list_transform(range(16), lambda k: list_sum(list_transform(range(4), lambda j: image[((k // 4) * 2 + j // 2) * 8 + (k % 4) * 2 + j % 2 + 1]::DOUBLE / list_max(image)::DOUBLE)) / 4) AS v FROM images),
nn AS (SELECT a.grp, a.idx, min(list_distance(a.v, b.v)) AS d FROM bm a JOIN bm b ON a.grp < 2 AND b.grp >= 2 GROUP BY a.grp, a.idx),
ns AS (SELECT median(d) FILTER (grp = 0) AS gm, quantile_cont(d, 5e-2) FILTER (grp = 0) AS g5, median(d) FILTER (grp = 1) AS vm FROM nn),
nw AS (SELECT sum(abs(fa - fb) * gap) AS w1 FROM (SELECT sum(sum(CASE WHEN grp = 0 THEN 1 ELSE 0 END)) OVER w / (SELECT count(*) FROM nn WHERE grp = 0) AS fa, sum(sum(CASE WHEN grp = 1 THEN 1 ELSE 0 END)) OVER w / (SELECT count(*) FROM nn WHERE grp = 1) AS fb, lead(d) OVER w - d AS gap FROM nn GROUP BY d WINDOW w AS (ORDER BY d))),
memory AS (SELECT 'gen_nn_median' AS metric, gm AS value FROM ns UNION ALL SELECT 'gen_nn_p05', g5 FROM ns UNION ALL SELECT 'val_nn_median', vm FROM ns UNION ALL SELECT 'median_ratio_gen_over_val', gm / (vm + 1e-30) FROM ns UNION ALL SELECT 'w1_gen_vs_val', w1 FROM nw)"""


def memorisation(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d).select("idx", "grp", I.block_means(I.peak_normalised(F.col("image")), 8, 4).alias("v"))
    return memorisation_report(im.where("grp = 0"), im.where("grp >= 2"), im.where("grp = 1"), "idx", "v")


@query("j10_memorisation", f"WITH {MEMORY_SQL} SELECT metric, round(value, 5) AS value FROM memory")
def j10_memorisation(spark: SparkSession, d: str) -> DataFrame:
    return memorisation(spark, d).select("metric", F.round("value", 5).alias("value"))


_PAIR = "list_sum(list_transform(list_zip(a.image, b.image), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE)*(z[1]::DOUBLE - z[2]::DOUBLE)))"
_KNN = f"g AS (SELECT idx, image FROM images WHERE grp = 1), o AS (SELECT idx, image FROM images WHERE grp = 2), pr AS (SELECT a.idx AS q, row_number() OVER (PARTITION BY a.idx ORDER BY {_PAIR}, b.idx) AS r, sqrt({_PAIR}) AS d FROM g a JOIN g b ON a.idx <> b.idx)"
@query("j11_knn_radius", f"WITH {_KNN} SELECT q, round(d, 5) AS radius FROM pr WHERE r = 5")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return kth_distance(A.images(spark, d).where("grp = 1"), "idx", "image", 5).select("q", F.round("distance", 5).alias("radius"))


@query("b20_density_coverage", f"WITH {_KNN}, rad AS (SELECT q, d AS radius FROM pr WHERE r = 5), hit AS (SELECT b.idx, count(*) FILTER (sqrt({_PAIR}) <= radius) AS n FROM o a, g b JOIN rad ON rad.q = b.idx GROUP BY b.idx) SELECT round(sum(n) / (5e0 * (SELECT count(*) FROM o)), 6) AS density, round(avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM hit")
def b20(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d)
    return density_coverage(im.where("grp = 1"), im.where("grp = 2"), "idx", "image", 5).select(r6(F.col("density"), "density"), r6(F.col("coverage"), "coverage"))


#: The other set: copies with noise below the tolerance, scaled images, and images with one pixel moved.
_NOISED = "CASE idx % 3 WHEN 0 THEN list_transform(image, lambda v: v::DOUBLE + 1e-8) WHEN 1 THEN list_transform(image, lambda v: v::DOUBLE * 101e-2) ELSE list_transform(range(64), lambda k: image[k + 1]::DOUBLE + CASE WHEN k = 5 THEN 5e-2 ELSE 0e0 END) END"


@query("j12_pixel_match", f"""WITH qs AS (SELECT idx, list_transform(image, lambda v: v::DOUBLE) AS v FROM images), bs AS (SELECT idx, {_NOISED} AS v FROM images),
qt AS (SELECT idx, v, list_sum(v) AS t FROM qs), bt AS (SELECT idx, v, list_sum(v) AS t, row_number() OVER (ORDER BY list_sum(v), idx) AS r FROM bs),
ce AS (SELECT q.idx, arg_min(b.r, struct_pack(d := abs(b.t - q.t), low := b.t < q.t, r := CASE WHEN b.t < q.t THEN -b.r ELSE b.r END)) AS c FROM qt q, bt b GROUP BY q.idx),
ca AS (SELECT q.idx AS q, b.idx AS b, b.r, list_aggregate(list_transform(list_zip(b.v, q.v), lambda z: abs(z[1] - z[2]) <= 1e-6 + 1e-5 * abs(z[2])), 'bool_and') AS same, list_sum(list_transform(list_zip(b.v, q.v), lambda z: abs(z[1] - z[2]))) AS diff FROM ce JOIN qt q ON q.idx = ce.idx JOIN bt b ON b.r BETWEEN ce.c - 10 AND ce.c + 10),
be AS (SELECT q, bool_or(same) AS matched, arg_min(b, r) FILTER (same) AS m, arg_min(b, struct_pack(d := diff, r := r)) AS n, min(diff) AS diff FROM ca GROUP BY q)
SELECT q, coalesce(m, n) AS b, matched, CASE WHEN matched THEN 0e0 ELSE round(diff, 5) END AS difference FROM be""")
def j12_pixels(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d)
    v = F.transform("image", lambda x: x.cast("double"))
    noised = F.when(F.col("idx") % 3 == 0, F.transform(v, lambda x: x + 1e-8)).when(F.col("idx") % 3 == 1, F.transform(v, lambda x: x * 1.01)).otherwise(F.transform(v, lambda x, k: x + F.when(k == 5, 0.05).otherwise(0.0)))
    return match(im.select("idx", v.alias("image")), im.select("idx", noised.alias("image")), "idx", "image").select("q", "b", "matched", F.round("difference", 5).alias("difference"))


@query("w03_kth_smallest", f"WITH {_KNN} SELECT q, round(d, 5) AS d FROM pr WHERE r = 3")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return kth_distance(A.images(spark, d).where("grp = 1"), "idx", "image", 3).select("q", F.round("distance", 5).alias("d"))


@query("w05_neighbour_pixels", f"WITH {PX} SELECT idx, y, x, round(lag(v) OVER (PARTITION BY idx, x ORDER BY y), 6) AS above, round(lead(v) OVER (PARTITION BY idx, y ORDER BY x), 6) AS right_ FROM px")
def w05(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d))
    return px.select("idx", "y", "x", r6(F.lag("v").over(Window.partitionBy("idx", "x").orderBy("y")), "above"), r6(F.lead("v").over(Window.partitionBy("idx", "y").orderBy("x")), "right_"))


@query("b12_mad_noise", f"WITH {PX}, m AS (SELECT median(v) AS m FROM px) SELECT round(14826e-4 * median(abs(v - m)), 6) AS noise FROM px, m")
def b12(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d)).select("v")
    return px.groupBy().agg(r6(1.4826 * F.lit(mad(px, "v")), "noise"))


@query("b13_linear_fit", f"WITH {PX} SELECT round(5e-1 / stddev_pop(v), 6) AS k FROM px")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return imaging.pixels(A.images(spark, d)).agg(r6(0.5 / F.stddev_pop("v"), "k"))


@query("b14_asinh_fit", f"WITH {PX}, m AS (SELECT median(v) AS m FROM px), n AS (SELECT 3 * 14826e-4 * median(abs(v - m)) AS beta FROM px, m) SELECT round(any_value(beta), 6) AS beta, round(5e-1 / stddev_pop(asinh(v / beta)), 6) AS k, round(avg(CASE WHEN abs(v) < beta THEN 1e0 ELSE 0e0 END), 6) AS linear_share FROM px, n")
def b14(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d)).select("v")
    beta = F.lit(3 * 1.4826 * mad(px, "v"))
    return px.groupBy().agg(r6(beta, "beta"), r6(0.5 / F.stddev_pop(F.asinh(F.col("v") / beta)), "k"), r6(F.avg((F.abs("v") < beta).cast("double")), "linear_share"))


@query("b15_round_trip", f"WITH {PX} SELECT count(*) AS n, max(abs(1e-1*sinh(5e-1*asinh(v/1e-1)/5e-1) - v)) < 1e-9 AS exact, round(sum(5e-1*asinh(v/1e-1)), 4) AS total FROM px")
def b15(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    t = Asinh(0.5, 0.1)
    return imaging.pixels(A.images(spark, d)).agg(F.count("*").alias("n"), (F.max(F.abs(t.inverse(t.forward(v)) - v)) < 1e-9).alias("exact"), F.round(F.sum(t.forward(v)), 4).alias("total"))


@query("s20_stored_transform", f"WITH {PX}, k AS (SELECT 5e-1 / stddev_pop(asinh(v / 3e-1)) AS k FROM px) SELECT idx, round(sum(k * asinh(v / 3e-1)), 4) AS s FROM px, k GROUP BY idx")
def s20(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d))
    path = storage.shared_path(spark, "transform")
    transforms.save_transform(spark, transforms.fitted(px, "v", "asinh", 0.5, 0.1), path)
    t = transforms.load_transform(spark, path)
    return px.groupBy("idx").agg(F.round(F.sum(t.forward(F.col("v"))), 4).alias("s"))


@query("v04_transforms_by_name", f"WITH {PX} SELECT 'asinh' AS name, idx, round(sum(5e-1 * asinh(v / 1e-1)), 4) AS s FROM px GROUP BY idx UNION ALL SELECT 'linear', idx, round(sum(25e-1 * v), 4) FROM px GROUP BY idx")
def v04(spark: SparkSession, d: str) -> DataFrame:
    px = imaging.pixels(A.images(spark, d))
    known = [transforms.transform_of(x) for x in ({"name": "asinh", "k": 0.5, "beta": 0.1}, {"name": "linear", "k": 2.5})]
    sums = px.groupBy("idx").agg(*(F.round(F.sum(t.forward(F.col("v"))), 4).alias(t.name) for t in known))
    return sums.unpivot("idx", [t.name for t in known], "name", "s")


@query("m03_injection")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return imaging.inject(A.images(spark, d))


@query("m20_paired_columns", "SELECT 'even' AS set_, idx, round(list_max(image)::DOUBLE, 6) AS peak, round(list_sum(list_transform(image, lambda v: v::DOUBLE)), 5) AS total FROM images WHERE idx % 2 = 0 UNION ALL SELECT 'odd', idx, round(list_max(image)::DOUBLE, 6), round(list_sum(list_transform(image, lambda v: v::DOUBLE)), 5) FROM images WHERE idx % 2 = 1")
def m20(spark: SparkSession, d: str) -> DataFrame:
    im = A.images(spark, d).select("idx", r6(F.array_max("image").cast("double"), "peak"), F.round(I.total(F.col("image")), 5).alias("total"))
    pick = lambda k, n: im.where(F.col("idx") % 2 == k).select(F.lit(n).alias("set_"), "idx", "peak", "total")
    return pick(0, "even").unionByName(pick(1, "odd"))
