"""Queries on joins, bins, distributions, sizes, completeness and luminosity functions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.curves import CurveFit
from ..operators import binning as B
from ..operators import cosmology, dist, evaluate, fitting, rlf, sizing, skyjoin
from ..operators.distribution import Distribution, distribution_of
from ..operators.interp import interp_sql, interpolate
from ..operators.quantiles import quantile_table
from ..sources import adapters as A
from .registry import query

GRID = cosmology.grid()
FIT = CurveFit("sigmoid", "log10", (0.2, 6.0, 0.95, 0.02))
EDGES = B.log_edges(0.1, 10.0, 15)


def r6(c, name: str, n: int = 6):
    return F.round(c, n).alias(name)


def _list(edges) -> str:
    return "[" + ", ".join(f"{float(e)!r}::DOUBLE" for e in edges) + "]"


def bin_sql(x: str, edges, closed: bool = False) -> str:
    n = len(edges) - 1
    upper = f"{x} <= {float(edges[-1])!r}::DOUBLE" if closed else f"{x} < {float(edges[-1])!r}::DOUBLE"
    return f"CASE WHEN {x} >= {float(edges[0])!r}::DOUBLE AND {upper} THEN CAST(least(len(list_filter({_list(edges)}, lambda e: e <= {x})) - 1, {n - 1}) AS INTEGER) END"


def bins_sql(edges) -> str:
    rows = ", ".join(f"({i}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    return f"(SELECT CAST(bin AS INTEGER) AS bin, lo, hi FROM (VALUES {rows}) v(bin, lo, hi))"


# --- joins ------------------------------------------------------------------------------------------------------------


@query("j01_aligned", "SELECT a.event_id, round(a.value, 6) AS x, b.user_id, c.event_type FROM events a JOIN events b ON a.event_id = b.event_id AND b.event_id % 3 <> 1 JOIN events c ON c.event_id = a.event_id AND c.event_id % 5 <> 2 WHERE a.event_id % 2 = 0")
def j01(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    parts = [e.where("event_id % 2 = 0").select("event_id", r6(F.col("value"), "x")), e.where("event_id % 3 <> 1").select("event_id", "user_id"), e.where("event_id % 5 <> 2").select("event_id", "event_type")]
    return parts[0].join(parts[1], "event_id").join(parts[2], "event_id")


#: Cells only narrow the search; the last condition decides.
PAIRS = """pr AS (SELECT s.source_id, s.source_name, s.isl_rms, c.parent, c.peak,
  (c.ra - s.ra + 180 - 360*floor((c.ra - s.ra + 180)/360) - 180)*cos(radians(s.dec))*3600 AS x0, (c.dec - s.dec)*3600 AS y0,
  sqrt(pow(maj/2*sin(radians(pa)),2)+pow(min/2*cos(radians(pa)),2)) AS dx, sqrt(pow(maj/2*cos(radians(pa)),2)+pow(min/2*sin(radians(pa)),2)) AS dy
  FROM sky_sources s JOIN (SELECT *, floor(dec/5e-2) + k AS band FROM sky_components, (VALUES (-1),(0),(1)) t(k)) c ON floor(s.dec/5e-2) = c.band AND abs(c.dec - s.dec) < 5e-2),
hit AS (SELECT * FROM pr WHERE abs(x0) <= 60 + dx AND abs(y0) <= 60 + dy)"""
FOREIGN = PAIRS + """, fo AS (SELECT *, CASE WHEN isl_rms > 0 THEN peak/isl_rms ELSE 0e0 END AS snr FROM hit WHERE parent <> source_name),
fg AS (SELECT source_id, count(*) AS n, count(*) FILTER (snr >= 5) AS nd, max(peak) AS bf, max(struct_pack(peak := peak, snr := snr, parent := parent)) AS b FROM fo GROUP BY source_id)"""


@query("j02_foreign_components", f"WITH {FOREIGN} SELECT s.source_id, coalesce(n, 0) AS n_foreign_components, coalesce(nd, 0) AS n_foreign_detected, coalesce(bf, 0e0) AS brightest_foreign_flux, coalesce(b.snr, 0e0) AS brightest_foreign_snr, coalesce(b.parent, '') AS brightest_foreign_parent, coalesce(nd, 0) > 0 AS foreign_contaminant FROM sky_sources s LEFT JOIN fg ON fg.source_id = s.source_id")
def j02(spark: SparkSession, d: str) -> DataFrame:
    f = skyjoin.foreign_flags(A.sources(spark, d), A.components(spark, d))
    return f.select("source_id", "n_foreign_components", "n_foreign_detected", "brightest_foreign_flux", "brightest_foreign_snr", "brightest_foreign_parent", "foreign_contaminant")


CROPPED = """ow AS (SELECT s.source_id, (c.ra - s.ra + 180 - 360*floor((c.ra - s.ra + 180)/360) - 180)*cos(radians(s.dec))*3600 AS x0, (c.dec - s.dec)*3600 AS y0,
  sqrt(pow(maj/2*sin(radians(pa)),2)+pow(min/2*cos(radians(pa)),2)) AS dx, sqrt(pow(maj/2*cos(radians(pa)),2)+pow(min/2*sin(radians(pa)),2)) AS dy FROM sky_sources s JOIN sky_components c ON c.parent = s.source_name),
cr AS (SELECT source_id, count(*) AS n, min(x0-dx) AS xl, max(x0+dx) AS xh, min(y0-dy) AS yl, max(y0+dy) AS yh FROM ow GROUP BY source_id)"""


@query("j03_cropped", f"WITH {CROPPED} SELECT s.source_id, coalesce(n, 0) AS n_own_components, coalesce(xl < -60 OR xh > 60 OR yl < -60 OR yh > 60, false) AS cropped, round(coalesce(greatest(xh-xl, yh-yl), 0e0), 4) AS own_extent FROM sky_sources s LEFT JOIN cr ON cr.source_id = s.source_id")
def j03(spark: SparkSession, d: str) -> DataFrame:
    return skyjoin.cropped_flags(A.sources(spark, d), A.components(spark, d)).select("source_id", "n_own_components", "cropped", r6(F.col("own_extent"), "own_extent", 4))


@query("j04_name_lookup", "SELECT o_orderkey, coalesce(c_mktsegment, '') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def j04(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders").withColumn("name", F.col("o_custkey").cast("string"))
    c = A.read(spark, d, "customer").where("c_custkey % 3 <> 0").withColumn("cname", F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    return skyjoin.lookup(o, "name", c, "cname", "c_mktsegment", "segment").select("o_orderkey", "segment")


@query("j06_quality_table", f"WITH {FOREIGN}, {CROPPED} SELECT s.source_id, coalesce(nd, 0) > 0 AS foreign_contaminant, coalesce(xl < -60 OR xh > 60 OR yl < -60 OR yh > 60, false) AS cropped, t.id_name IS NOT NULL AND t.id_name = s.id_name AS optical_missplit FROM sky_sources s LEFT JOIN fg ON fg.source_id = s.source_id LEFT JOIN cr ON cr.source_id = s.source_id LEFT JOIN sky_sources t ON t.source_name = b.parent")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return skyjoin.quality_table(A.sources(spark, d), A.components(spark, d)).select("source_id", "foreign_contaminant", "cropped", "optical_missplit")


@query("j07_components_per_source", "SELECT o_orderkey, count(l_orderkey) AS n, round(coalesce(sum(l_extendedprice), 0), 2) AS flux FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j07(spark: SparkSession, d: str) -> DataFrame:
    lists = A.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("flux"))).alias("comps"))
    j = A.read(spark, d, "orders").select("o_orderkey").join(lists, "o_orderkey", "left").withColumn("comps", F.coalesce("comps", F.array().cast("array<struct<flux:double>>")))
    return j.select("o_orderkey", F.size("comps").cast("long").alias("n"), r6(F.aggregate("comps", F.lit(0.0), lambda a, c: a + c["flux"]), "flux", 2))


@query("j08_interpolation", f"SELECT l_orderkey, l_partkey, l_suppkey, round({interp_sql('z_best', GRID.z, GRID.volume)} / 1e9, 6) AS volume FROM catalog WHERE NOT isnan(z_best)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return interpolate(A.catalog(spark, d).where(~F.isnan("z_best")), "z_best", GRID.z, GRID.volume, "v").select("l_orderkey", "l_partkey", "l_suppkey", r6(F.col("v") / 1e9, "volume"))


@query("j09_frame_components", f"WITH {PAIRS} SELECT source_id, parent, round(x0, 4) AS x0, round(y0, 4) AS y0 FROM hit WHERE source_id = (SELECT min(source_id) FROM sky_sources)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    s = A.sources(spark, d)
    one = s.orderBy("source_id").limit(1)
    return skyjoin.neighbours(one, A.components(spark, d)).select("source_id", "parent", r6(F.col("x0"), "x0", 4), r6(F.col("y0"), "y0", 4))


@query("j12_rank_band_match", "WITH s AS (SELECT idx, list_sum(list_transform(image, lambda v: v::DOUBLE)) AS t FROM images), r AS (SELECT idx, t, row_number() OVER (ORDER BY t, idx) AS r FROM s) SELECT a.idx, min(abs(a.t - b.t)) < 1e-3 AS matched, count(*) AS n FROM r a JOIN r b ON b.r BETWEEN a.r - 10 AND a.r + 10 AND a.idx <> b.idx GROUP BY a.idx")
def j12(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.images import total

    s = A.images(spark, d).select("idx", total(F.col("image")).alias("t"))
    ranked = dist.ranked(s, ["t", "idx"], "r")
    near = ranked.select(F.col("idx").alias("j"), F.col("t").alias("u"), F.explode(F.sequence(F.col("r") - 10, F.col("r") + 10)).alias("r"))
    return ranked.join(near, "r").where("idx <> j").groupBy("idx").agg((F.min(F.abs(F.col("t") - F.col("u"))) < 1e-3).alias("matched"), F.count("*").alias("n"))


@query("j13_tolerance_join", "SELECT a.source_id, count(*) AS n FROM sky_sources a JOIN (SELECT source_id, ra + 1e-12 AS ra, dec - 1e-12 AS dec FROM sky_sources) b ON abs(a.ra - b.ra) < 1e-10 AND abs(a.dec - b.dec) < 1e-10 AND a.source_id = b.source_id GROUP BY a.source_id")
def j13(spark: SparkSession, d: str) -> DataFrame:
    s = A.sources(spark, d)
    key = lambda c, k: (F.round(F.col(c) * 1e6).cast("long") + k).alias("_" + c)
    moved = s.select(F.col("source_id").alias("other"), (F.col("ra") + 1e-12).alias("ra2"), (F.col("dec") - 1e-12).alias("dec2"))
    spread = moved.select("*", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1)))).alias("i")).withColumn("_ra", F.round(F.col("ra2") * 1e6).cast("long") + F.col("i")).select("*", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1)))).alias("j")).withColumn("_dec", F.round(F.col("dec2") * 1e6).cast("long") + F.col("j"))
    hit = s.select("source_id", "ra", "dec", key("ra", 0), key("dec", 0)).join(spread, ["_ra", "_dec"]).where((F.abs(F.col("ra") - F.col("ra2")) < 1e-10) & (F.abs(F.col("dec") - F.col("dec2")) < 1e-10) & (F.col("source_id") == F.col("other")))
    return hit.groupBy("source_id").agg(F.count("*").alias("n"))


@query("j14_trials_expansion", "SELECT event_id, CAST(t AS INTEGER) AS trial FROM events, range(5) r(t)")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial"))


# --- bins and aggregates ----------------------------------------------------------------------------------------------


@query("b01_flux_bins", f"SELECT event_id, {bin_sql('value', EDGES)} AS bin FROM events")
def b01(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", B.bin_of(F.col("value"), EDGES).alias("bin"))


@query("b02_completeness", f"WITH g AS (SELECT {bin_sql('mock_flux', EDGES)} AS bin, count(*) AS n, count(*) FILTER (detectable) AS nd FROM trials GROUP BY 1) SELECT b.bin, lo, hi, coalesce(n, 0) AS n, coalesce(nd, 0) AS n_detected, coalesce(nd * 1e0 / n, 0e0) AS completeness FROM {bins_sql(EDGES)} b LEFT JOIN g ON g.bin = b.bin")
def b02(spark: SparkSession, d: str) -> DataFrame:
    return B.completeness_per_bin(A.trials(spark, d), EDGES)


def completeness_against_published(spark: SparkSession, d: str) -> DataFrame:
    """Completeness per flux bin beside the published curve at the bin's centre."""
    got = B.completeness_per_bin(A.trials(spark, d), EDGES).withColumn("centre", (F.col("lo") + F.col("hi")) / 2)
    return interpolate(got, "centre", rlf.PUBLISHED_FLUX, rlf.PUBLISHED_SHARE, "published").select("bin", "n", "n_detected", r6(F.col("completeness"), "completeness"), r6(F.col("published"), "published"))


query("m04_completeness_curve", f"WITH g AS (SELECT {bin_sql('mock_flux', EDGES)} AS bin, count(*) AS n, count(*) FILTER (detectable) AS nd FROM trials GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n, coalesce(nd, 0) AS n_detected, round(coalesce(nd * 1e0 / n, 0e0), 6) AS completeness, round({interp_sql('((lo + hi) / 2)', rlf.PUBLISHED_FLUX, rlf.PUBLISHED_SHARE)}, 6) AS published FROM {bins_sql(EDGES)} b LEFT JOIN g ON g.bin = b.bin")(completeness_against_published)


@query("b03_poisson_interval")
def b03(spark: SparkSession, d: str) -> DataFrame:
    got = B.completeness_per_bin(A.trials(spark, d), EDGES).withColumn("i", fitting.poisson_interval(F.col("n_detected").cast("double")))
    return got.select("bin", "n", r6(F.col("i.lo"), "lo"), r6(F.col("i.hi"), "hi"), r6(F.coalesce(F.try_divide(F.col("i.hi") - F.col("i.lo"), F.col("n")), F.lit(0.0)), "err_full"))


ZE, LE = B.linear_edges(0.0, 1.2, 7), B.linear_edges(21.0, 28.0, 8)
GRIDC = f"g AS (SELECT {bin_sql('z_best', ZE)} AS iz, {bin_sql('log10(l_144)', LE)} AS il, resolved FROM catalog WHERE NOT isnan(z_best))"
ALL_CELLS = "al AS (SELECT CAST(i AS INTEGER) AS iz, CAST(j AS INTEGER) AS il FROM range(6) a(i), range(7) b(j))"


@query("b04_root_n", f"WITH {GRIDC} SELECT iz, il, round(sqrt(count(*)), 6) AS half FROM g WHERE iz IS NOT NULL AND il IS NOT NULL GROUP BY iz, il")
def b04(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).where("n > 0").select("iz", "il", r6(F.sqrt("n"), "half"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).where(~F.isnan("z_best")).withColumns({"z": F.col("z_best"), "lum": F.col("l_144")})


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return rlf.counts(_catalogue(spark, d), rlf.cells(spark, ZE, LE, GRID), ZE, LE)


@query("b05_grid_counts", f"WITH {GRIDC}, {ALL_CELLS}, n AS (SELECT iz, il, count(*) AS n, count(*) FILTER (resolved) AS r FROM g GROUP BY iz, il) SELECT al.iz, al.il, coalesce(n, 0) AS n, coalesce(r, 0) AS n_resolved, coalesce(n, 0) - coalesce(r, 0) AS n_other FROM al LEFT JOIN n ON n.iz = al.iz AND n.il = al.il")
def b05(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("iz", "il", "n", "n_resolved", "n_other")


@query("b06_samples_per_bin", f"SELECT bin, count(*) AS n FROM (SELECT {bin_sql('value', EDGES)} AS bin FROM events) WHERE bin IS NOT NULL GROUP BY bin")
def b06(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").withColumn("bin", B.bin_of(F.col("value"), EDGES)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


HE = B.linear_edges(0.0, 100.0, 21)


@query("b07_histogram", f"WITH n AS (SELECT {bin_sql('value', HE, True)} AS bin, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS t FROM n WHERE bin IS NOT NULL) SELECT b.bin, round(coalesce(n, 0) / (t * (hi - lo)), 8) AS value, round(sqrt(coalesce(n, 0)) / (t * (hi - lo)), 8) AS error FROM {bins_sql(HE)} b LEFT JOIN n ON n.bin = b.bin, t")
def b07(spark: SparkSession, d: str) -> DataFrame:
    return B.histogram(A.read(spark, d, "events"), F.col("value"), HE, "density").select("bin", r6(F.col("value"), "value", 8), r6(F.col("error"), "error", 8))


@query("b08_two_set_histograms", f"SELECT idx % 2 = 0 AS even, metric, bin, count(*) AS n FROM (SELECT idx, metric, {bin_sql('v', B.linear_edges(-1.0, 1.0, 21), True)} AS bin FROM (SELECT idx, 'peak' AS metric, list_max(image)::DOUBLE AS v FROM images UNION ALL SELECT idx, 'first', image[1]::DOUBLE FROM images)) WHERE bin IS NOT NULL GROUP BY ALL")
def b08(spark: SparkSession, d: str) -> DataFrame:
    edges = B.linear_edges(-1.0, 1.0, 21)
    wide = A.images(spark, d).select("idx", F.array_max("image").cast("double").alias("peak"), F.element_at("image", 1).cast("double").alias("first"))
    long = wide.unpivot("idx", ["peak", "first"], "metric", "v").withColumn("bin", B.bin_of(F.col("v"), edges, True)).where("bin IS NOT NULL")
    return long.groupBy((F.col("idx") % 2 == 0).alias("even"), "metric", "bin").agg(F.count("*").alias("n"))


@query("b09_cleaned_histogram", "WITH c AS (SELECT value FROM events WHERE value > 0), m AS (SELECT min(value) AS lo, max(value) AS hi FROM c) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 100)), 99) AS BIGINT) AS bin, count(*) AS n FROM c, m GROUP BY 1")
def b09(spark: SparkSession, d: str) -> DataFrame:
    c = dist.clean(A.read(spark, d, "events"), "value").select("value")
    m = c.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return c.crossJoin(F.broadcast(m)).groupBy(F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 100)), F.lit(99)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("b10_statistics", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 9e-1), 6) AS p90, round(quantile_cont(value, 95e-2), 6) AS p95, round(quantile_cont(value, 99e-2), 6) AS p99 FROM events")
def b10(spark: SparkSession, d: str) -> DataFrame:
    s = dist.statistics(A.read(spark, d, "events"), "value")
    return s.select("n", *(r6(F.col(c), c) for c in ("mean", "median", "std", "p90", "p95", "p99")))


def _histogram_sql(name: str, raw: str, share: float, log: bool) -> str:
    """Cleaned values of ``raw`` in all bins between the least and the greatest."""
    n, x = (99, "log10(v)") if log else (100, "v")
    return f"""(WITH r AS ({raw}), q AS (SELECT v FROM r WHERE v > 0 AND isfinite(v)), k AS (SELECT {x} AS x FROM q WHERE v < (SELECT quantile_cont(v, {share!r}::DOUBLE) FROM q)), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {n} AS w FROM k),
h AS (SELECT CAST(greatest(0, least(floor((x - lo) / w), {n - 1})) AS INTEGER) AS bin, count(*) AS n FROM k, e GROUP BY 1) SELECT '{name}' AS name, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range({n}) t(i) LEFT JOIN h ON h.bin = i)"""


_PRESETS = [("rms", "SELECT isl_rms AS v FROM catalog WHERE resolved", 0.95, False), ("las", "SELECT las AS v FROM catalog WHERE resolved", 0.98, False), ("peak_flux", "SELECT peak_flux AS v FROM catalog WHERE resolved", 0.98, True), ("redshift", "SELECT z_best AS v FROM catalog WHERE resolved", 0.98, False), ("peak_pixel", "SELECT list_max(image)::DOUBLE * 1000 AS v FROM images", 0.8, False)]


@query("b11_presets", " UNION ALL ".join("SELECT * FROM " + _histogram_sql(*p) for p in _PRESETS))
def b11(spark: SparkSession, d: str) -> DataFrame:
    tables = {"catalogue": A.catalog(spark, d), "images": A.images(spark, d)}
    each = [distribution_of(name, tables).histogram().select(F.lit(name).alias("name"), "bin", "n") for name, *_ in _PRESETS]
    return functools.reduce(DataFrame.unionByName, each)


class SignalToNoise(Distribution):
    """What a user writes: where the values come from; the rest is inherited."""

    share, log = 0.9, True

    def raw(self, tables):
        return tables["catalogue"].select(F.col("peak_flux") / F.col("isl_rms"))


_SNR = _histogram_sql("snr", "SELECT peak_flux / isl_rms AS v FROM catalog", 0.9, True)


@query("v05_user_distribution", f"SELECT bin, n FROM {_SNR}")
def v05(spark: SparkSession, d: str) -> DataFrame:
    return SignalToNoise({"catalogue": A.catalog(spark, d)}).histogram().select("bin", "n")


LAMS = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]


@query("b16_box_cox", "WITH e AS (SELECT value AS x FROM events WHERE value > 0) " + " UNION ALL ".join(f"SELECT {v!r}::DOUBLE AS lam, round(({v!r}::DOUBLE - 1)*sum(ln(x)) - count(*)/2e0*ln(var_pop({'ln(x)' if v == 0 else f'(pow(x, {v!r}::DOUBLE)-1)/{v!r}::DOUBLE'})), 3) AS loglik FROM e" for v in LAMS))
def b16(spark: SparkSession, d: str) -> DataFrame:
    return dist.box_cox(A.read(spark, d, "events"), "value", LAMS).select("lam", r6(F.col("loglik"), "loglik", 3))


@query("b16_fitted_power")
def b16_fitted(spark: SparkSession, d: str) -> DataFrame:
    """(name, kind, lam, n, mean, std): values, and values less their middle, of which some are negative; the fitted columns are standardised."""
    e = A.read(spark, d, "events").select("value", (F.col("value") - 20).alias("shifted"))
    out = []
    for name in ("value", "shifted"):
        fit = dist.fit_power(e, name)
        t = fit.column(F.col(name))
        out.append(e.agg(F.lit(name).alias("name"), F.lit(fit.kind).alias("kind"), F.lit(round(fit.lam, 4)).alias("lam"), F.count(t).alias("n"), r6(F.avg(t), "mean"), r6(F.stddev_pop(t), "std")))
    return functools.reduce(DataFrame.unionByName, out)


@query("b17_standardised", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type = 'click') SELECT event_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM events, s")
def b17(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    return dist.standardised(e.select("event_id", "value"), e.where("event_type = 'click'"), ["value"]).select("event_id", r6(F.col("value"), "value"))


@query("b18_wasserstein", "WITH v AS (SELECT value AS v, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY value), c AS (SELECT v, sum(a) OVER w / (SELECT sum(a) FROM v) AS fa, sum(b) OVER w / (SELECT sum(b) FROM v) AS fb, lead(v) OVER w - v AS gap FROM v WINDOW w AS (ORDER BY v)) SELECT round(sum(abs(fa - fb) * gap), 5) AS w1 FROM c")
def b18(spark: SparkSession, d: str) -> DataFrame:
    return dist.wasserstein(A.read(spark, d, "events"), "value", "event_type", "click", "view").select(r6(F.col("w1"), "w1", 5))


@query("b19_kernel_distance", "WITH f AS (SELECT event_type AS t, value/1e2 AS x, (user_id % 10)/1e1 AS y FROM events WHERE event_type IN ('click', 'view')), k AS (SELECT a.t AS ta, b.t AS tb, sum(pow((a.x*b.x+a.y*b.y)/2+1, 3)) AS s FROM f a, f b GROUP BY ALL), n AS (SELECT t, count(*) AS n, sum(pow((x*x+y*y)/2+1, 3)) AS d FROM f GROUP BY t) SELECT round((SELECT sum((s-d)/(n*(n-1e0))) FROM k JOIN n ON n.t = ta WHERE ta = tb) - 2*(SELECT s FROM k WHERE ta = 'click' AND tb = 'view')/(SELECT product(n) FROM n), 5) AS mmd2")
def b19(spark: SparkSession, d: str) -> DataFrame:
    f = A.read(spark, d, "events").select("event_type", (F.col("value") / 100).alias("x"), ((F.col("user_id") % 10) / 10).alias("y"))
    return dist.kernel_distance(f, ["x", "y"], "event_type", "click", "view").select(r6(F.col("mmd2"), "mmd2", 5))


_CAL = "c AS (SELECT log10(value) AS x, log10(value*(5e-1 + ((event_id*7919) % 1000)/1e3)) AS y FROM events WHERE value > 0 AND value*(5e-1 + ((event_id*7919) % 1000)/1e3) > 0)"


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").withColumn("measured", F.col("value") * (0.5 + (F.col("event_id") * 7919) % 1000 / 1000.0))


@query("b22_calibration", f"WITH {_CAL} SELECT count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 5) AS r2, round(pow(1e1, median(y - x)), 5) AS bias, round(stddev_pop(y - x), 5) AS scatter FROM c")
def b22(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(_calibrated(spark, d), "value", "measured").select("n", *(r6(F.col(c), c, 5) for c in ("slope", "intercept", "r2", "bias", "scatter")))


CE = B.linear_edges(-1.0, 2.0, 13)


@query("b23_calibration_curve", f"WITH {_CAL}, g AS (SELECT CAST(greatest(0, least(11, len(list_filter({_list(CE)}, lambda e: e <= x)) - 1)) AS INTEGER) AS bin, count(*) AS n, pow(1e1, median(y - x)) AS ratio, stddev_pop(y - x) AS scatter FROM c GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n, round(ratio, 5) AS ratio, round(scatter, 5) AS scatter FROM {bins_sql(CE)} b LEFT JOIN g ON g.bin = b.bin")
def b23(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration_curve(_calibrated(spark, d), "value", "measured", CE).select("bin", "n", r6(F.col("ratio"), "ratio", 5), r6(F.col("scatter"), "scatter", 5))


@query("b24_correlation", "SELECT round(corr(value, value*(5e-1 + ((event_id*7919) % 1000)/1e3)), 6) AS r FROM events")
def b24(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).agg(r6(F.corr("value", "measured"), "r"))


@query("b25_smoothed_density")
def b25(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d)
    return dist.smoothed_density(c, F.col("las"), F.col("mag_w2"), B.linear_edges(0, 150, 16), B.linear_edges(11.5, 14.0, 11))


@query("b26_subsample_with_count", f"SELECT l_orderkey, l_partkey, l_suppkey, n FROM (SELECT *, row_number() OVER (ORDER BY {dist.uniform_sql('l_orderkey', 'l_partkey', 'l_suppkey')}, l_orderkey, l_partkey, l_suppkey) AS r, count(*) OVER () AS n FROM catalog) WHERE r <= 200")
def b26(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d)
    few = c.withColumn("u", dist.uniform(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"))).orderBy("u", "l_orderkey", "l_partkey", "l_suppkey").limit(200)
    return few.select("l_orderkey", "l_partkey", "l_suppkey").crossJoin(c.agg(F.count("*").alias("n")))


@query("b27_class_summary", "SELECT resolved, count(*) AS n, count(*) FILTER (isnan(z_best)) AS n_missing, round(avg(z_best) FILTER (NOT isnan(z_best)), 6) AS mean, round(stddev_pop(z_best) FILTER (NOT isnan(z_best)), 6) AS std, round(min(z_best) FILTER (NOT isnan(z_best)), 6) AS low, round(max(z_best) FILTER (NOT isnan(z_best)), 6) AS high FROM catalog GROUP BY resolved")
def b27(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.sky import number

    z = number(F.col("z_best"))
    return A.catalog(spark, d).groupBy("resolved").agg(F.count("*").alias("n"), F.count_if(z.isNull()).alias("n_missing"), r6(F.avg(z), "mean"), r6(F.stddev_pop(z), "std"), r6(F.min(z), "low"), r6(F.max(z), "high"))


@query("b28_total_flux", "SELECT l_orderkey, round(sum(total_flux), 6) AS flux, round(sqrt(sum(isl_rms*isl_rms)), 6) AS error FROM catalog GROUP BY l_orderkey")
def b28(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).groupBy("l_orderkey").agg(r6(F.sum("total_flux"), "flux"), r6(F.sqrt(F.sum(F.col("isl_rms") * F.col("isl_rms"))), "error"))


@query("b29_size_intervals", "SELECT CAST(floor(las / 5) * 5 AS BIGINT) AS size, count(*) AS n FROM catalog GROUP BY 1")
def b29(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).groupBy((F.floor(F.col("las") / 5) * 5).alias("size")).agg(F.count("*").alias("n"))


@query("b30_reduced_chi2", "SELECT resolved, count(*) AS n, round(sum(pow((total_flux - peak_flux)/isl_rms, 2))/(count(*) - 4), 4) AS reduced FROM catalog GROUP BY resolved")
def b30(spark: SparkSession, d: str) -> DataFrame:
    return fitting.reduced_chi2(A.catalog(spark, d), ["resolved"], F.col("total_flux"), F.col("peak_flux"), F.col("isl_rms"), 4).select("resolved", "n", r6(F.col("reduced"), "reduced", 4))


# --- sizes ------------------------------------------------------------------------------------------------------------


@query("a21_brightest_share", "WITH w AS (SELECT *, coalesce(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) SELECT l_orderkey, count(*) AS n FROM w WHERE t > 0 AND b/t < 95e-2 GROUP BY l_orderkey")
def a21(spark: SparkSession, d: str) -> DataFrame:
    kept = sizing.brightest_share(A.read(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", ["l_partkey", "l_suppkey", "l_linenumber"])
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("a22_component_size")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return sizing.component_sizes(A.components(spark, d), "parent").where("n > 1").select("parent", r6(F.col("size"), "size", 3))


@query("a24_furthest_pair", "SELECT a.parent, round(max(pow((a.ra-b.ra)*3600, 2)+pow((a.dec-b.dec)*3600, 2)), 2) AS d2 FROM sky_components a JOIN sky_components b ON a.parent = b.parent AND abs(a.ra - b.ra) < 1 GROUP BY a.parent")
def a24(spark: SparkSession, d: str) -> DataFrame:
    c = A.components(spark, d).select("parent", "ra", "dec")
    o = c.select("parent", F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    d2 = F.pow((F.col("ra") - F.col("ra2")) * 3600, 2) + F.pow((F.col("dec") - F.col("dec2")) * 3600, 2)
    return c.join(o, "parent").where(F.abs(F.col("ra") - F.col("ra2")) < 1).groupBy("parent").agg(r6(F.max(d2), "d2", 2))


@query("a25_all_sizes")
def a25(spark: SparkSession, d: str) -> DataFrame:
    c = A.components(spark, d)
    return sizing.component_sizes(sizing.brightest_share(c, tie=["ra", "dec"]), "parent", counted=c)


@query("w01_running_sum", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def w01(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(F.sum("l_extendedprice").over(w), "running", 2))


@query("w02_brightest", "SELECT l_orderkey, max(l_extendedprice) AS flux FROM lineitem GROUP BY l_orderkey")
def w02(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("l_extendedprice", "l_partkey"), F.struct("l_extendedprice", -F.col("l_partkey")))
    return A.read(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", F.col("b.l_extendedprice").alias("flux"))


@query("w04_sorted_rank", "SELECT event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS r FROM events")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("r"))


@query("w06_cdf_gap", "SELECT event_type, round(sum(gap), 4) AS spread FROM (SELECT event_type, lead(value) OVER (PARTITION BY event_type ORDER BY value, event_id) - value AS gap FROM events) GROUP BY event_type")
def w06(spark: SparkSession, d: str) -> DataFrame:
    gap = F.lead("value").over(Window.partitionBy("event_type").orderBy("value", "event_id")) - F.col("value")
    return A.read(spark, d, "events").select("event_type", gap.alias("gap")).groupBy("event_type").agg(r6(F.sum("gap"), "spread", 4))


@query("w07_first_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(50).select("event_id", "value")


# --- sampling and estimates -------------------------------------------------------------------------------------------

SE, SC = B.linear_edges(0.0, 50.0, 6), [40, 30, 0, 20, 10]
_SHARE = [0.0, 0.4, 0.7, 0.7, 0.9, 1.0]


@query("m01_histogram_sample", f"SELECT event_id, round({interp_sql('u', [0.0, 0.4, 0.7, 0.9, 1.0], [0.0, 10.0, 20.0, 40.0, 50.0])}, 5) AS x FROM (SELECT event_id, {dist.uniform_sql('event_id', '3')} AS u FROM events)")
def m01(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").withColumn("u", dist.uniform(F.col("event_id"), F.lit(3)))
    return dist.sample_histogram(e, "u", [0.0, 10.0, 20.0, 40.0, 50.0], [40, 30, 20, 10], "x").select("event_id", r6(F.col("x"), "x", 5))


@query("m02_prompts", f"SELECT event_id, round(2 + {dist.uniform_sql('event_id', '5')} * 8, 6) AS uniform, round(1e-1 * pow(1e2, {dist.uniform_sql('event_id', '6')}), 6) AS log_uniform FROM events")
def m02(spark: SparkSession, d: str) -> DataFrame:
    u = lambda k: dist.uniform(F.col("event_id"), F.lit(k))
    return A.read(spark, d, "events").select("event_id", r6(2 + u(5) * 8, "uniform"), r6(0.1 * F.pow(F.lit(100.0), u(6)), "log_uniform"))


@query("m05_size_binned", f"SELECT sb, bin, count(*) AS n, count(*) FILTER (det) AS n_detected FROM (SELECT CAST(floor(las / 40) AS BIGINT) AS sb, {bin_sql('peak_flux', EDGES)} AS bin, peak_flux / isl_rms > 100 AS det FROM catalog) WHERE bin IS NOT NULL GROUP BY sb, bin")
def m05(spark: SparkSession, d: str) -> DataFrame:
    t = A.catalog(spark, d).select(F.floor(F.col("las") / 40).alias("sb"), "peak_flux", (F.col("peak_flux") / F.col("isl_rms") > 100).alias("det"))
    return B.completeness_per_bin(t, EDGES, "peak_flux", "det", by=["sb"]).where("n > 0").select("sb", "bin", "n", "n_detected")


@query("m07_curve_fit")
def m07(spark: SparkSession, d: str) -> DataFrame:
    got = B.completeness_per_bin(A.trials(spark, d), EDGES).where("n > 0").withColumns({"x": F.log10((F.col("lo") + F.col("hi")) / 2), "err": F.sqrt(F.greatest("n_detected", F.lit(1))) / F.col("n"), "set": F.lit("all")})
    return fitting.fit_curves(got, ["set"], "x", "completeness", "err", "sigmoid01")


#: Points of the integrals in SQL: the same sequence.
_INT = f"""pts AS (SELECT iz, il, v_lo + (i + 5e-1)/64*(v_hi - v_lo) AS v, pow(1e1, l_lo + (i*0.6180339887498949::DOUBLE - floor(i*0.6180339887498949::DOUBLE))*(l_hi - l_lo)) AS lum, (v_hi - v_lo)*(l_hi - l_lo) AS size FROM cells, range(64) r(i)),
zs AS (SELECT *, {interp_sql('v', GRID.volume, GRID.z)} AS z FROM pts), ds AS (SELECT *, {interp_sql('z', GRID.z, GRID.distance)} AS dist FROM zs), fs AS (SELECT *, lum*pow(1+z, 17e-1)/(4*pi()*1e-26*dist*dist) AS f FROM ds WHERE dist > 0),
cs AS (SELECT *, CASE WHEN f > 11e-4 THEN 95e-2/(1+exp(-greatest(-7e2, least(7e2, 6e0*(log10(f*1000)-2e-1)))))+2e-2 ELSE 0e0 END AS c_res, CASE WHEN f > 11e-4 THEN {interp_sql('(f*1000)', rlf.PUBLISHED_FLUX, rlf.PUBLISHED_SHARE)} ELSE 0e0 END AS c_oth FROM fs),
ig AS (SELECT iz, il, avg(c_res)*any_value(size) AS i_resolved, avg(c_oth)*any_value(size) AS i_other FROM cs GROUP BY iz, il)"""


def _cells_sql() -> str:
    import numpy as np

    v = np.interp(ZE, GRID.z, GRID.volume).tolist()
    rows = ", ".join(f"({i}, {j}, {v[i]!r}::DOUBLE, {v[i + 1]!r}::DOUBLE, {LE[j]!r}::DOUBLE, {LE[j + 1]!r}::DOUBLE)" for i in range(len(ZE) - 1) for j in range(len(LE) - 1))
    return f"cells AS (SELECT CAST(iz AS INTEGER) AS iz, CAST(il AS INTEGER) AS il, v_lo, v_hi, l_lo, l_hi FROM (VALUES {rows}) v(iz, il, v_lo, v_hi, l_lo, l_hi))"


@query("m09_volume_integrals", f"WITH {_cells_sql()}, {_INT}, {GRIDC} SELECT ig.iz, ig.il, round(i_resolved/1e6, 4) AS i_resolved, round(i_other/1e6, 4) AS i_other FROM ig JOIN (SELECT DISTINCT iz, il FROM g) o ON o.iz = ig.iz AND o.il = ig.il")
def m09(spark: SparkSession, d: str) -> DataFrame:
    got = rlf.integrals(_counted(spark, d).where("n > 0"), GRID, FIT, 64)
    return got.select("iz", "il", r6(F.col("i_resolved") / 1e6, "i_resolved", 4), r6(F.col("i_other") / 1e6, "i_other", 4))


@query("m09_refined_integrals")
def m09_refined(spark: SparkSession, d: str) -> DataFrame:
    """The integrals of the cells that hold sources, each with its error."""
    got = rlf.refined_integrals(_counted(spark, d).where("n > 0"), GRID, FIT)
    return got.select("iz", "il", r6(F.col("i_resolved") / 1e6, "i_resolved", 4), r6(F.col("i_other") / 1e6, "i_other", 4), r6(F.col("error"), "error", 7), "n_points")


_CNT = f"{GRIDC}, {ALL_CELLS}, n AS (SELECT iz, il, count(*) AS n, count(*) FILTER (resolved) AS r FROM g GROUP BY iz, il), ct AS (SELECT al.iz, al.il, coalesce(r, 0) AS nr, coalesce(n, 0) - coalesce(r, 0) AS no_ FROM al LEFT JOIN n ON n.iz = al.iz AND n.il = al.il)"
_F = repr(rlf.SKY_AREA / rlf.WHOLE_SKY) + "::DOUBLE"


@query("m12_page_carrera", f"WITH {_cells_sql()}, {_INT}, {_CNT}, ph AS (SELECT ct.iz, ct.il, ((CASE WHEN nr = 0 THEN 0e0 WHEN i_resolved > 0 THEN nr/i_resolved END) + (CASE WHEN no_ = 0 THEN 0e0 WHEN i_other > 0 THEN no_/i_other END))/{_F} AS phi, pow(CASE WHEN nr = 0 THEN 0e0 WHEN i_resolved > 0 THEN sqrt(nr)/i_resolved END, 2) + pow(CASE WHEN no_ = 0 THEN 0e0 WHEN i_other > 0 THEN sqrt(no_)/i_other END, 2) AS e2 FROM ct JOIN ig ON ig.iz = ct.iz AND ig.il = ct.il) SELECT iz, il, round(phi*1e9, 3) AS phi, round(sqrt(e2/({_F}*{_F}) + pow(5e-2*phi, 2))*1e9, 3) AS phi_err FROM ph")
def m12(spark: SparkSession, d: str) -> DataFrame:
    got = rlf.page_carrera(_counted(spark, d), rlf.integrals(rlf.cells(spark, ZE, LE, GRID), GRID, FIT, 64))
    return got.select("iz", "il", r6(F.col("phi") * 1e9, "phi", 3), r6(F.col("phi_err") * 1e9, "phi_err", 3))


@query("m14_impossible_bins", f"WITH {_cells_sql()}, {_INT}, {_CNT} SELECT ct.iz, ct.il, nr AS n_resolved, no_ AS n_other FROM ct JOIN ig ON ig.iz = ct.iz AND ig.il = ct.il WHERE (nr > 0 AND i_resolved <= 0) OR (no_ > 0 AND i_other <= 0)")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return rlf.impossible_bins(_counted(spark, d), rlf.integrals(rlf.cells(spark, ZE, LE, GRID), GRID, FIT, 64)).select("iz", "il", "n_resolved", "n_other")


@query("m10_available_volume")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return rlf.available_volume(_catalogue(spark, d), ZE, LE, GRID, FIT).select("l_orderkey", "l_partkey", "l_suppkey", "iz", "il", r6(F.col("va") / 1e6, "va", 3))


@query("m13_one_over_va")
def m13(spark: SparkSession, d: str) -> DataFrame:
    return rlf.one_over_va(rlf.available_volume(_catalogue(spark, d), ZE, LE, GRID, FIT), rlf.cells(spark, ZE, LE, GRID))


@query("m17_two_estimators")
def m17(spark: SparkSession, d: str) -> DataFrame:
    one = rlf.page_carrera(_counted(spark, d), rlf.integrals(rlf.cells(spark, ZE, LE, GRID), GRID, FIT, 64)).select(F.lit("page_carrera").alias("method"), "iz", "il", "phi", "phi_err")
    two = rlf.one_over_va(rlf.available_volume(_catalogue(spark, d), ZE, LE, GRID, FIT), rlf.cells(spark, ZE, LE, GRID)).select(F.lit("one_over_va").alias("method"), "iz", "il", "phi", "phi_err")
    return one.unionByName(two)


@query("m22_sweep_grid", "WITH q AS (SELECT quantile_cont(value, 5e-2) AS lo, quantile_cont(value, 95e-2) AS hi FROM events WHERE value > 0) SELECT CAST(i AS INTEGER) AS step, round(lo*pow(hi/lo, i/9e0), 5) AS prompt FROM q, range(10) r(i)")
def m22(spark: SparkSession, d: str) -> DataFrame:
    q = quantile_table(A.read(spark, d, "events").where("value > 0"), "value", {"lo": 0.05, "hi": 0.95})
    return q.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step")).select("step", r6(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("step") / 9.0), "prompt", 5))


@query("t02_streamed_completeness", f"SELECT bin, count(*) AS n, count(*) FILTER (detectable) AS n_detected FROM (SELECT {bin_sql('mock_flux', EDGES)} AS bin, detectable FROM trials) WHERE bin IS NOT NULL GROUP BY bin")
def t02(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from ..streaming.progress import completeness_so_far

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    trials = rows.select(F.col("value").alias("mock_flux"), (F.col("value") * (0.5 + (F.col("event_id") * 7919) % 1000 / 1000.0) >= 1.5).alias("detectable"))
    name = f"completeness_{uuid.uuid4().hex}"
    q = completeness_so_far(trials, EDGES).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("t02_replayed_completeness", f"SELECT bin, count(*) AS n, count(*) FILTER (detectable) AS n_detected FROM (SELECT {bin_sql('mock_flux', EDGES)} AS bin, detectable FROM trials) WHERE bin IS NOT NULL GROUP BY bin")
def t02_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Trials arrive in two deliveries, the second of which repeats the first; the query stops in between and goes on from its checkpoint."""
    import uuid

    from ..sources import storage
    from ..streaming.progress import completeness_so_far

    incoming, log = (storage.shared_path(spark, t) for t in ("trials", "trials-log"))
    trials = A.trials(spark, d)
    name = f"replayed_{uuid.uuid4().hex}"
    for part in (trials.where("event_id % 3 = 0"), trials):
        part.write.mode("append").parquet(incoming)
        rows = spark.readStream.schema(trials.schema).parquet(incoming)
        q = completeness_so_far(rows, EDGES, trial="event_id").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.table(name)
