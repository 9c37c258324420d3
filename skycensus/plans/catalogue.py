"""Queries on the catalogue: projections, scalar functions, filters, sets, strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, sky
from ..operators import cosmology
from ..operators.dist import clean, power_inverse, power_transform
from ..operators.interp import interp_sql, interpolate
from ..operators.quantiles import quantile_table
from ..operators.rlf import PUBLISHED_FLUX, PUBLISHED_SHARE, completeness, with_luminosity
from ..operators.select import base_gate, classified, funnel_report
from ..sources import adapters as A
from ..sources import files, logs
from .registry import query

GRID = cosmology.grid()
D_SQL = interp_sql("z_best", GRID.z, GRID.distance)
FIT = curves.CurveFit("sigmoid", "log10", (0.2, 6.0, 0.95, 0.02))
_R = "round({}, 6)"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("s02_strip_columns", "SELECT total_flux, z_best, resolved, l_144, las FROM catalog WHERE resolved")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).where("resolved").select("total_flux", "z_best", "resolved", "l_144", "las")


@query("s03_columns", "SELECT peak_flux, isl_rms FROM catalog")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("peak_flux", "isl_rms")


@query("s04_components", "SELECT trim(parent) AS parent, round(ra, 6) AS ra, round(dec, 6) AS dec, peak, maj, min, pa FROM sky_components")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return A.components(spark, d).select(F.trim("parent").alias("parent"), r6(F.col("ra"), "ra"), r6(F.col("dec"), "dec"), "peak", "maj", "min", "pa")


@query("s05_scan_numbers", r"SELECT n, url FROM (SELECT CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS n, url FROM pages) WHERE n >= 0 AND n < 500")
def s05(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "pages").select(files.number_in(F.col("url"), "([0-9]+)").alias("n"), "url").where("n >= 0 AND n < 500")


@query("s06_function_per_file")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return files.map_files(A.read(spark, d, "pages"), lambda html: len(html.split("<p")) - 1, "long", "page_id", "html")


@query("s09_header_value", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("s12_positions", "SELECT concat_ws(' ', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS position FROM lineitem WHERE l_returnflag = 'R'")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws(" ", "l_orderkey", "l_partkey").alias("position"))


@query("s13_refetch_list", "WITH present AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber < 3), corrupt AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49e0) SELECT DISTINCT idx FROM (SELECT o_orderkey AS idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM present) UNION ALL SELECT l_orderkey FROM corrupt)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    lines = A.read(spark, d, "lineitem")
    present = lines.where("l_linenumber < 3").select(F.col("l_orderkey").alias("idx"))
    corrupt = lines.where("l_quantity > 49").select(F.col("l_orderkey").alias("idx"))
    expected = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return expected.join(present, "idx", "left_anti").unionByName(corrupt).distinct()


@query("s14_bucket_folder", "SELECT o_orderkey, CAST(CAST(floor(o_orderkey / 1000) * 1000 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(o_orderkey / 1000) * 1000 AS BIGINT) + 999 AS VARCHAR) AS folder FROM orders")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").select("o_orderkey", files.bucket_of(F.col("o_orderkey"), 1000).alias("folder"))


@query("s15_to_do", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def s15(spark: SparkSession, d: str) -> DataFrame:
    done = A.read(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("s25_split", "SELECT doc_id, CASE WHEN (doc_id * 7919) % 1000 < 900 THEN 'train' ELSE 'val' END AS split FROM documents")
def s25(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents").select("doc_id", F.when((F.col("doc_id") * 7919) % 1000 < 900, "train").otherwise("val").alias("split"))


@query("p01_sigmoid", "SELECT event_id, round(9e-1/(1+exp(-greatest(-7e2, least(7e2, 2e0*(value-1e1)))))+5e-2, 6) AS y FROM events")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", r6(curves.sigmoid(F.col("value"), 10.0, 2.0, 0.9, 0.05), "y"))


@query("p02_sigmoid01", "SELECT event_id, round(1/(1+exp(-greatest(-7e2, least(7e2, 5e-1*(value-4e1))))), 6) AS y FROM events")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", r6(curves.sigmoid(F.col("value"), 40.0, 0.5), "y"))


@query("p03_richards", "SELECT event_id, round(pow(1/(1+exp(-greatest(-7e2, least(7e2, 1e-1*(value-4e1))))), 1/17e-1), 6) AS y FROM events")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", r6(curves.richards01(F.col("value"), 40.0, 0.1, 1.7), "y"))


_T = "(1/(1+3275911e-7*abs(u)))"
@query("p04_erf", f"SELECT event_id, round(5e-1*(1+sign(u)*(1-{_T}*(254829592e-9+{_T}*(-284496736e-9+{_T}*(1421413741e-9+{_T}*(-1453152027e-9+{_T}*1061405429e-9))))*exp(-u*u))), 6) AS y FROM (SELECT event_id, (value-4e1)/(2e1*1.4142135623730951e0) AS u FROM events)")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", r6(curves.erf01(F.col("value"), 40.0, 20.0), "y"))


@query("p05_band_flux", "SELECT l_orderkey, l_partkey, l_suppkey, round(171787e-3*pow(1e1, -(mag_w2-3339e-3)/25e-1), 8) AS f2, round(31674e-3*pow(1e1, -(mag_w3-5174e-3)/25e-1), 8) AS f3 FROM catalog")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.round(sky.mag_to_flux(F.col("mag_w2"), 2), 8).alias("f2"), F.round(sky.mag_to_flux(F.col("mag_w3"), 3), 8).alias("f3"))


@query("p06_k_correction", "SELECT l_orderkey, l_partkey, round(pow(1+z_best, 17e-1), 6) AS k, round(-25e-1*17e-1*log10(1+z_best), 6) AS k_mag FROM catalog WHERE NOT isnan(z_best)")
def p06(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("z_best")
    return A.catalog(spark, d).where(~F.isnan(z)).select("l_orderkey", "l_partkey", r6(sky.k_correction(z), "k"), r6(sky.k_correction(z, magnitudes=True), "k_mag"))


_POW = "(pow(1e1,-55e-1)/(pow({l}/pow(1e1,245e-1),6e-1)+pow({l}/pow(1e1,245e-1),18e-1)))"
@query("p07_double_power_law", f"SELECT l_orderkey, l_partkey, round(log10({_POW.format(l='l_144')}), 6) AS log_phi FROM catalog")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("l_orderkey", "l_partkey", r6(F.log10(curves.double_power_law(F.col("l_144"), 0.6, 1.8, -5.5, 24.5)), "log_phi"))


@query("p08_schechter", "SELECT l_orderkey, l_partkey, round(log10(pow(1e1,-5e0)*pow(l_144/pow(1e1,26e0),-5e-1)*exp(-pow(l_144/pow(1e1,26e0),5e-1))), 6) AS log_phi FROM catalog")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("l_orderkey", "l_partkey", r6(F.log10(curves.schechter(F.col("l_144"), -0.5, 0.5, -5.0, 26.0)), "log_phi"))


@query("p09_evolution", "SELECT l_orderkey, l_partkey, round(log10(pow(1+z_best, 12e-1)*" + _POW.format(l="(l_144/pow(1+z_best, 8e-1))") + "), 6) AS log_phi FROM catalog WHERE NOT isnan(z_best)")
def p09(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d).where(~F.isnan("z_best"))
    return c.select("l_orderkey", "l_partkey", r6(F.log10(curves.evolving_power_law(F.col("l_144"), F.col("z_best"), 0.6, 1.8, -5.5, 24.5, 1.2, 0.8)), "log_phi"))


@query("p10_density_or_luminosity", "SELECT l_orderkey, l_partkey, round(log10(pow(1+z_best, 12e-1)*" + _POW.format(l="l_144") + "), 6) AS pde, round(log10(" + _POW.format(l="(l_144/pow(1+z_best, 8e-1))") + "), 6) AS ple FROM catalog WHERE NOT isnan(z_best)")
def p10(spark: SparkSession, d: str) -> DataFrame:
    c, at = A.catalog(spark, d).where(~F.isnan("z_best")), (F.col("l_144"), F.col("z_best"), 0.6, 1.8, -5.5, 24.5)
    return c.select("l_orderkey", "l_partkey", r6(F.log10(curves.evolving_power_law(*at, density=1.2)), "pde"), r6(F.log10(curves.evolving_power_law(*at, luminosity=0.8)), "ple"))


@query("p11_peaked_evolution", "SELECT l_orderkey, l_partkey, round(log10(CASE WHEN z_best > 8e-1 THEN pow(18e-1, 2e0)*exp(-pow((z_best-8e-1)/4e-1, 2)/2) ELSE pow(1+z_best, 2e0) END * " + _POW.format(l="(l_144/pow(1e1, 3e-1*z_best))") + "), 6) AS log_phi FROM catalog WHERE NOT isnan(z_best)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d).where(~F.isnan("z_best"))
    return c.select("l_orderkey", "l_partkey", r6(F.log10(curves.peaked_evolution(F.col("l_144"), F.col("z_best"), 0.6, 1.8, -5.5, 24.5, 2.0, 0.8, 0.4, 0.3)), "log_phi"))


#: Absolute magnitude and classes, shared by the queries below.
CLASSES = f"""a AS (SELECT *, CASE WHEN NOT isnan(z_best) AND z_best > 0 AND mag_w3 > 0 AND mag_w2 > 0 THEN
    mag_w3 - 5*(log10(({D_SQL})/{cosmology.MPC_M / 1e6!r}::DOUBLE) - 1)
    + 25e-1*(1 - (-(ln(31674e-3*pow(1e1,-(mag_w3-5174e-3)/25e-1)/(171787e-3*pow(1e1,-(mag_w2-3339e-3)/25e-1)))/ln(46e-7/121e-7))))*log10(1+z_best) END AS m,
    total_flux > 11e-1 AND NOT isnan(z_best) AND z_best > 1e-2 AND NOT isnan(mag_w1) AND NOT isnan(mag_w2) AND NOT isnan(mag_w3) AND NOT isnan(l_144) AS in_sample FROM catalog),
  k AS (SELECT *, in_sample AND NOT isnan(magerr_w3) AND coalesce(l_144 < pow(1e1, 14-m/25e-1) AND l_144 < pow(1e1, 248e-1), false) AS sfg,
    in_sample AND NOT isnan(magerr_w3) AND coalesce(l_144 < pow(1e1, 253e-1+(-m-27)*2e0/7) AND m < -27 AND l_144 >= pow(1e1, 248e-1), false) AS rqq FROM a)"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(A.catalog(spark, d), GRID)


@query("p12_absolute_magnitude", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey, round(m, 5) AS abs_w3 FROM k")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.round("abs_w3", 5).alias("abs_w3"))


@query("p13_luminosity", f"SELECT l_orderkey, l_partkey, l_suppkey, round(log10(4*pi()*1e-26*(total_flux/1e3)*({D_SQL})*({D_SQL})/pow(1+z_best, 17e-1)), 6) AS log_l FROM catalog WHERE NOT isnan(z_best) AND z_best > 0 AND total_flux > 0")
def p13(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d).withColumn("flux_jy", F.col("total_flux") / 1000)
    return with_luminosity(c, GRID, z="z_best").select("l_orderkey", "l_partkey", "l_suppkey", r6(F.log10("lum"), "log_l"))


@query("p14_flux_back", f"SELECT l_orderkey, l_partkey, l_suppkey, round(l_144*pow(1+z_best, 17e-1)/(4*pi()*1e-26*({D_SQL})*({D_SQL})), 9) AS flux_jy FROM catalog WHERE NOT isnan(z_best) AND z_best > 2e-1")
def p14(spark: SparkSession, d: str) -> DataFrame:
    c = interpolate(A.catalog(spark, d).where(~F.isnan("z_best") & (F.col("z_best") > 0.2)), "z_best", GRID.z, GRID.distance, "far")
    return c.select("l_orderkey", "l_partkey", "l_suppkey", F.round(sky.flux_of(F.col("l_144"), F.col("far"), sky.k_correction(F.col("z_best"))), 9).alias("flux_jy"))


@query("p15_stored_fit", "SELECT event_id, round(CASE WHEN value > 0 THEN 95e-2/(1+exp(-greatest(-7e2, least(7e2, 6e0*(log10(value)-log10(pow(1e1,2e-1)+1e-1))))))+2e-2 WHEN value = 0 THEN 0e0 END, 6) AS c FROM events")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", r6(FIT.column(F.col("value"), 0.1), "c"))


@query("p16_snr", "SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN isl_rms <> 0 THEN peak_flux/isl_rms ELSE -1e0 END, 6) AS snr FROM catalog")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", r6(sky.snr(F.col("peak_flux"), F.col("isl_rms")), "snr"))


@query("p17_unit_vector", "SELECT source_id, round(cos(radians(dec))*cos(radians(ra)), 6) AS x, round(cos(radians(dec))*sin(radians(ra)), 6) AS y, round(sin(radians(dec)), 6) AS z FROM sky_sources")
def p17(spark: SparkSession, d: str) -> DataFrame:
    v = sky.unit_vector(F.col("ra"), F.col("dec"))
    return A.sources(spark, d).select("source_id", *(r6(v[c], c) for c in "xyz"))


@query("p18_ellipse_box", "SELECT parent, maj, min, pa, round(sqrt(pow(maj/2*sin(radians(pa)),2)+pow(min/2*cos(radians(pa)),2)), 6) AS dx, round(sqrt(pow(maj/2*cos(radians(pa)),2)+pow(min/2*sin(radians(pa)),2)), 6) AS dy FROM sky_components")
def p18(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = sky.ellipse_halfwidths(F.col("maj"), F.col("min"), F.col("pa"))
    return A.components(spark, d).select("parent", "maj", "min", "pa", r6(dx, "dx"), r6(dy, "dy"))


@query("p19_ra_offset", "SELECT source_id, round((ra-1e-1+180-360*floor((ra-1e-1+180)/360)-180)*cos(radians(dec))*3600, 4) AS x FROM sky_sources")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return A.sources(spark, d).select("source_id", F.round(sky.ra_offset(F.col("ra"), F.lit(0.1), F.col("dec")), 4).alias("x"))


@query("p20_contour", "SELECT l_orderkey, l_partkey, l_suppkey, round(sqrt(greatest(ln(peak_flux/(3*isl_rms))/ln(2e0), 0)), 6) AS scale FROM catalog WHERE peak_flux > 0 AND isl_rms > 0")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).where("peak_flux > 0 AND isl_rms > 0").select("l_orderkey", "l_partkey", "l_suppkey", r6(sky.contour_scale(F.col("peak_flux"), 3 * F.col("isl_rms")), "scale"))


@query("p21_chosen_size", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN g THEN flood ELSE las END AS size, CASE WHEN g THEN 'flood' ELSE 'component' END AS origin FROM (SELECT *, las*12e-1 AS flood, l_partkey % 5 <> 0 AND l_suppkey % 7 <> 0 AND peak_flux*(6e-1+l_linenumber*3e-1)/peak_flux > 8e-1 AND peak_flux*(6e-1+l_linenumber*3e-1)/peak_flux < 12e-1 AND las > 30 AND las < 600 AS g FROM catalog)")
def p21(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d)
    s = sky.chosen_size(F.col("las"), F.col("las") * 1.2, F.col("peak_flux") * (0.6 + F.col("l_linenumber") * 0.3), F.col("peak_flux"), F.col("l_partkey") % 5 == 0, F.col("l_suppkey") % 7 == 0)
    return c.select("l_orderkey", "l_partkey", "l_suppkey", s.alias("s")).select("l_orderkey", "l_partkey", "l_suppkey", "s.size", "s.origin")


@query("p22_single_component", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 2*(las/72e2)*3600 ELSE CAST('NaN' AS DOUBLE) END AS size FROM catalog")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") == 1, 2 * (F.col("las") / 7200.0) * 3600).otherwise(F.lit(float("nan"))).alias("size"))


@query("p25_power_transform", "SELECT event_id, round((pow(value, 3e-1)-1)/3e-1/2e0, 6) AS t, round(value, 4) AS back FROM events WHERE value > 0")
def p25(spark: SparkSession, d: str) -> DataFrame:
    t = power_transform(F.col("value"), 0.3, 0.0, 2.0)
    return A.read(spark, d, "events").where("value > 0").select("event_id", r6(t, "t"), F.round(power_inverse(t, 0.3, 0.0, 2.0), 4).alias("back"))


@query("p29_beam", "SELECT source_id, round(pi()*6*6/(4*ln(2e0)*15e-1*15e-1)*isl_rms, 6) AS beam FROM sky_sources")
def p29(spark: SparkSession, d: str) -> DataFrame:
    return A.sources(spark, d).select("source_id", r6(sky.beam_pixels(F.lit(6.0), F.lit(6.0), F.lit(1.5)) * F.col("isl_rms"), "beam"))


@query("p30_log_features", "SELECT event_id, round(log10(greatest(value, 1e-12)), 6) AS f FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def p30(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").where(sky.number(F.col("value")).isNotNull()).select("event_id", r6(F.log10(F.greatest("value", F.lit(1e-12))), "f"))


@query("p31_z_of_volume", f"SELECT l_orderkey, l_partkey, l_suppkey, round({interp_sql('v', GRID.volume, GRID.z)}, 6) AS z FROM (SELECT *, l_144/1e19 AS v FROM catalog)")
def p31(spark: SparkSession, d: str) -> DataFrame:
    return interpolate(A.catalog(spark, d).withColumn("v", F.col("l_144") / 1e19), "v", GRID.volume, GRID.z, "z").select("l_orderkey", "l_partkey", "l_suppkey", r6(F.col("z"), "z"))


@query("p32_context_columns", "SELECT event_id, round((ln(value)-2)/15e-1, 6) AS flux, user_id*1e0 AS size FROM events WHERE value > 0")
def p32(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").where("value > 0").withColumns({"flux": power_transform(F.col("value"), 0, 2.0, 1.5), "size": F.col("user_id").cast("double")})
    missing = [c for c in ("flux", "size") if c not in e.columns]
    if missing:
        raise ValueError(f"context columns {missing}")
    return e.select("event_id", r6(F.col("flux"), "flux"), "size")


@query("f01_base_gate", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey FROM a WHERE in_sample")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).where(base_gate()).select("l_orderkey", "l_partkey", "l_suppkey")


@query("f02_sfg", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey FROM k WHERE sfg")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("sfg").select("l_orderkey", "l_partkey", "l_suppkey")


@query("f03_rqq", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey FROM k WHERE rqq")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("rqq").select("l_orderkey", "l_partkey", "l_suppkey")


@query("f04_classes", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey, sfg, rqq, in_sample AND NOT sfg AND NOT rqq AS rlagn FROM k")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "sfg", "rqq", "rlagn")


@query("f05_non_contaminants", f"WITH {CLASSES} SELECT l_orderkey, l_partkey, l_suppkey FROM k WHERE NOT sfg AND NOT rqq")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("keep").select("l_orderkey", "l_partkey", "l_suppkey")


@query("f06_selected", f"WITH {CLASSES} SELECT z_best AS z, total_flux/1e3 AS flux_jy, l_144, resolved FROM k WHERE in_sample AND NOT sfg AND NOT rqq")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("rlagn").select(F.col("z_best").alias("z"), (F.col("total_flux") / 1000).alias("flux_jy"), "l_144", "resolved")


def _steps():
    return [("resolved", F.col("resolved")), ("finite", sky.number(F.col("z_best")).isNotNull()), ("size", F.col("las") < 100), ("snr", sky.snr(F.col("peak_flux"), F.col("isl_rms")) >= 5), ("peak", F.col("peak_flux") > 5), ("class", F.col("keep"))]


@query("f08_funnel", f"""WITH {CLASSES}, f AS (SELECT CASE WHEN NOT resolved THEN 1 WHEN isnan(z_best) THEN 2 WHEN NOT las < 100 THEN 3 WHEN NOT (CASE WHEN isl_rms <> 0 THEN peak_flux/isl_rms ELSE -1 END) >= 5 THEN 4 WHEN NOT peak_flux > 5 THEN 5 WHEN sfg OR rqq THEN 6 ELSE 0 END AS s FROM k),
n AS (SELECT s, count(*) AS c FROM f GROUP BY s), t AS (SELECT * FROM (VALUES (0,'input'),(1,'resolved'),(2,'finite'),(3,'size'),(4,'snr'),(5,'peak'),(6,'class')) v(step, name))
SELECT CAST(step AS INTEGER) AS step, name, CAST(CASE WHEN step = 0 THEN 0 ELSE coalesce(c, 0) END AS BIGINT) AS removed, CAST((SELECT sum(c) FROM n) - coalesce((SELECT sum(c) FROM n WHERE n.s BETWEEN 1 AND t.step), 0) AS BIGINT) AS remaining FROM t LEFT JOIN n ON n.s = t.step""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return funnel_report(_classes(spark, d), _steps())


@query("f09_row_flags", "SELECT l_orderkey, l_partkey, l_suppkey, las >= 100 AS bad_size, CASE WHEN isl_rms <> 0 THEN peak_flux/isl_rms ELSE -1e0 END < 5 AS bad_snr, array_peak < 5e-1 AS bad_peak FROM catalog JOIN (SELECT idx, list_max(image) AS array_peak FROM images) i ON i.idx = l_orderkey")
def f09(spark: SparkSession, d: str) -> DataFrame:
    top = A.images(spark, d).select(F.col("idx").alias("l_orderkey"), F.array_max("image").alias("top"))
    return A.catalog(spark, d).join(top, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("las") >= 100).alias("bad_size"), (sky.snr(F.col("peak_flux"), F.col("isl_rms")) < 5).alias("bad_snr"), (F.col("top") < 0.5).alias("bad_peak"))


@query("f11_positive", "SELECT l_orderkey, l_partkey, l_suppkey FROM catalog WHERE total_flux > 0 AND NOT isnan(z_best) AND z_best > 0")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).where(F.coalesce((sky.number(F.col("total_flux")) > 0) & (sky.number(F.col("z_best")) > 0), F.lit(False))).select("l_orderkey", "l_partkey", "l_suppkey")


@query("f12_below_percentile", "SELECT event_id, value FROM events WHERE value > 0 AND NOT isnan(value) AND value < (SELECT quantile_cont(value, 95e-2) FROM events WHERE value > 0 AND NOT isnan(value))")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return clean(A.read(spark, d, "events"), "value", 0.95).select("event_id", "value")


@query("f13_flux_step", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN total_flux/1e3 > 11e-4 THEN 1e0 ELSE 0e0 END AS c FROM catalog")
def f13(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d).withColumn("flux_jy", F.col("total_flux") / 1000)
    return completeness(c, "flux_jy", F.lit(False), FIT, "c", published=False).select("l_orderkey", "l_partkey", "l_suppkey", "c")


@query("f14_finite_positive", "SELECT event_id, value FROM events WHERE NOT isnan(value) AND value > 0")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return clean(A.read(spark, d, "events"), "value").select("event_id", "value")


@query("f15_peaks_above", "SELECT idx, round(p, 6) AS peak FROM (SELECT idx, list_max(image)::DOUBLE AS p FROM images) WHERE p > 3e-1")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("idx", F.array_max("image").cast("double").alias("p")).where("p > 0.3D").select("idx", r6(F.col("p"), "peak"))


@query("f16_half_open", "SELECT event_id FROM events WHERE value >= 1e1 AND value < 2e1")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").where("value >= 10 AND value < 20").select("event_id")


@query("f17_central_share", "SELECT l_orderkey, l_partkey, l_suppkey, las FROM catalog WHERE las BETWEEN (SELECT quantile_cont(las, 25e-3) FROM catalog) AND (SELECT quantile_cont(las, 975e-3) FROM catalog)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d)
    cut = quantile_table(c, "las", {"lo": 0.025, "hi": 0.975})
    return c.crossJoin(F.broadcast(cut)).where("las BETWEEN lo AND hi").select("l_orderkey", "l_partkey", "l_suppkey", "las")


@query("u01_intersection", "SELECT o_orderkey AS idx FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").select(F.col("o_orderkey").alias("idx")).intersect(A.read(spark, d, "lineitem").select("l_orderkey"))


@query("u02_difference", "SELECT o_orderkey AS idx FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u02(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").select(F.col("o_orderkey").alias("idx")).subtract(A.read(spark, d, "lineitem").select("l_orderkey"))


@query("u03_concatenation", "SELECT event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 5 = 0")
def u03(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select("event_id", "value")
    return e.where("event_id % 3 = 0").unionByName(e.where("event_id % 5 = 0"))


@query("u04_many_intersections", "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0 AND event_id % 5 = 0")
def u04(spark: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    e = A.read(spark, d, "events").select("event_id")
    return reduce(lambda a, b: a.join(b, "event_id"), [e.where(f"event_id % {k} = 0") for k in (2, 3, 5)])


LOGS = """lg AS (SELECT event_id, concat('Flux from sum of (non-blank) pixels ..... : 9.999 Jy', chr(10), '=====', chr(10),
  'Raw mean (Stokes I) =  ', CAST(event_id % 1000 AS VARCHAR), '.5 mJy and raw rms =  ', CAST(event_id % 77 AS VARCHAR), '.25 mJy', chr(10), 'Flux from sum of (non-blank) pixels ..... : ', CAST(event_id % 541 AS VARCHAR), '.125 Jy',
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(chr(10), 'Total flux density in model ............. : ', CAST(event_id % 97 AS VARCHAR), '.75 Jy') END) AS text FROM events)"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("WITH " + LOGS.replace("FROM events", "FROM {e}").replace("VARCHAR", "STRING") + " SELECT * FROM lg", e=A.read(spark, d, "events"))


@query("x01_latest_run", f"WITH {LOGS} SELECT event_id, trim(split_part(text, '=====', 2), chr(10)) AS block FROM lg")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).select("event_id", F.trim(logs.latest_run(F.col("text")), F.lit("\n")).alias("block"))


@query("x02_log_values", f"WITH {LOGS} SELECT event_id, event_id % 541 + 125e-3 AS total, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE event_id % 97 + 75e-2 END AS model, event_id % 1000 + 5e-1 AS mean, event_id % 77 + 25e-2 AS rms FROM lg")
def x02(spark: SparkSession, d: str) -> DataFrame:
    v = logs.values(logs.latest_run(F.col("text")))
    return _logs(spark, d).select("event_id", v.alias("v")).select("event_id", "v.total", "v.model", "v.mean", "v.rms")


@query("x03_three_values", f"WITH {LOGS} SELECT event_id, concat(CAST(event_id % 1000 AS VARCHAR), '.5') AS mean, concat(CAST(event_id % 77 AS VARCHAR), '.25') AS rms, concat(CAST(event_id % 541 AS VARCHAR), '.125') AS total FROM lg")
def x03(spark: SparkSession, d: str) -> DataFrame:
    whole = r"(?s)" + logs.MEAN + r".*?" + logs.RMS + r".*?" + logs.TOTAL
    block = logs.latest_run(F.col("text"))
    return _logs(spark, d).select("event_id", *(F.regexp_extract(block, whole, i).alias(n) for i, n in enumerate(("mean", "rms", "total"), 1)))


@query("x04_trimmed", "SELECT p_partkey, trim(p_name) AS name FROM part")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").select("p_partkey", F.trim(F.decode(F.encode("p_name", "UTF-8"), "UTF-8")).alias("name"))


@query("x05_number_from_name", r"SELECT page_id, CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS n FROM pages")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "pages").select("page_id", files.number_in(F.col("url"), "([0-9]+)").alias("n"))


@query("x06_flat_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM events GROUP BY event_type")
def x06(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    long = e.unpivot("event_type", ["n", "mean", "top"], "metric", "x")
    return long.groupBy("event_type").pivot("metric", ["n", "mean", "top"]).agg(F.first("x")).select("event_type", F.col("n").cast("long").alias("n"), r6(F.col("mean"), "mean"), r6(F.col("top"), "top"))


@query("x08_summary", "SELECT concat('n=', CAST(count(*) AS VARCHAR), ' types=', CAST(count(DISTINCT event_type) AS VARCHAR)) AS summary FROM events")
def x08(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").agg(F.format_string("n=%d types=%d", F.count("*"), F.countDistinct("event_type")).alias("summary"))


@query("m06_published", f"SELECT event_id, round({interp_sql('value', PUBLISHED_FLUX, PUBLISHED_SHARE)}, 6) AS c FROM events")
def m06(spark: SparkSession, d: str) -> DataFrame:
    return interpolate(A.read(spark, d, "events"), "value", PUBLISHED_FLUX, PUBLISHED_SHARE, "c").select("event_id", r6(F.col("c"), "c"))


@query("m08_completeness", f"SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN total_flux/1e3 > 11e-4 THEN CASE WHEN resolved THEN 95e-2/(1+exp(-greatest(-7e2, least(7e2, 6e0*(log10(total_flux)-2e-1)))))+2e-2 ELSE {interp_sql('total_flux', PUBLISHED_FLUX, PUBLISHED_SHARE)} END ELSE 0e0 END, 6) AS c FROM catalog")
def m08(spark: SparkSession, d: str) -> DataFrame:
    c = A.catalog(spark, d).withColumn("flux_jy", F.col("total_flux") / 1000)
    return completeness(c, "flux_jy", F.col("resolved"), FIT, "c").select("l_orderkey", "l_partkey", "l_suppkey", r6(F.col("c"), "c"))
