"""Photometry and sky geometry as column expressions.  Missing values are null; angles in degrees unless named."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-point fluxes (Jy), magnitude offsets and wavelengths (m) of the infrared bands 2 and 3, and the boundaries
#: of the source classes.
BAND_FLUX = {2: 171.787, 3: 31.674}
BAND_OFFSET = {2: 3.339, 3: 5.174}
BAND_WAVELENGTH = {2: 4.6e-6, 3: 12.1e-6}
FLUX_CUT_MJY, Z_CUT = 1.1, 0.01
SFG_LOG_L, SFG_OFFSET, RQQ_OFFSET, RQQ_SLOPE, RQQ_MAG = 24.8, 14.0, 25.3, 2 / 7, -27.0


def number(x: Column) -> Column:
    """Null for NaN and infinities: the library's form of missing."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mag_to_flux(mag: Column, band: int) -> Column:
    """Flux (Jy) of a magnitude in an infrared band."""
    return BAND_FLUX[band] * F.pow(F.lit(10.0), -(mag - BAND_OFFSET[band]) / 2.5)


def k_correction(z: Column, alpha: Column | float = -0.7, magnitudes: bool = False) -> Column:
    """(1 + z)^(1 - alpha), or -2.5 log10 of it."""
    power = 1 - (alpha if isinstance(alpha, Column) else F.lit(float(alpha)))
    return -2.5 * power * F.log10(1 + z) if magnitudes else F.pow(1 + z, power)


def luminosity(flux_jy: Column, distance_m: Column, k: Column) -> Column:
    """W/Hz of a flux at a luminosity distance."""
    return 4 * math.pi * 1e-26 * flux_jy * distance_m * distance_m / k


def flux_of(lum: Column, distance_m: Column, k: Column) -> Column:
    """Jy of a luminosity: the inverse of :func:`luminosity`."""
    return F.try_divide(lum * k, 4 * math.pi * 1e-26 * distance_m * distance_m)


def unit_vector(ra: Column, dec: Column) -> Column:
    return F.struct((F.cos(F.radians(dec)) * F.cos(F.radians(ra))).alias("x"), (F.cos(F.radians(dec)) * F.sin(F.radians(ra))).alias("y"), F.sin(F.radians(dec)).alias("z"))


def ellipse_halfwidths(major: Column, minor: Column, pa: Column) -> tuple[Column, Column]:
    """Half-widths in RA and Dec of the box around an ellipse given by full axes and position angle."""
    a, b, t = major / 2, minor / 2, F.radians(pa)
    return F.sqrt(F.pow(a * F.sin(t), 2) + F.pow(b * F.cos(t), 2)), F.sqrt(F.pow(a * F.cos(t), 2) + F.pow(b * F.sin(t), 2))


def ra_offset(ra: Column, ra0: Column, dec0: Column) -> Column:
    """RA difference in arcsec on the sky, wrapped at 360 degrees."""
    turn = ra - ra0 + 180.0
    return (turn - 360.0 * F.floor(turn / 360.0) - 180.0) * F.cos(F.radians(dec0)) * 3600.0


def contour_scale(peak: Column, level: Column) -> Column:
    """By how much an ellipse at half maximum grows to reach ``level``; 0 where the peak lies below it."""
    return F.sqrt(F.greatest(F.coalesce(F.ln(F.try_divide(peak, level)) / math.log(2), F.lit(0.0)), F.lit(0.0)))


def snr(peak: Column, noise: Column) -> Column:
    """Peak over noise, -1 where the noise is 0."""
    return F.when(noise != 0, peak / noise).otherwise(F.lit(-1.0))


def chosen_size(component: Column, flood: Column, flood_flux: Column, total_flux: Column, bad_flux: Column, bad_image: Column) -> Column:
    """(size, origin): the flood-fill size if it is unflagged, its flux fits and the component size is in range."""
    ratio = F.try_divide(flood_flux, total_flux)
    good = F.coalesce(~bad_flux & ~bad_image & (ratio > 0.8) & (ratio < 1.2) & (component > 30) & (component < 600), F.lit(False))
    return F.struct(F.when(good, flood).otherwise(component).alias("size"), F.when(good, F.lit("flood")).otherwise(F.lit("component")).alias("origin"))


def beam_pixels(major: Column, minor: Column, pixel: Column) -> Column:
    """Pixels under a Gaussian beam of the given full widths at half maximum."""
    return math.pi * major * minor / (4 * math.log(2) * pixel * pixel)
