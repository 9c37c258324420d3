"""Curves of completeness and luminosity functions as column expressions, and a registry of named curves."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def expit(u: Column) -> Column:
    """1 / (1 + e^-u) without overflow."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), u))))


def sigmoid(x: Column, x0: Num, k: Num, a: Num = 1.0, b: Num = 0.0) -> Column:
    """Logistic curve of height ``a`` above ``b``."""
    return _c(a) * expit(_c(k) * (x - _c(x0))) + _c(b)


def richards01(x: Column, x0: Num, k: Num, nu: Num) -> Column:
    """Logistic curve to the power 1 / nu."""
    return F.pow(expit(_c(k) * (x - _c(x0))), 1 / _c(nu))


def erf(x: Column) -> Column:
    """Error function by a rational approximation with an error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def erf01(x: Column, x0: Num, sigma: Num) -> Column:
    """Gaussian cumulative curve."""
    return 0.5 * (1 + erf((x - _c(x0)) / (_c(sigma) * math.sqrt(2))))


def double_power_law(lum: Column, alpha: Num, beta: Num, log_c: Num, log_star: Num) -> Column:
    """C / ((L/L*)^alpha + (L/L*)^beta)."""
    ratio = lum / F.pow(F.lit(10.0), _c(log_star))
    return F.pow(F.lit(10.0), _c(log_c)) / (F.pow(ratio, _c(alpha)) + F.pow(ratio, _c(beta)))


def schechter(lum: Column, beta: Num, gamma: Num, log_phi: Num, log_star: Num) -> Column:
    """phi (L/L*)^beta exp(-(L/L*)^gamma)."""
    ratio = lum / F.pow(F.lit(10.0), _c(log_star))
    return F.pow(F.lit(10.0), _c(log_phi)) * F.pow(ratio, _c(beta)) * F.exp(-F.pow(ratio, _c(gamma)))


def evolving_power_law(lum: Column, z: Column, alpha: Num, beta: Num, log_c: Num, log_star: Num, density: Num = 0.0, luminosity: Num = 0.0) -> Column:
    """Double power law whose density and characteristic luminosity grow as powers of 1 + z (either power may be 0)."""
    moved = lum / F.pow(1 + z, _c(luminosity))
    return F.pow(1 + z, _c(density)) * double_power_law(moved, alpha, beta, log_c, log_star)


def peaked_evolution(lum: Column, z: Column, alpha: Num, beta: Num, log_c: Num, log_star: Num, slope: Num, z0: Num, width: Num, k: Num) -> Column:
    """Density that rises as (1 + z)^slope up to z0 and then falls as a Gaussian; luminosity grows as 10^(k z)."""
    rise = F.pow(1 + z, _c(slope))
    top = F.pow(1 + _c(z0), _c(slope))
    fall = top * F.exp(-F.pow((z - _c(z0)) / _c(width), 2) / 2)
    return F.when(z > _c(z0), fall).otherwise(rise) * double_power_law(lum / F.pow(F.lit(10.0), _c(k) * z), alpha, beta, log_c, log_star)


@dataclass(frozen=True)
class Curve:
    """A named curve: its column form, its NumPy form for fits, and its parameters."""

    column: Callable[..., Column]
    numpy: Callable[..., np.ndarray]
    parameters: tuple[str, ...]


def _np_expit(u: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(u, float)))


_np_erf = np.vectorize(math.erf, otypes=[float])

CURVES = {
    "sigmoid": Curve(sigmoid, lambda x, x0, k, a, b: a * _np_expit(k * (x - x0)) + b, ("x0", "k", "a", "b")),
    "sigmoid01": Curve(lambda x, x0, k: sigmoid(x, x0, k), lambda x, x0, k: _np_expit(k * (x - x0)), ("x0", "k")),
    "richards01": Curve(richards01, lambda x, x0, k, nu: _np_expit(k * (x - x0)) ** (1 / nu), ("x0", "k", "nu")),
    "erf01": Curve(erf01, lambda x, x0, sigma: 0.5 * (1 + _np_erf((x - x0) / (sigma * math.sqrt(2)))), ("x0", "sigma")),
}


@dataclass(frozen=True)
class CurveFit:
    """A fitted curve: ``x_space`` is "linear" or "log10"; the number of parameters must be the curve's."""

    function: str
    x_space: str
    popt: tuple[float, ...]

    def __post_init__(self) -> None:
        if self.function not in CURVES:
            raise ValueError(f"unknown curve {self.function!r}")
        if self.x_space not in ("linear", "log10"):
            raise ValueError(f"x_space {self.x_space!r}")
        if len(self.popt) != len(CURVES[self.function].parameters):
            raise ValueError(f"{self.function} takes {CURVES[self.function].parameters}")

    def column(self, flux_mjy: Column, shift_mjy: float = 0.0) -> Column:
        """Completeness at a flux; the midpoint moves by ``shift_mjy`` in linear flux.  0 at flux 0, null below."""
        x0, *rest = self.popt
        if self.x_space == "log10":
            middle = 10**x0 + shift_mjy
            if middle <= 0:
                raise ValueError("the shift moves the midpoint to no positive flux")
            at = CURVES[self.function].column(F.log10(flux_mjy), math.log10(middle), *rest)
            return F.when(flux_mjy > 0, at).when(flux_mjy == 0, F.lit(0.0))
        return F.when(flux_mjy >= 0, CURVES[self.function].column(flux_mjy, x0 + shift_mjy, *rest))

    def values(self, flux_mjy: np.ndarray) -> np.ndarray:
        """The same for positive fluxes in NumPy."""
        x = np.log10(flux_mjy) if self.x_space == "log10" else flux_mjy
        return CURVES[self.function].numpy(x, *self.popt)
