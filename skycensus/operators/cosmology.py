"""Distances and volumes of a flat universe with matter, radiation and a cosmological constant, tabulated once for a plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Hubble constant (km/s/Mpc), matter share, temperature of the background (K), massless neutrinos.
H0, OMEGA_M, T_CMB, N_NEUTRINO = 70.0, 0.3, 2.725, 3.04
C_KM_S, MPC_M, G = 299792.458, 3.0856775814913673e22, 6.6743e-11
STEFAN_BOLTZMANN, C_M_S = 5.670374419e-8, 299792458.0


@dataclass(frozen=True)
class Grid:
    """Redshift, luminosity distance (m) and comoving volume (Mpc^3) at evenly spaced redshifts."""

    z: tuple[float, ...]
    distance: tuple[float, ...]
    volume: tuple[float, ...]


def radiation_share(h0: float = H0, t_cmb: float = T_CMB) -> float:
    critical = 3 * (h0 * 1000 / MPC_M) ** 2 / (8 * math.pi * G)
    photons = 4 * STEFAN_BOLTZMANN / C_M_S**3 * t_cmb**4
    return photons / critical * (1 + N_NEUTRINO * 7 / 8 * (4 / 11) ** (4 / 3))


def grid(z_max: float = 1.5, n: int = 200, h0: float = H0, omega_m: float = OMEGA_M, t_cmb: float = T_CMB) -> Grid:
    """Simpson's rule on 16 steps within each grid step."""
    omega_r = radiation_share(h0, t_cmb)
    z = np.linspace(0, z_max, n)
    fine = np.linspace(0, z_max, 16 * (n - 1) + 1)
    f = 1 / np.sqrt(omega_r * (1 + fine) ** 4 + omega_m * (1 + fine) ** 3 + 1 - omega_m - omega_r)
    h = fine[1] - fine[0]
    pairs = h / 3 * (f[:-2:2] + 4 * f[1:-1:2] + f[2::2])
    comoving = C_KM_S / h0 * np.concatenate([[0], np.cumsum(pairs)])[::8]
    return Grid(tuple(z.tolist()), tuple(((1 + z) * comoving * MPC_M).tolist()), tuple((4 / 3 * math.pi * comoving**3).tolist()))
