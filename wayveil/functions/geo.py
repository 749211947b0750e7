"""Transverse Mercator (Krueger series to the third power of the flattening) as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zone:
    meridian: float
    inverse_flattening: float
    axis: float = 6378137.0


#: EPSG code -> central meridian and ellipsoid (WGS 84, GRS 80).
ZONES = {32650: Zone(117.0, 298.257223563), 25832: Zone(9.0, 298.257222101)}
SCALE, EASTING = 0.9996, 500000.0


def zone(epsg: int) -> Zone:
    if epsg not in ZONES:
        raise ValueError(f"unknown zone {epsg}; known: {sorted(ZONES)}")
    return ZONES[epsg]


def series(z: Zone) -> dict:
    f = 1 / z.inverse_flattening
    n = f / (2 - f)
    return {
        "n": n,
        "A": z.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "alpha": (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240),
        "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    }


def forward(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    z = zone(epsg)
    s = series(z)
    phi, lam = F.radians(lat), F.radians(lon - z.meridian)
    c = 2 * math.sqrt(s["n"]) / (1 + s["n"])
    tau = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi = F.atan2(tau, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + tau * tau))
    east, north = eta, xi
    for j, a in enumerate(s["alpha"], 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * s["A"] * east, SCALE * s["A"] * north


def inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    z = zone(epsg)
    s = series(z)
    xi, eta = y / (SCALE * s["A"]), (x - EASTING) / (SCALE * s["A"])
    xi1, eta1 = xi, eta
    for j, b in enumerate(s["beta"], 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(s["delta"], 1):
        lat = lat + d * F.sin(2 * j * chi)
    return z.meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def guarded(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Fails at run time on the first pair in the wrong order or out of range."""
    return df.where(F.assert_true(valid(F.col(lon), F.col(lat)), F.lit("longitude must be in [-180, 180] and latitude in [-90, 90]")).isNull())
