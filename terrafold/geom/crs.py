"""Reprojection between reference systems that are given by parameters: an ellipsoid, a shift to WGS 84 and a projection.

All steps take whole arrays of coordinates: back to longitude and latitude, through geocentric coordinates where the shifts differ,
and forward. Projections are transverse Mercator, Mercator, conformal and equal-area conic, azimuthal equal-area, polar stereographic and
cylindrical equal-area. Systems without a shift (WGS 84, ETRS89, NAD83, RGF93, GDA94, NZGD2000) count as one datum. Heights stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Semi-major axis and inverse flattening by ellipsoid.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "Airy": (6377563.396, 299.3249646),
    "Bessel": (6377397.155, 299.1528128),
    "Sphere": (6378137.0, float("inf")),
}
# Shift in metres, rotation in seconds of arc (position vector) and scale in parts per million, to WGS 84.
SHIFTS = {
    "OSGB36": (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489),
    "DHDN": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7),
}
US_FOOT = 1200 / 3937
# Fixed values, by SRID: projection, ellipsoid, shift, and what differs from zero (scale and unit: one) of latitude and longitude
# of origin, standard parallels, scale, false easting and northing in metres, and the unit in metres.
SYSTEMS: dict[int, tuple[str, str, str | None, dict[str, float]]] = {
    4326: ("degrees", "WGS84", None, {}),
    4258: ("degrees", "GRS80", None, {}),
    4269: ("degrees", "GRS80", None, {}),
    4171: ("degrees", "GRS80", None, {}),
    4283: ("degrees", "GRS80", None, {}),
    4167: ("degrees", "GRS80", None, {}),
    4277: ("degrees", "Airy", "OSGB36", {}),
    4314: ("degrees", "Bessel", "DHDN", {}),
    3857: ("mercator", "Sphere", None, {}),
    3395: ("mercator", "WGS84", None, {}),
    27700: ("transverse", "Airy", "OSGB36", {"lat": 49, "lon": -2, "scale": 0.9996012717, "east": 400_000, "north": -100_000}),
    2193: ("transverse", "GRS80", None, {"lon": 173, "scale": 0.9996, "east": 1_600_000, "north": 10_000_000}),
    3067: ("transverse", "GRS80", None, {"lon": 27, "scale": 0.9996, "east": 500_000}),
    3006: ("transverse", "GRS80", None, {"lon": 15, "scale": 0.9996, "east": 500_000}),
    2180: ("transverse", "GRS80", None, {"lon": 19, "scale": 0.9993, "east": 500_000, "north": -5_300_000}),
    2154: ("conformal", "GRS80", None, {"lat": 46.5, "lon": 3, "first": 49, "second": 44, "east": 700_000, "north": 6_600_000}),
    3034: ("conformal", "GRS80", None, {"lat": 52, "lon": 10, "first": 35, "second": 65, "east": 4_000_000, "north": 2_800_000}),
    3347: ("conformal", "GRS80", None, {"lat": 63.390675, "lon": -91 - 52 / 60, "first": 49, "second": 77, "east": 6_200_000, "north": 3_000_000}),
    2263: ("conformal", "GRS80", None, {"lat": 40 + 10 / 60, "lon": -74, "first": 41 + 2 / 60, "second": 40 + 40 / 60, "east": 300_000, "unit": US_FOOT}),
    5070: ("equal-area", "GRS80", None, {"lat": 23, "lon": -96, "first": 29.5, "second": 45.5}),
    3577: ("equal-area", "GRS80", None, {"lon": 132, "first": -18, "second": -36}),
    3035: ("azimuthal", "GRS80", None, {"lat": 52, "lon": 10, "east": 4_321_000, "north": 3_210_000}),
    3031: ("polar", "WGS84", None, {"lat": -90, "first": -71}),
    3413: ("polar", "WGS84", None, {"lat": 90, "lon": -45, "first": 70}),
    3995: ("polar", "WGS84", None, {"lat": 90, "first": 71}),
    6933: ("cylindrical", "WGS84", None, {"first": 30}),
}

Pair = tuple[np.ndarray, np.ndarray]


def _parameters(srid: int) -> tuple[str, str, str | None, dict[str, float]] | None:
    """A system of the table, or one of the zones of six or three degrees."""
    if srid in SYSTEMS:
        return SYSTEMS[srid]
    family, zone = divmod(srid, 100)
    utm = {"lon": 6 * zone - 183, "scale": 0.9996, "east": 500_000}
    if family in (326, 327) and 1 <= zone <= 60:
        return "transverse", "WGS84", None, utm | {"north": 10_000_000 if family == 327 else 0}
    if family == 258 and 28 <= zone <= 38 or family == 269 and 1 <= zone <= 23:
        return "transverse", "GRS80", None, utm
    if 31466 <= srid <= 31469:
        k = srid - 31464
        return "transverse", "Bessel", "DHDN", {"lon": 3 * k, "east": 500_000 + 1_000_000 * k}
    return None


def known(srid: int) -> bool:
    return _parameters(srid) is not None


@dataclass(frozen=True)
class System:
    """Both directions between radians on the system's own ellipsoid and its coordinates."""

    kind: str
    shift: str | None
    a: float
    f: float
    lat: float = 0.0
    lon: float = 0.0
    first: float = 0.0
    second: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def isometric(self, lat: np.ndarray) -> np.ndarray:
        e, s = np.sqrt(self.e2), np.sin(lat)
        return np.arcsinh(np.tan(lat)) - e * np.arctanh(e * s)

    def from_isometric(self, psi: np.ndarray) -> np.ndarray:
        """Each step brings the latitude nearer by a factor of the squared eccentricity."""
        e, lat = np.sqrt(self.e2), np.arctan(np.sinh(psi))
        for _ in range(8 if e else 0):
            lat = np.arctan(np.sinh(psi + e * np.arctanh(e * np.sin(lat))))
        return lat

    def authalic(self, s: np.ndarray) -> np.ndarray:
        """The area between the equator and the latitude of sine s, halved and over the squared semi-major axis."""
        e = np.sqrt(self.e2)
        return (1 - e * e) * (s / (1 - e * e * s * s) + np.arctanh(e * s) / e) / 2

    def from_authalic(self, q: np.ndarray) -> np.ndarray:
        s = np.clip(q / self.authalic(np.float64(1)), -1, 1)
        for _ in range(8):
            s = np.clip(s * np.divide(q, self.authalic(s), out=np.ones_like(s), where=s != 0), -1, 1)
        return np.arcsin(s)

    def parallel(self, lat: float) -> float:
        """The radius of a parallel over the semi-major axis."""
        return np.cos(lat) / np.sqrt(1 - self.e2 * np.sin(lat) ** 2)

    # transverse Mercator, by series in the third flattening

    def _series(self) -> tuple[tuple[float, ...], tuple[float, ...], float]:
        n = self.f / (2 - self.f)
        ahead = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        return ahead, back, self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _transverse(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        ahead, _, r = self._series()
        t = np.sinh(self.isometric(lat))
        xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.hypot(1, t))
        x, y = eta.copy(), xi.copy()
        for j, c in enumerate(ahead, 1):
            x += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return r * x, r * y

    def transverse(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        x, y = self._transverse(d, lat)
        return self.scale * x, self.scale * (y - self._transverse(np.zeros(1), np.full(1, self.lat))[1])

    def from_transverse(self, x: np.ndarray, y: np.ndarray) -> Pair:
        _, back, r = self._series()
        xi, eta = (y / self.scale + self._transverse(np.zeros(1), np.full(1, self.lat))[1]) / r, x / self.scale / r
        a, b = xi.copy(), eta.copy()
        for j, c in enumerate(back, 1):
            a -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            b -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return np.arctan2(np.sinh(b), np.cos(a)), self.from_isometric(np.arcsinh(np.sin(a) / np.hypot(np.sinh(b), np.cos(a))))

    def mercator(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        return self.a * d, self.a * self.isometric(lat)

    def from_mercator(self, x: np.ndarray, y: np.ndarray) -> Pair:
        return x / self.a, self.from_isometric(y / self.a)

    # conic projections: a cone's constant n, and the distance from its tip

    def _cone(self) -> tuple[float, float]:
        one, two = self.parallel(self.first), self.parallel(self.second)
        n = np.log(one / two) / (self.isometric(self.second) - self.isometric(self.first))
        return n, self.a * one / n * np.exp(n * self.isometric(self.first))

    def conformal(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        n, size = self._cone()
        r = size * np.exp(-n * self.isometric(lat))
        return r * np.sin(n * d), size * np.exp(-n * self.isometric(self.lat)) - r * np.cos(n * d)

    def from_conformal(self, x: np.ndarray, y: np.ndarray) -> Pair:
        n, size = self._cone()
        d, r = _polar(n, x, size * np.exp(-n * self.isometric(self.lat)) - y)
        return d, self.from_isometric(np.log(size / r) / n)

    def _area_cone(self) -> tuple[float, float]:
        one, two = self.parallel(self.first), self.parallel(self.second)
        q, p = self.authalic(np.sin(self.first)), self.authalic(np.sin(self.second))
        n = (one**2 - two**2) / (2 * (p - q))
        return n, one**2 + 2 * n * q

    def _area_radius(self, lat: np.ndarray) -> np.ndarray:
        n, c = self._area_cone()
        return self.a * np.sqrt(c - 2 * n * self.authalic(np.sin(lat))) / n

    def equal_area(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        n, r = self._area_cone()[0], self._area_radius(lat)
        return r * np.sin(n * d), self._area_radius(np.float64(self.lat)) - r * np.cos(n * d)

    def from_equal_area(self, x: np.ndarray, y: np.ndarray) -> Pair:
        n, c = self._area_cone()
        d, r = _polar(n, x, self._area_radius(np.float64(self.lat)) - y)
        return d, self.from_authalic((c - (r * n / self.a) ** 2) / (2 * n))

    # azimuthal equal-area: an oblique sphere of the same area, stretched so that the origin is true to scale

    def _centre(self) -> tuple[float, float, float]:
        whole = self.authalic(np.float64(1))
        beta, r = np.arcsin(self.authalic(np.sin(self.lat)) / whole), np.sqrt(whole)
        return beta, r, self.parallel(self.lat) / (r * np.cos(beta))

    def azimuthal(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        own, r, stretch = self._centre()
        beta = np.arcsin(np.clip(self.authalic(np.sin(lat)) / self.authalic(np.float64(1)), -1, 1))
        b = self.a * r * np.sqrt(2 / (1 + np.sin(own) * np.sin(beta) + np.cos(own) * np.cos(beta) * np.cos(d)))
        return b * stretch * np.cos(beta) * np.sin(d), b / stretch * (np.cos(own) * np.sin(beta) - np.sin(own) * np.cos(beta) * np.cos(d))

    def from_azimuthal(self, x: np.ndarray, y: np.ndarray) -> Pair:
        own, r, stretch = self._centre()
        u, v = x / stretch, y * stretch
        rho = np.hypot(u, v)
        c = 2 * np.arcsin(rho / (2 * self.a * r))
        turn = np.divide(v, rho, out=np.zeros_like(rho), where=rho > 0)
        sine = np.cos(c) * np.sin(own) + np.sin(c) * turn * np.cos(own)
        return np.arctan2(u * np.sin(c), rho * np.cos(own) * np.cos(c) - v * np.sin(own) * np.sin(c)), self.from_authalic(sine * self.authalic(np.float64(1)))

    def polar(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        side = np.sign(self.lat)
        true = side * self.first
        r = self.a * self.parallel(true) * np.exp(self.isometric(true) - self.isometric(side * lat))
        return r * np.sin(d), -side * r * np.cos(d)

    def from_polar(self, x: np.ndarray, y: np.ndarray) -> Pair:
        side = np.sign(self.lat)
        true = side * self.first
        with np.errstate(divide="ignore"):  # the pole itself
            psi = self.isometric(true) - np.log(np.hypot(x, y) / (self.a * self.parallel(true)))
        return np.arctan2(x, -side * y), side * self.from_isometric(psi)

    def cylindrical(self, d: np.ndarray, lat: np.ndarray) -> Pair:
        k = self.parallel(self.first)
        return self.a * k * d, self.a * self.authalic(np.sin(lat)) / k

    def from_cylindrical(self, x: np.ndarray, y: np.ndarray) -> Pair:
        k = self.parallel(self.first)
        return x / (self.a * k), self.from_authalic(y * k / self.a)

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> Pair:
        """Radians to coordinates."""
        if self.kind == "degrees":
            return np.degrees(lon), np.degrees(lat)
        # no turn where the projection is straight: longitudes beyond 180 stay beyond
        d = lon - self.lon if self.kind == "mercator" else np.remainder(lon - self.lon + np.pi, 2 * np.pi) - np.pi
        x, y = getattr(self, self.kind.replace("-", "_"))(d, lat)
        return (x + self.east) / self.unit, (y + self.north) / self.unit

    def back(self, x: np.ndarray, y: np.ndarray) -> Pair:
        """Coordinates to radians."""
        if self.kind == "degrees":
            return np.radians(x), np.radians(y)
        d, lat = getattr(self, "from_" + self.kind.replace("-", "_"))(x * self.unit - self.east, y * self.unit - self.north)
        lon = d + self.lon
        return (lon if self.kind == "mercator" else np.where(np.abs(lon) > np.pi, lon - np.sign(lon) * 2 * np.pi, lon)), lat

    # geocentric coordinates on WGS 84

    def _helmert(self) -> tuple[np.ndarray, np.ndarray]:
        dx, dy, dz, rx, ry, rz, ppm = SHIFTS[self.shift] if self.shift else (0.0,) * 7
        rx, ry, rz = np.radians(np.array([rx, ry, rz]) / 3600)
        return (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]), np.array([dx, dy, dz])

    def to_centre(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        v = self.a / np.sqrt(1 - self.e2 * np.sin(lat) ** 2)
        own = np.stack([v * np.cos(lat) * np.cos(lon), v * np.cos(lat) * np.sin(lon), v * (1 - self.e2) * np.sin(lat)])
        turn, move = self._helmert()
        return turn @ own + move[:, None]

    def from_centre(self, xyz: np.ndarray) -> Pair:
        turn, move = self._helmert()
        x, y, z = np.linalg.solve(turn, xyz - move[:, None])
        p = np.hypot(x, y)
        lat = np.arctan2(z, p * (1 - self.e2))
        for _ in range(8):
            s = np.sin(lat)
            lat = np.arctan2(z + self.e2 * self.a * s / np.sqrt(1 - self.e2 * s * s), p)
        return np.arctan2(y, x), lat


@lru_cache(maxsize=256)
def system(srid: int) -> System:
    found = _parameters(srid)
    if found is None:
        raise ValueError(f"no transformation is known for SRID {srid}")
    kind, ellipsoid, shift, given = found
    a, inverse = ELLIPSOIDS[ellipsoid]
    return System(kind, shift, a, 1 / inverse, **{k: float(np.radians(v)) if k in ("lat", "lon", "first", "second") else float(v) for k, v in given.items()})


def _polar(n: float, x: np.ndarray, y: np.ndarray) -> Pair:
    """Angle from the cone's middle, over its constant, and distance from its tip with the constant's sign."""
    side = np.sign(n)
    return np.arctan2(side * x, side * y) / n, side * np.hypot(x, y)


def transform(c: np.ndarray, source: int, target: int) -> np.ndarray:
    """Coordinates of shape (n, 2 or more) from one SRID to another; z and m stay."""
    s, t = system(source), system(target)
    if s == t:
        return c
    x, y = s.back(c[:, 0], c[:, 1])
    if s.shift != t.shift:
        x, y = t.from_centre(s.to_centre(x, y))
    x, y = t.forward(x, y)
    return np.column_stack([x, y, *[c[:, k] for k in range(2, c.shape[1])]])
