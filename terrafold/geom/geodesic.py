"""Distances, bearings and destinations on the sphere and on the WGS 84 ellipsoid."""

from __future__ import annotations

import math

MEAN_RADIUS = 6371008.8  # metres, mean of the WGS 84 semi-axes
A, F = 6378137.0, 1 / 298.257223563
B = A * (1 - F)


def haversine(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * MEAN_RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _series(u2: float) -> tuple[float, float]:
    """Coefficients of the distance series in the ellipsoid's second eccentricity."""
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    return a, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _bend(b: float, ss: float, cs: float, cm: float) -> float:
    return b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))


def direct(lon: float, lat: float, azimuth: float, metres: float) -> tuple[float, float, float]:
    """Longitude, latitude and bearing (radians) after ``metres`` along a geodesic that starts at ``azimuth`` radians."""
    u = math.atan((1 - F) * math.tan(math.radians(lat)))
    su, cu, sa1, ca1 = math.sin(u), math.cos(u), math.sin(azimuth), math.cos(azimuth)
    s1 = math.atan2(math.tan(u), ca1)
    sa = cu * sa1
    c2 = 1 - sa * sa
    big_a, big_b = _series(c2 * (A * A - B * B) / (B * B))
    sigma = base = metres / (B * big_a)
    for _ in range(100):
        ss, cs, cm = math.sin(sigma), math.cos(sigma), math.cos(2 * s1 + sigma)
        new = base + _bend(big_b, ss, cs, cm)
        if abs(new - sigma) < 1e-15:
            sigma = new
            break
        sigma = new
    ss, cs, cm = math.sin(sigma), math.cos(sigma), math.cos(2 * s1 + sigma)
    lat2 = math.atan2(su * cs + cu * ss * ca1, (1 - F) * math.hypot(sa, su * ss - cu * cs * ca1))
    lam = math.atan2(ss * sa1, cu * cs - su * ss * ca1)
    c = F / 16 * c2 * (4 + F * (4 - 3 * c2))
    turn = lam - (1 - c) * F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    lon2 = (lon + math.degrees(turn) + 540) % 360 - 180
    return lon2, math.degrees(lat2), math.atan2(sa, -su * ss + cu * cs * ca1)


def inverse(lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[float, float]:
    """Metres and bearing at the start (radians, 0 to 2 pi) of the shortest geodesic."""
    if (lon1, lat1) == (lon2, lat2):
        return 0.0, 0.0
    gap = math.radians((lon2 - lon1 + 540) % 360 - 180)
    u1, u2 = (math.atan((1 - F) * math.tan(math.radians(v))) for v in (lat1, lat2))
    su1, cu1, su2, cu2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    lam = gap
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        if ss == 0:
            return (0.0, 0.0) if cl > 0 else _antipodal(lon1, lat1, lon2, lat2)
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = math.atan2(ss, cs)
        sa = cu1 * cu2 * sl / ss
        c2 = 1 - sa * sa
        cm = cs - 2 * su1 * su2 / c2 if c2 > 1e-15 else 0.0
        c = F / 16 * c2 * (4 + F * (4 - 3 * c2))
        new = gap + (1 - c) * F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        if abs(new) > math.pi:
            return _antipodal(lon1, lat1, lon2, lat2)
        if abs(new - lam) < 1e-14:
            big_a, big_b = _series(c2 * (A * A - B * B) / (B * B))
            azimuth = math.atan2(cu2 * math.sin(new), cu1 * su2 - su1 * cu2 * math.cos(new))
            return B * big_a * (sigma - _bend(big_b, ss, cs, cm)), azimuth % (2 * math.pi)
        lam = new
    return _antipodal(lon1, lat1, lon2, lat2)


def _antipodal(lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[float, float]:
    """Nearly opposite points, where the iteration doesn't settle: the start bearing and length that hit the target, by search."""
    target = math.radians(lon2), math.radians(lat2)

    def miss(azimuth: float, metres: float) -> tuple[float, float]:
        x, y, _ = direct(lon1, lat1, azimuth, metres)
        east = (math.radians(x) - target[0] + math.pi) % (2 * math.pi) - math.pi
        return east * math.cos(target[1]), math.radians(y) - target[1]

    best = (math.inf, 0.0, 0.0)
    for k in range(72):
        a, s = 2 * math.pi * k / 72, math.pi * (A + B) / 2 * 0.9995
        for _ in range(60):  # Newton steps with numeric derivatives
            e, n = miss(a, s)
            ea, na = miss(a + 1e-7, s)
            es, ns = miss(a, s + 1.0)
            j = ((ea - e) / 1e-7, es - e, (na - n) / 1e-7, ns - n)
            det = j[0] * j[3] - j[1] * j[2]
            if not det:
                break
            da, ds = (e * j[3] - n * j[1]) / det, (j[0] * n - j[2] * e) / det
            a, s = a - max(-0.3, min(0.3, da)), s - max(-2e5, min(2e5, ds))
            if abs(ds) < 1e-6 and abs(da) < 1e-12:
                break
        if math.hypot(*miss(a, s)) < 1e-11 and 0 < s < best[0] - 1e-6:
            best = (s, a % (2 * math.pi), 0.0)
    if best[0] == math.inf:
        return B * math.pi, 0.0  # over a pole
    return best[0], best[1]
