"""Distances, bearings and local frames on the sphere and the WGS84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scoring sphere's radius, and WGS84.
SPHERE_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
EARTH_RATE = 7.292115e-5
GRAVITY_EQUATOR, GRAVITY_K = 9.7803253359, 0.00193185265241
GM, OMEGA2A3_GM = 3.986004418e14, 0.00344978650684


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres between near points in degrees."""
    east, north = local_xy(lat2, lon2, lat1, lon1)
    return F.sqrt(east * east + north * north)


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres from an origin, on the scoring sphere."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * SPHERE_M, F.radians(lat - lat0) * SPHERE_M


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, north-clockwise, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def radii(lat: Column) -> tuple[Column, Column]:
    """Prime-vertical and meridional radii of WGS84, in metres."""
    w = 1 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), 2)
    return WGS84_A / F.sqrt(w), WGS84_A * (1 - WGS84_E2) / F.pow(w, 1.5)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north, up from an anchor, by the anchor's radii."""
    n, m = radii(lat0)
    return F.radians(lon - lon0) * (n + alt0) * F.cos(F.radians(lat0)), F.radians(lat - lat0) * (m + alt0), alt - alt0


def geodetic(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """The inverse of :func:`enu`."""
    n, m = radii(lat0)
    return lat0 + F.degrees(north / (m + alt0)), lon0 + F.degrees(east / ((n + alt0) * F.cos(F.radians(lat0)))), alt0 + up


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a geodetic position."""
    n, _ = radii(lat)
    p = (n + alt) * F.cos(F.radians(lat))
    return p * F.cos(F.radians(lon)), p * F.sin(F.radians(lon)), (n * (1 - WGS84_E2) + alt) * F.sin(F.radians(lat))


def geodetic_of_ecef(x: Column, y: Column, z: Column, rounds: int = 6) -> tuple[Column, Column, Column]:
    """Latitude and longitude in degrees and height, by a fixed number of iterations."""
    p = F.sqrt(x * x + y * y)

    def height(lat: Column) -> tuple[Column, Column]:
        n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(lat), 2))
        return n, p / F.cos(lat) - n

    def step(lat: Column, _: Column) -> Column:
        n, h = height(lat)
        return F.atan2(z, p * (1 - WGS84_E2 * n / (n + h)))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1 - WGS84_E2)), step)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height(lat)[1]


def normal_gravity(lat: Column, height: Column) -> Column:
    """Gravity of the ellipsoid at a height: Somigliana's formula and the free-air terms."""
    s2 = F.pow(F.sin(F.radians(lat)), 2)
    surface = GRAVITY_EQUATOR * (1 + GRAVITY_K * s2) / F.sqrt(1 - WGS84_E2 * s2)
    free_air = 1 - 2 / WGS84_A * (1 + WGS84_F + OMEGA2A3_GM - 2 * WGS84_F * s2) * height + 3 / WGS84_A**2 * height * height
    return surface * free_air


def transport_rate(lat: Column, height: Column, v_east: Column, v_north: Column) -> Column:
    """Rotation of the local ENU frame over the Earth, rad/s."""
    n, m = radii(lat)
    return F.array(-v_north / (m + height), v_east / (n + height), v_east * F.tan(F.radians(lat)) / (n + height))


def extrapolated(lat: Column, lon: Column, speed: Column, course: Column, seconds: Column) -> tuple[Column, Column]:
    """Where constant speed and course lead to, on the scoring sphere."""
    d = speed * seconds
    return lat + F.degrees(d * F.cos(F.radians(course)) / SPHERE_M), lon + F.degrees(d * F.sin(F.radians(course)) / (SPHERE_M * F.cos(F.radians(lat))))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """In range, numbers, and not the null island."""
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(known & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def confidence_radius(sigma: Column) -> Column:
    """The radius that holds a 2-D normal error with 95 %: sqrt of chi-square (2) at 0.95 times sigma."""
    return F.sqrt(F.lit(5.991)) * sigma
