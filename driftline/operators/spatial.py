"""Grid joins of points and road segments, projections and ranked candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geodesy import SPHERE_M


def cells(lat: Column, lon: Column, cell: float) -> tuple[Column, Column]:
    return F.floor(lat / cell), F.floor(lon / cell)


def cells_of(axis: str, cell: float, slack: float, of: Callable[[Column], Column] = F.explode) -> Column:
    """``of`` the cells along an axis that a segment's box, grown by ``slack`` degrees, touches."""
    a, b = f"{axis}1", f"{axis}2"
    return of(F.sequence(F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell)))


def segment_cells(segments: DataFrame, cell: float, slack: float) -> DataFrame:
    """Segments (lat1, lon1, lat2, lon2) once for each cell that their box, grown by ``slack`` degrees, touches."""
    return segments.withColumn("cell_lat", cells_of("lat", cell, slack)).withColumn("cell_lon", cells_of("lon", cell, slack))


def projection(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column]:
    """(metres, place in [0, 1], heading in radians) of a point's nearest point on a segment, in a flat frame at the point."""
    # in this order the last digits are those of the SQL: roads that meet in the nearest corner are ranked by them
    c = F.cos(F.radians(lat))
    x1, y1 = F.radians(lon1 - lon) * c * SPHERE_M, F.radians(lat1 - lat) * SPHERE_M
    x2, y2 = F.radians(lon2 - lon) * c * SPHERE_M, F.radians(lat2 - lat) * SPHERE_M
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / n))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(x1 + t * dx, 2) + F.pow(y1 + t * dy, 2)), t, F.atan2(dx, dy)


def candidates(points: DataFrame, segments: DataFrame, *, point: str, segment: str, cell: float, radius_m: float, most: int) -> DataFrame:
    """The ``most`` nearest segments within a radius of each point, nearest first.

    An equi-join on grid cells that are no smaller than the radius; a segment
    stands in every cell its grown box touches, so a point needs its own cell
    only and meets no segment twice.
    """
    slack = radius_m / SPHERE_M * 57.29577951308232 * 1.05
    lat, lon = cells(F.col("lat"), F.col("lon"), cell)
    at = points.withColumn("cell_lat", lat).withColumn("cell_lon", lon)
    met = at.join(segment_cells(segments, cell, slack), ["cell_lat", "cell_lon"])
    d, t, heading = projection(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = met.withColumn("distance_m", d).withColumn("place", t).withColumn("heading", heading).filter(F.col("distance_m") <= radius_m)
    rank = F.row_number().over(Window.partitionBy(point).orderBy("distance_m", segment))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).drop("cell_lat", "cell_lon")


def emission(distance_m: Column, residual: Column, sigma_m: float = 8.0, sigma_rad: float = 0.35) -> Column:
    """Log-likelihood of a candidate from its distance and its heading's residual."""
    return -0.5 * (F.pow(distance_m / sigma_m, 2) + F.pow(residual / sigma_rad, 2))
