"""Column functions on axial azimuths: degrees in [0, 180), north 0, east 90. Failed fits are null, never NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(angle: Column) -> Column:
    return F.pmod(angle, F.lit(180.0))


def distance(angle: Column, center) -> Column:
    """Axial distance in [0, 90]."""
    c = center if isinstance(center, Column) else F.lit(float(center))
    return F.abs(F.pmod(folded(angle) - c + 90.0, F.lit(180.0)) - 90.0)


def share_near(angle: Column, centers: tuple[float, ...], tol: float = 10.0) -> Column:
    """Aggregate: the share of rows within tol of a center; null angles count as far, no rows give null."""
    near = F.least(*(distance(angle, c) for c in centers), F.lit(1e9)) if len(centers) > 1 else distance(angle, centers[0])
    return F.avg(F.coalesce(near <= tol, F.lit(False)).cast("int"))


def grid_fraction(angle: Column, tol: float = 10.0) -> Column:
    return share_near(angle, (0.0, 90.0), tol)


def diagonal_fraction(angle: Column, tol: float = 10.0) -> Column:
    return share_near(angle, (45.0, 135.0), tol)


def uniform_fraction(tol: float = 10.0) -> float:
    """The share near two perpendicular axes if azimuths are uniform."""
    return 2.0 * tol / 90.0


def asymmetry(angle: Column, tol: float = 10.0) -> Column:
    """Aggregate: rows near 135 by rows near 45; null if none is near 45."""
    return F.try_divide(F.count_if(distance(angle, 135.0) <= tol), F.count_if(distance(angle, 45.0) <= tol))


def grid_distance(angle: Column) -> Column:
    """Distance to the nearest of 0, 45, 90, 135 and 180."""
    return F.least(*(F.abs(angle - g) for g in (0.0, 45.0, 90.0, 135.0, 180.0)))


def well_resolved(aspect: Column, diameter: Column, res, aspect_min: float = 1.35, pixels_min: float = 8) -> Column:
    """Elongated (strictly) and wide enough in pixels; null measures fail."""
    return F.coalesce((aspect > aspect_min) & (diameter / res >= pixels_min), F.lit(False))


def geographic(angle: Column, convergence: Column, crs: Column) -> Column:
    """Azimuth from true north by a scene's meridian convergence, which is 0 for the eqc projection."""
    zero = F.coalesce(F.lower(crs).contains("+proj=eqc"), F.lit(False))
    return folded(angle - F.when(zero, F.lit(0.0)).otherwise(convergence))


def azimuth(dx: Column, dy: Column) -> Column:
    """Axial azimuth of a direction with east part dx and north part dy."""
    return folded(F.degrees(F.atan2(dx, dy)))
