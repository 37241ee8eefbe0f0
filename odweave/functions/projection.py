"""Map projections as closed forms in Spark expressions, by the number of their reference system."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis and squared eccentricity of the GRS 80 ellipsoid; the sphere of web maps has the same axis.
GRS80 = (6378137.0, 0.006694380022900788)
#: Reference systems in degrees. They differ by a metre or two at most, which is not corrected.
GEOGRAPHIC = (4269, 4326)


@dataclass(frozen=True)
class WebMercator:
    """Spherical Mercator."""

    radius: float = GRS80[0]

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon) * self.radius, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * self.radius

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / self.radius), F.degrees(2 * F.atan(F.exp(y / self.radius)) - math.pi / 2)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic on an ellipsoid, with two standard parallels; angles in degrees."""

    lat0: float
    lon0: float
    parallels: tuple[float, float]
    easting: float = 0.0
    northing: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    def _q(self, sine: float) -> float:
        e2 = self.ellipsoid[1]
        e = math.sqrt(e2)
        return (1 - e2) * (sine / (1 - e2 * sine * sine) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, the constant under the root, and the radius at the origin."""
        a, e2 = self.ellipsoid
        sines = [math.sin(math.radians(p)) for p in self.parallels]
        m = [(1 - s * s) / (1 - e2 * s * s) for s in sines]
        q = [self._q(s) for s in sines]
        n = sines[0] if sines[0] == sines[1] else (m[0] - m[1]) / (q[1] - q[0])
        c = m[0] + n * q[0]
        return n, c, a * math.sqrt(c - n * self._q(math.sin(math.radians(self.lat0)))) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        (a, e2), (n, c, rho0) = self.ellipsoid, self._cone()
        e, sine = math.sqrt(e2), F.sin(F.radians(lat))
        q = (1 - e2) * (sine / (1 - e2 * sine * sine) - F.log((1 - e * sine) / (1 + e * sine)) / (2 * e))
        rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return self.easting + rho * F.sin(theta), self.northing + rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        (a, e2), (n, c, rho0) = self.ellipsoid, self._cone()
        east, south = x - self.easting, rho0 - (y - self.northing)
        side = math.copysign(1.0, n)
        q = (c - (east * east + south * south) * (n / a) ** 2) / n
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(1.0))))
        e4, e6 = e2**2, e2**3
        lat = (
            beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
            + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
        )
        return self.lon0 + F.degrees(F.atan2(side * east, side * south)) / n, F.degrees(lat)


# Parameters of public reference systems.
SYSTEMS: dict[int, WebMercator | Albers] = {
    3857: WebMercator(),
    5070: Albers(23.0, -96.0, (29.5, 45.5)),
    3488: Albers(0.0, -120.0, (34.0, 40.5), northing=-4_000_000.0),
}


def project_point(p: Column, source: int, target: int) -> Column:
    """A point struct in another reference system, by way of degrees."""
    for srid in (source, target):
        if srid not in GEOGRAPHIC and srid not in SYSTEMS:
            raise ValueError(f"unknown reference system {srid}")
    if source == target or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return p
    x, y = p["x"], p["y"]
    if source in SYSTEMS:
        x, y = SYSTEMS[source].inverse(x, y)
    if target in SYSTEMS:
        x, y = SYSTEMS[target].forward(x, y)
    return F.when(p.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
