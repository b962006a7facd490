"""Distances and the cell grid that turns a range join into an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MI = 3958.8                               # fixed value: the Earth's radius in miles
MI_PER_DEGREE = math.pi * EARTH_MI / 180


def cos_lat(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def fn_haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Miles between two points. Where many pairs are made of few points, the cosines of their latitudes (`cos_lat`) may be given, worked out once
    for each point."""
    cos1, cos2 = cos_lat(lat1) if cos1 is None else cos1, cos_lat(lat2) if cos2 is None else cos2
    a = (F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0))
         + cos1 * cos2 * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    return 2 * EARTH_MI * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


class Grid:
    """Bands of equal latitude cut into columns, each cell at least `mi` miles wide where points of its band or the next
    can lie, so two points within `mi` are in the same or in neighbouring cells anywhere on the globe."""

    def __init__(self, mi: float):
        self.mi = mi
        self.dlat = mi / MI_PER_DEGREE * 1.0001

    def _columns(self, y: Column) -> Column:
        """How many columns a band has: the reach in degrees at its far edge, one band further out, decides."""
        edge = (F.greatest(F.abs(y), F.abs(y + 1)) + 1) * self.dlat
        reach = 2 * F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(self.dlat) / 2) / F.cos(F.radians(edge)))))
        return F.when(edge < 89, F.greatest(F.lit(1), F.floor(360 / (reach * 1.0001)))).otherwise(F.lit(1)).cast("bigint")

    def _column(self, y: Column, lon: Column) -> Column:
        n = self._columns(y)
        return F.pmod(F.floor((lon + 180) * n / 360), n).cast("bigint")

    def cell(self, lat: Column, lon: Column) -> Column:
        y = F.floor(lat / self.dlat).cast("bigint")
        return F.struct(y.alias("y"), self._column(y, lon).alias("x"))

    def around(self, lat: Column, lon: Column) -> Column:
        """The point's cell and its neighbours, over the date line too."""
        y = F.floor(lat / self.dlat).cast("bigint")
        cells = []
        for dy in (-1, 0, 1):
            x, n = self._column(y + dy, lon), self._columns(y + dy)
            cells += [F.struct((y + dy).alias("y"), F.pmod(x + dx, n).alias("x")) for dx in (-1, 0, 1)]
        return F.array_distinct(F.array(*cells))


def small_cell(lat: Column, lon: Column, mi: float) -> Column:
    """A cell no two points of which are more than `mi` miles apart."""
    side = mi / MI_PER_DEGREE / math.sqrt(2) * 0.999
    return F.struct(F.floor(lat / side).alias("y"), F.floor(lon / side).alias("x"))


def square(lat: Column, lon: Column, per_degree: int) -> tuple[Column, Column]:
    """The rounded square a point falls in, `per_degree` to a degree: a shop's point and its outline share one."""
    return F.bround(lat * per_degree).cast("bigint"), F.bround(lon * per_degree).cast("bigint")
