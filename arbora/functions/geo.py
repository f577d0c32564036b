"""Geohashes, distances and boxes as closed Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
# Fixed value: the digits of numbers to the base of 32, as ``conv`` writes them.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Letters whose bits a long holds.
LONGEST = 12


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres along a great circle."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2) * half(lng1, lng2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def cell(value: Column, low: float, width: float, bits: int) -> Column:
    """Number of the interval that holds a value, of 2**bits."""
    n = 2**bits
    return F.least(F.floor((value - low) / width * n), F.lit(n - 1)).cast("long")


def geohash(lat: Column, lng: Column, precision: int = 9) -> Column:
    """Longitude and latitude bits, interleaved, five to a letter."""
    total = precision * 5
    x, y = cell(lng, -180.0, 360.0, (total + 1) // 2), cell(lat, -90.0, 180.0, total // 2)
    parts = []
    for at in range(0, precision, LONGEST):  # a long holds the bits of so many letters
        rest = max(0, precision - at - LONGEST) * 5
        n = F.lit(min(LONGEST, precision - at))
        parts.append(cells_to_geohash(F.shiftright(x, (rest + 1) // 2), F.shiftright(y, rest // 2), n))
    return F.concat(*parts)


def _low(value: Column, bits: Column) -> Column:
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def _spread(value: Column) -> Column:
    """The bits of a number, each with a zero before it: its binary digits read to the base of 4."""
    return F.conv(F.bin(value), 4, 10).cast("long")


def _packed(value: Column) -> Column:
    """Every second bit of a number, from the last one on: the reverse of ``_spread``."""
    return F.conv(F.conv(value.bitwiseAND(F.lit(0x5555555555555555)).cast("string"), 10, 4), 2, 10).cast("long")


def _letters(x: Column, y: Column, length: Column) -> Column:
    """The geohash of spread cell numbers; the last bit is one of latitude where the number of bits is even."""
    odd = (length % 2).cast("int")
    both = F.call_function("shiftleft", x, 1 - odd).bitwiseOR(F.call_function("shiftleft", y, odd))
    return F.translate(F.lpad(F.conv(both.cast("string"), 10, 32), length, "0"), DIGITS, BASE32)


def cell_bits(length: Column) -> tuple[Column, Column]:
    """Bits of longitude and of latitude in a geohash of so many letters."""
    return F.floor((length * 5 + 1) / 2), F.floor(length * 5 / 2)


def cells(geohash_: Column) -> Column:
    """Struct (x, y, length) of a geohash's interval numbers; null where it is empty, over 12 letters or has a foreign one."""

    def of(g: Column) -> Column:
        n = F.length(g)
        odd = (n % 2).cast("int")
        both = F.conv(F.translate(g, BASE32, DIGITS), 32, 10).cast("long")
        shifted = lambda by: _packed(F.call_function("shiftright", both, by))
        return F.when(g.isNotNull(), F.struct(shifted(1 - odd).alias("x"), shifted(odd).alias("y"), n.alias("length")))

    valid = lambda g: F.when(g.rlike(f"^[{BASE32}]{{1,{LONGEST}}}$"), g)
    return _once(F.lower(geohash_), lambda g: _once(valid(g), of))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def cells_to_geohash(x: Column, y: Column, length: Column) -> Column:
    xbits, ybits = cell_bits(length)
    return _letters(_spread(_low(x, xbits)), _spread(_low(y, ybits)), length)


def decode(geohash_: Column) -> Column:
    """Struct (lat, lng) of the cell's centre; letters of either case."""

    def centre(c: Column) -> Column:
        xbits, ybits = cell_bits(c["length"])
        return F.struct(((c["y"] + 0.5) * 180.0 / F.pow(F.lit(2.0), ybits) - 90.0).alias("lat"), ((c["x"] + 0.5) * 360.0 / F.pow(F.lit(2.0), xbits) - 180.0).alias("lng"))

    return _once(cells(geohash_), lambda c: F.when(c.isNotNull(), centre(c)))


def neighbours(geohash_: Column, wrap: bool = True) -> Column:
    """Geohashes around a cell.

    ``wrap``: the 8 others from north clockwise, clamped at the poles, across the antimeridian.
    Without: the cell itself first and those of the 8 that the map has.
    """
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]

    def of(c: Column) -> Column:
        xbits, ybits = cell_bits(c["length"])
        nx, ny = F.pow(F.lit(2.0), xbits).cast("long"), F.pow(F.lit(2.0), ybits).cast("long")
        steps = (-1, 0, 1)
        if wrap:
            xs, ys = [F.pmod(c["x"] + d, nx) for d in steps], [F.greatest(F.lit(0), F.least(c["y"] + d, ny - 1)) for d in steps]
        else:
            within = lambda v, n: F.when((v >= 0) & (v < n), v)
            xs, ys = [within(c["x"] + d, nx) for d in steps], [within(c["y"] + d, ny) for d in steps]
        # three columns and three rows of cells are spread once; where one is off the map, so is the geohash
        spread = F.struct(F.array(*map(_spread, xs)).alias("x"), F.array(*map(_spread, ys)).alias("y"))
        at = around if wrap else [(0, 0), *around]
        return _once(spread, lambda s: F.array(*[_letters(s["x"][dx + 1], s["y"][dy + 1], c["length"]) for dx, dy in at]))

    near = _once(cells(geohash_), lambda c: F.when(c.isNotNull(), of(c)))
    return near if wrap else F.array_compact(near)


def covering(spark: SparkSession, south: float, west: float, north: float, east: float, precision: int) -> DataFrame:
    """(geohash): the cells that meet a box, each once; west over east means across the antimeridian.

    One range of numbers makes the grid, so a fine one is made in tasks.
    """
    nx, ny = 2 ** ((precision * 5 + 1) // 2), 2 ** (precision * 5 // 2)
    at = lambda v, low, width, n: max(0, min(n - 1, int((v - low) / width * n)))
    x0, x1, y0, y1 = at(west, -180, 360, nx), at(east, -180, 360, nx), at(south, -90, 180, ny), at(north, -90, 180, ny)
    columns = x1 - x0 + 1 if west <= east else min(nx, nx - x0 + x1 + 1)
    k = F.col("id")
    grid = spark.range(columns * (y1 - y0 + 1)).select(((k % columns + x0) % nx).alias("x"), (F.floor(k / columns) + y0).alias("y"))
    return grid.select(cells_to_geohash(F.col("x"), F.col("y"), F.lit(precision)).alias("geohash"))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; west over east means across the antimeridian."""
    wide = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return lat.between(south, north) & wide


def near_box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A box that holds the circle: what a scan can skip by; poles and antimeridian open it."""
    import math

    dlat = math.degrees(km / EARTH_KM)
    south, north = at_lat - dlat, at_lat + dlat
    if south <= -90 or north >= 90:
        return lat.between(max(south, -90.0), min(north, 90.0))
    dlng = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / math.cos(math.radians(at_lat)))))
    west, east = at_lng - dlng, at_lng + dlng
    if dlng >= 180:
        return lat.between(south, north)
    return in_box(lat, lng, south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east)
