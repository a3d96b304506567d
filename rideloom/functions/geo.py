"""Great-circle expressions; everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = EARTH_KM * 1000
EARTH_MILES = 3958.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of the radius; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # Rounding may bring a over 1 and asin to NaN: a quarter turn then. Each input is evaluated as few times as can be.
    return F.lit(2 * radius) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2))


def is_place(lat: Column, lon: Column) -> Column:
    """False for (0, 0), for a coordinate beyond 90 or 180 degrees, and for null or NaN."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    la1, la2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dlon) * F.cos(la2)
    y = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_deg: Column, km: Column) -> tuple[Column, Column]:
    """Where one arrives, rounded to 6 decimals."""
    d, b, la = km / EARTH_KM, F.radians(bearing_deg), F.radians(lat)
    la2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lo2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(la2))
    return F.round(F.degrees(la2), 6), F.round(F.degrees(lo2), 6)


def box_around(lat: Column, lon: Column, km: float) -> dict[str, Column]:
    """Bounding box of a radius at 111.32 km a degree, cut at the poles and the date line."""
    dla = km / 111.32
    dlo = F.lit(dla) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    cut = lambda c, most: F.greatest(F.least(c, F.lit(float(most))), F.lit(-float(most)))
    return {"lat_min": cut(lat - dla, 90), "lat_max": cut(lat + dla, 90), "lon_min": cut(lon - dlo, 180), "lon_max": cut(lon + dlo, 180)}


#: Fixed value: the digits of geohash.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


_BASE32 = "0123456789abcdefghijklmnopqrstuv"


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Interleaved binary digits of longitude and latitude, five to a sign; 1 to 12 signs."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * 2.0**n_lon), F.lit(2**n_lon - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * 2.0**n_lat), F.lit(2**n_lat - 1)).cast("long")
    split = lambda v, n: F.split(F.lpad(F.bin(v), n, "0"), "")
    woven = F.array_join(F.flatten(F.zip_with(split(x, n_lon), split(y, n_lat), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    code = F.translate(F.lpad(F.lower(F.conv(woven, 2, 32)), precision, "0"), _BASE32, GEOHASH_DIGITS)
    return F.when(is_finite(lat, lon), code)


def is_finite(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)


def geohash_box(code: Column) -> Column:
    """struct(lat_min, lat_max, lon_min, lon_max) of a code."""
    woven = F.split(F.lpad(F.conv(F.translate(code, GEOHASH_DIGITS, _BASE32), 32, 2), F.length(code) * 5, F.lit("0")), "")
    number = lambda odd: F.conv(F.array_join(F.filter(woven, lambda x, i: i % 2 == odd), ""), 2, 10).cast("double")
    n = {"lon": number(0), "lat": number(1)}
    h, w = 180.0 / F.pow(2.0, F.floor(F.length(code) * 5 / 2)), 360.0 / F.pow(2.0, F.ceil(F.length(code) * 5 / 2))
    return F.struct((n["lat"] * h - 90).alias("lat_min"), ((n["lat"] + 1) * h - 90).alias("lat_max"), (n["lon"] * w - 180).alias("lon_min"), ((n["lon"] + 1) * w - 180).alias("lon_max"))


def geohash_neighbours(lat: Column, lon: Column, precision: int) -> Column:
    """The eight cells around that of a point: longitude wraps, latitude stops at the poles."""
    bits = 5 * precision
    h, w = 180.0 / 2 ** (bits // 2), 360.0 / 2 ** ((bits + 1) // 2)
    around = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                la = F.greatest(F.least(lat + i * h, F.lit(90.0)), F.lit(-90.0))
                around.append(geohash(la, F.pmod(lon + j * w + 180, F.lit(360.0)) - 180, precision))
    return F.array_distinct(F.array(*around))


def hex_cell(lat: Column, lon: Column, res: int) -> Column:
    """A simulated hexagonal cell id: axial coordinates cut towards zero, not the public H3 system."""
    size = 10.0 / 2**res
    q, r = (lon / size * (2.0 / 3)).cast("int"), ((lat - lon * 0.5) / size * (2.0 / 3)).cast("int")
    return F.concat_ws("_", F.lit(str(res)), q.cast("string"), r.cast("string"))


def hex_disk(q: Column, r: Column, k: int) -> Column:
    """Array of struct(q, r) within k steps of a cell."""
    cells = [(i, j) for i in range(-k, k + 1) for j in range(max(-k, -i - k), min(k, -i + k) + 1)]
    return F.array(*[F.struct((q + i).alias("q"), (r + j).alias("r")) for i, j in cells])
