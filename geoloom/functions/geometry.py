"""Geometry as columns: distances, areas, angles, projections. Rings and lines are array<struct<x,y>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
#: Metres per degree: longitude at the equator, latitude.
LON_M, LAT_M = 111_320.0, 110_540.0


def dist_equirect(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a plane at the mean latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = F.radians(lat2 - lat1)
    return F.sqrt(dx * dx + dy * dy) * EARTH


def dist_haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    p = F.sin(F.radians(lat2 - lat1) / 2)
    q = F.sin(F.radians(lon2 - lon1) / 2)
    a = p * p + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * q * q
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def node_key(lon: Column, lat: Column) -> Column:
    """Both coordinates at seven decimals as one key."""
    return F.concat_ws(":", F.bround(lon * 1e7, 0).cast("long").cast("string"), F.bround(lat * 1e7, 0).cast("long").cast("string"))


def edges(ring: Column) -> Column:
    """Consecutive vertices of a line as array<struct<a,b>>."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once; as a column used several times it would be computed each time."""
    return F.get(F.transform(F.array(value), f), 0)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, in squared units."""
    return F.abs(total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def ring_centroid(ring: Column) -> Column:
    """Centroid (x, y) of a closed ring; the mean of its vertices where the area is zero.

    Coordinates are taken relative to the first vertex, which keeps small rings exact."""
    first = F.element_at(ring, 1)
    relative = F.transform(ring, lambda v: F.struct((v["x"] - first["x"]).alias("x"), (v["y"] - first["y"]).alias("y")))

    def cross(e: Column) -> Column:
        return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]

    def center(near: Column, twice: Column) -> Column:
        def moment(axis: str) -> Column:
            return total(F.transform(edges(near), lambda e: (e["a"][axis] + e["b"][axis]) * cross(e))) / (3 * twice)

        def mean(axis: str) -> Column:
            return total(F.transform(near, lambda v: v[axis])) / F.size(near)

        return F.struct(
            (first["x"] + F.when(twice == 0, mean("x")).otherwise(moment("x"))).alias("x"),
            (first["y"] + F.when(twice == 0, mean("y")).otherwise(moment("y"))).alias("y"),
        )

    return let(relative, lambda near: let(total(F.transform(edges(near), cross)), lambda twice: center(near, twice)))


def area_km2(ring: Column) -> Column:
    """Area of a lon/lat ring with the scale of its centroid's latitude."""
    return ring_area(ring) * (LON_M / 1000) * F.cos(F.radians(ring_centroid(ring)["y"])) * (LAT_M / 1000)


def _moments(ring: Column) -> Column:
    """A closed ring's area and its products with the centroid (a, ax, ay), whatever its direction."""
    pair = F.struct(ring_area(ring).alias("a"), ring_centroid(ring).alias("c"))
    return let(pair, lambda p: F.struct(p["a"].alias("a"), (p["a"] * p["c"]["x"]).alias("ax"), (p["a"] * p["c"]["y"]).alias("ay")))


def polygon_centroid(rings: Column) -> Column:
    """Centroid of a polygon whose first ring is the outer one and whose others are holes; the outer ring's where nothing is left."""

    def left(all_: Column) -> Column:
        holes = F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))
        return F.struct(*[(F.get(all_, 0)[c] - total(F.transform(holes, lambda m: m[c]))).alias(c) for c in ("a", "ax", "ay")])  # noqa: B023

    def center(net: Column, plain: Column) -> Column:
        return F.struct(*[F.when(net["a"] > 0, net["a" + c] / net["a"]).otherwise(plain[c]).alias(c) for c in ("x", "y")])

    moments = let(F.transform(rings, _moments), left)
    return let(moments, lambda net: let(ring_centroid(F.get(rings, 0)), lambda plain: center(net, plain)))


def polygon_area_km2(rings: Column) -> Column:
    """Area of a lon/lat polygon less its holes, with the scale of its centroid's latitude; null rings: 0."""
    net = let(F.transform(rings, ring_area), lambda areas: F.get(areas, 0) - total(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0)))))
    return F.coalesce(net * (LON_M / 1000) * F.cos(F.radians(polygon_centroid(rings)["y"])) * (LAT_M / 1000), F.lit(0.0))


def longest_edge_angle(ring: Column) -> Column:
    """Bearing (degrees, 0 to 360) of the longest edge in raw units; the first wins ties; short rings: 0."""
    ranked = F.transform(
        edges(ring),
        lambda e: F.struct(
            (F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)).alias("d"),
            F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"])).alias("t"),
        ),
    )
    best = F.aggregate(
        ranked, F.struct(F.lit(-1.0).alias("d"), F.lit(0.0).alias("t")), lambda acc, e: F.when(e["d"] > acc["d"], e).otherwise(acc)
    )
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.pmod(best["t"], F.lit(360.0)))


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees of turning at b in metres: 0 straight on, 180 back; 0 where two points coincide."""
    scale = F.cos(F.radians(by)) * LON_M
    ux, uy, vx, vy = (bx - ax) * scale, (by - ay) * LON_M, (cx - bx) * scale, (cy - by) * LON_M
    sizes = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / sizes))
    return F.when(sizes == 0, 0.0).otherwise(F.degrees(F.acos(cosine)))


def bbox(ring: Column) -> Column:
    """west, south, east, north."""
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def bbox_metres(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Width and height in metres."""
    return (east - west) * LON_M * F.cos(F.radians((south + north) / 2)), (north - south) * LAT_M


def square_bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The box with its shorter side, in metres, grown about the centre to the longer one."""
    wide, high = bbox_metres(west, south, east, north)
    side = F.greatest(wide, high)
    dx, dy = side / (LON_M * F.cos(F.radians((south + north) / 2))) / 2, side / LAT_M / 2
    mx, my = (west + east) / 2, (south + north) / 2
    return F.struct(
        F.least(west, mx - dx).alias("west"), F.least(south, my - dy).alias("south"), F.greatest(east, mx + dx).alias("east"), F.greatest(north, my + dy).alias("north")
    )


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.concat(F.when(lat >= 0, "EPSG:326").otherwise("EPSG:327"), F.lpad(zone.cast("string"), 2, "0"))


def to_local(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column, width: Column, depth: Column) -> Column:
    """x (east) and z (north) metres from the south-west corner, scaled to the terrain's size."""
    return F.struct(((lon - west) / (east - west) * width).alias("x"), ((lat - south) / (north - south) * depth).alias("z"))


def to_wgs84(x: Column, z: Column, west: Column, south: Column, east: Column, north: Column, width: Column, depth: Column) -> Column:
    return F.struct((west + x / width * (east - west)).alias("lon"), (south + z / depth * (north - south)).alias("lat"))


def project_tm(lon: Column, lat: Column, central: float, scale: float = 0.9996, east0: float = 500_000.0, north0: float = 0.0) -> Column:
    """Transverse Mercator (Krueger series to the third order, GRS80): easting x and northing y."""
    a, f = 6_378_137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = math.sqrt(f * (2 - f))
    s = F.sin(F.radians(lat))

    def atanh(v: Column) -> Column:
        return F.log((1 + v) / (1 - v)) / 2

    t = F.sinh(atanh(s) - e * atanh(e * s))
    d = F.radians(lon - central)
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((east0 + scale * radius * x).alias("x"), (north0 + scale * radius * y).alias("y"))


def tile_id(lat: Column, lon: Column) -> Column:
    """Name of a one-degree tile by its south-west corner: N59_00_E016_00."""
    return F.format_string(
        "%s%02d_00_%s%03d_00", F.when(lat >= 0, "N").otherwise("S"), F.abs(lat).cast("int"), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon).cast("int")
    )


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def unproject_tm(x: Column, y: Column, central: float, scale: float = 0.9996, east0: float = 500_000.0, north0: float = 0.0) -> Column:
    """The inverse of ``project_tm``: lon and lat of an easting and northing."""
    a, f = 6_378_137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi, eta = (y - north0) / (scale * radius), (x - east0) / (scale * radius)
    u, v = xi, eta
    for k, c in enumerate(beta, 1):
        u = u - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for k, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * k * chi)
    lon = F.degrees(F.atan2(F.sinh(v), F.cos(u))) + central
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def transformed(parts: Column, move) -> Column:
    """Every vertex of a geometry (array of parts of rings of points) moved; ``move`` takes and gives a point."""
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, move)))


def envelope_points(west: Column, south: Column, east: Column, north: Column, n: int = 16) -> Column:
    """Samples along the four edges of a rectangle, corners included."""
    steps = F.sequence(F.lit(0), F.lit(n))

    def side(x, y) -> Column:
        return F.transform(steps, lambda k: F.struct(x(k / n).alias("x"), y(k / n).alias("y")))

    across, up = (lambda t: west + (east - west) * t), (lambda t: south + (north - south) * t)
    return F.concat(side(across, lambda t: south + 0 * t), side(across, lambda t: north + 0 * t), side(lambda t: west + 0 * t, up), side(lambda t: east + 0 * t, up))


def projected_envelope(west: Column, south: Column, east: Column, north: Column, central: float) -> Column:
    """Geographic box around a projected rectangle: its sampled edges taken back to degrees."""
    back = F.transform(envelope_points(west, south, east, north), lambda p: unproject_tm(p["x"], p["y"], central))
    lons, lats = F.transform(back, lambda p: p["lon"]), F.transform(back, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))
