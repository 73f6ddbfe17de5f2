"""Geometry on plain doubles: polygon edges, geodesic distance, crossing tests."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import once

# WGS84 ellipsoid.
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
_POLAR = AXIS * (1 - FLATTENING)

# Each round shrinks the error of the longitude term about 300 times; six leave none that a
# double can show, for points that are not nearly antipodal.
_ROUNDS = 6


def distance(lon, lat, seed_lon, seed_lat) -> Column:
    """Metres on the ellipsoid from the point in columns lon, lat to the seed point; null
    without a point or without a seed. Vincenty's inverse solution."""
    if seed_lon is None or seed_lat is None:
        return F.lit(None).cast("double")
    u2 = math.atan((1 - FLATTENING) * math.tan(math.radians(float(seed_lat))))
    sin2, cos2 = math.sin(u2), math.cos(u2)

    def step(p, state):
        x = cos2 * F.sin(state["l"])
        y = p["c"] * sin2 - p["s"] * cos2 * F.cos(state["l"])
        arc = F.struct(
            F.sqrt(x * x + y * y).alias("ss"), (p["s"] * sin2 + p["c"] * cos2 * F.cos(state["l"])).alias("cs"),
            (p["c"] * x).alias("n"),
        )

        def azimuth(a):
            sa = F.when(a["ss"] == 0, F.lit(0.0)).otherwise(a["n"] / F.nullif(a["ss"], F.lit(0.0)))
            return once(F.struct(a["ss"], a["cs"], sa.alias("sa"), (1 - sa * sa).alias("c2")), midpoint)

        def midpoint(a):
            # On the equator the line has no northernmost point, and the term is 0.
            cm = F.when(a["c2"] == 0, F.lit(0.0)).otherwise(
                a["cs"] - 2 * sin2 * p["s"] / F.nullif(a["c2"], F.lit(0.0)))
            cc = FLATTENING / 16 * a["c2"] * (4 + FLATTENING * (4 - 3 * a["c2"]))
            return once(F.struct(a["ss"], a["cs"], a["sa"], a["c2"], cm.alias("cm"), cc.alias("cc"),
                                 F.atan2(a["ss"], a["cs"]).alias("sg")), longitude)

        def longitude(a):
            bend = a["sg"] + a["cc"] * a["ss"] * (a["cm"] + a["cc"] * a["cs"] * (2 * a["cm"] * a["cm"] - 1))
            l = p["dl"] + (1 - a["cc"]) * FLATTENING * a["sa"] * bend
            return F.struct(l.alias("l"), a["ss"], a["cs"], a["c2"], a["cm"], a["sg"])

        return once(arc, azimuth)

    def metres(a):
        q = a["c2"] * ((AXIS**2 - _POLAR**2) / _POLAR**2)
        scale = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        b = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        bend = a["cs"] * (2 * a["cm"] * a["cm"] - 1) - b / 6 * a["cm"] * (4 * a["ss"] * a["ss"] - 3) * (
            4 * a["cm"] * a["cm"] - 3)
        return _POLAR * scale * (a["sg"] - b * a["ss"] * (a["cm"] + b / 4 * bend))

    def solve(p):
        zero = F.lit(0.0)
        start = F.struct(p["dl"].alias("l"), *[zero.alias(n) for n in ("ss", "cs", "c2", "cm", "sg")])
        rounds = F.sequence(F.lit(1), F.lit(_ROUNDS))
        return F.aggregate(rounds, start, lambda state, _: step(p, state), metres)

    u1 = F.atan((1 - FLATTENING) * F.tan(F.radians(F.col(lat))))
    point = F.struct(F.sin(u1).alias("s"), F.cos(u1).alias("c"),
                     F.radians(F.lit(float(seed_lon)) - F.col(lon)).alias("dl"))
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), once(point, solve))


# Digits behind the point that the exact test of sides keeps of a coordinate below 1000.
_EXACT = "decimal(17,14)"


def side_sql(ax, ay, bx, by, px, py, apart: bool = False) -> str:
    """SQL for 1 if the point lies to the left of the line a-b, -1 to the right, 0 on it; the
    arguments are SQL too.

    Doubles decide where their rounding cannot matter. Nearer to the line the coordinates are taken
    as the decimals that they are written as, and sums and products of those are exact: three digits
    before the point and fourteen behind it make products of 37 digits. So a point on a slanted
    border is on it, though its double is not. `apart` keeps that rare case out of the compiled code,
    which is otherwise too long for the JVM to optimise where several sides are tested."""
    def exact(c):
        return f"try_cast({c} AS {_EXACT})"

    right, left = f"({bx} - {ax}) * ({py} - {ay})", f"({px} - {ax}) * ({by} - {ay})"
    spread = f"abs({bx} - {ax}) + abs({py} - {ay}) + abs({px} - {ax}) + abs({by} - {ay})"
    turn = (f"({exact(bx)} - {exact(ax)}) * ({exact(py)} - {exact(ay)}) - ({exact(px)} - {exact(ax)}) * ({exact(by)} - {exact(ay)})")
    rare = f"coalesce(signum(double({turn})), signum({right} - {left}))"
    return (f"CASE WHEN abs({right} - {left}) > 5E-16D * (abs({right}) + abs({left})) + 6E-14D * ({spread}) "
            f"THEN signum({right} - {left}) ELSE {once_sql('0', '_z', rare) if apart else rare} END")


def within_sql(ax, ay, bx, by, px, py) -> str:
    """SQL: is the point in the box that has the segment as its diagonal?"""
    return f"({px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"


def once_sql(value: str, name: str, use: str) -> str:
    """SQL `use` with `name` for `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def segments_meet(p, q) -> Column:
    """Do two segments, each named by its columns (x1, y1, x2, y2), share a point? Touching counts."""
    ax, ay, bx, by = p
    cx, cy, dx, dy = q
    sides = (f"named_struct('c', {side_sql(*p, cx, cy)}, 'd', {side_sql(*p, dx, dy)}, "
             f"'a', {side_sql(*q, ax, ay)}, 'b', {side_sql(*q, bx, by)})")
    on = " OR ".join(f"(s.{k} = 0 AND {within_sql(*line, x, y)})" for k, line, x, y in (
        ("c", p, cx, cy), ("d", p, dx, dy), ("a", q, ax, ay), ("b", q, bx, by)))
    near = (f"greatest({ax}, {bx}) >= least({cx}, {dx}) AND greatest({cx}, {dx}) >= least({ax}, {bx}) AND "
            f"greatest({ay}, {by}) >= least({cy}, {dy}) AND greatest({cy}, {dy}) >= least({ay}, {by})")
    return F.expr(f"CASE WHEN {near} THEN {once_sql(sides, 's', f'(s.c * s.d < 0 AND s.a * s.b < 0) OR {on}')} ELSE false END")


def _spread(c) -> Column:
    """The 16 bits of a number with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def morton(lon, lat) -> Column:
    """The place of a point on a curve that fills the map, such that points near on the curve are near
    on the map: the bits of longitude and latitude in turn. Null without a point."""
    def steps(c, least, span):
        return F.least(F.greatest(F.floor((F.col(c) - least) / span * 65536), F.lit(0)), F.lit(65535)).cast("long")

    curve = _spread(steps(lon, -180.0, 360.0)) + F.shiftleft(_spread(steps(lat, -90.0, 180.0)), 1)
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), curve)
