"""Coordinates as two double columns: boxes, distances, grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small, written


def parse_box(text: str) -> tuple[float, float, float, float]:
    """(west, south, east, north) from four comma-separated numbers; ValueError before anything is planned."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4 or not all(map(math.isfinite, parts)) or parts[0] > parts[2] or parts[1] > parts[3]:
        raise ValueError(f"not a box: {text!r}")
    return tuple(parts)


def in_box(box, lng: str = "lng", lat: str = "lat") -> Column:
    """Inside the closed box (FLT-3)."""
    w, s, e, n = parse_box(box) if isinstance(box, str) else box
    return F.col(lng).between(w, e) & F.col(lat).between(s, n)


#: Bits of each coordinate in a cell key.
KEY_BITS = 24


def _quantised(value: Column | float, low: float, span: float, bits: int = KEY_BITS):
    """Which of 2^bits equal steps a coordinate falls in; the same arithmetic for columns and for the edges of a box, and monotone in both."""
    share = (value - low) / span * float(2**bits)
    if isinstance(value, float):
        return min(max(math.floor(share), 0), 2**bits - 1)
    return F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(2**bits - 1)).cast("long")


def cell_key(lng: str = "lng", lat: str = "lat") -> Column:
    """The place of a point on a Z-shaped curve through cells of the globe: near points have near keys. Null without coordinates."""

    def spread(x: Column) -> Column:  # a zero bit between all bits
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    x, y = _quantised(F.col(lng), -180.0, 360.0), _quantised(F.col(lat), -90.0, 180.0)
    return F.when(located(lng, lat), spread(x).bitwiseOR(F.shiftleft(spread(y), 1)))


def box_ranges(box, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cell keys (both ends in) that hold every point of a box: squares of the curve, the worst-fitting ones split first."""
    w, s, e, n = parse_box(box) if isinstance(box, str) else box
    x0, x1 = _quantised(float(w), -180.0, 360.0), _quantised(float(e), -180.0, 360.0)
    y0, y1 = _quantised(float(s), -90.0, 180.0), _quantised(float(n), -90.0, 180.0)

    def shared(x: int, y: int, size: int) -> int:
        return max(0, min(x + size - 1, x1) - max(x, x0) + 1) * max(0, min(y + size - 1, y1) - max(y, y0) + 1)

    def joined(squares) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for lo, _, _, size in sorted(squares):
            if out and out[-1][1] + 1 == lo:
                out[-1] = (out[-1][0], lo + size * size - 1)
            else:
                out.append((lo, lo + size * size - 1))
        return out

    squares = [(0, 0, 0, 2**KEY_BITS)]  # first key, x, y, size
    while True:
        loose = [(q[3] ** 2 - shared(*q[1:]), q) for q in squares if q[3] > 1]
        waste, worst = max(loose, default=(0, None))
        if not waste:
            return joined(squares)
        lo, x, y, size = worst
        half = size // 2
        parts = [(lo + i * half * half, x + half * (i & 1), y + half * (i >> 1), half) for i in range(4)]
        more = [q for q in squares if q != worst] + [q for q in parts if shared(*q[1:])]
        if len(joined(more)) > most:
            return joined(squares)
        squares = more


def in_cells(box, key: str = "cell", most: int = 32) -> Column:
    """A predicate on the stored key that every point of a box meets; together with ``in_box`` it lets the scan skip what lies elsewhere."""
    return reduce(Column.__or__, [F.col(key).between(lo, hi) for lo, hi in box_ranges(box, most)])


def located(lng: str = "lng", lat: str = "lat") -> Column:
    return F.col(lng).isNotNull() & F.col(lat).isNotNull()


def not_null_island(lng: str = "lng", lat: str = "lat") -> Column:
    """Not within one degree of (0, 0) both ways (FLT-4)."""
    return ~(F.col(lng).between(-1, 1) & F.col(lat).between(-1, 1))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def on_sphere(lng: str, lat: str, name: str) -> dict[str, Column]:
    """The place of a point on the unit sphere as columns ``name``x, y and z."""
    x, y = F.radians(lng), F.radians(lat)
    return {f"{name}x": F.cos(y) * F.cos(x), f"{name}y": F.cos(y) * F.sin(x), f"{name}z": F.sin(y)}


def within(km: float, earth_km: float, a: str, b: str, exact: Column) -> Column:
    """``exact`` <= km, a distance by ``haversine``, which is worked out only for pairs whose straight line (``on_sphere``) leaves it open; rounding is far below the margins."""
    line = 2 * math.sin(min(km / earth_km, math.pi) / 2)
    square = reduce(Column.__add__, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"])
    sure, open_ = max(line * (1 - 1e-9) - 1e-14, 0.0) ** 2, (line * (1 + 1e-9) + 1e-14) ** 2
    return (square <= open_) & ((square < sure) | (exact <= km))


def distance_m(lng: float, lat: float, radius_m: float = 6_371_000.0) -> Column:
    """Metres on the sphere from a point (JN-6)."""
    return haversine(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat), radius_m)


#: Halvings of a hot cell at most, each way.
DEEPEST = 6


def within_radius(a: DataFrame, b: DataFrame, km: float, earth_km: float = 6371.0, most: int = 20_000) -> DataFrame:
    """All pairs of rows (a.*, b.*, dist_km) at most ``km`` apart (JN-5); a has a_id, a_lng, a_lat, b has b_id, b_lng, b_lat.

    An equi-join on grid cells: b is put in its cell, a in those around its own; then the exact test. Each row of cells is cut round the
    globe into as many as its latitude allows, the last one next to the first; a row at a pole is one cell. Rows without coordinates meet nothing.
    A cell with more than ``most`` rows of b (counted) is cut into quarters, and these again, until they have fewer (``split_cells``); what
    stands at one place is dealt by b_id. So no key has more rows of b, and a row of a meets the quarters in its reach alone.
    """
    step = km / (earth_km * math.pi / 180) * 1.000001

    def cells(row: Column) -> Column:
        """How many cells a row has: each as wide as ``km`` at the latitude of its neighbours that is nearest to a pole."""
        top = (F.greatest(F.abs(row), F.abs(row + 1)) + 2) * step
        return F.when(top >= 89.0, 1).otherwise(F.greatest(F.floor(360.0 * F.cos(F.radians(top)) / step), F.lit(1))).cast("long")

    def across(lng: Column, row: Column) -> Column:
        return F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * cells(row)

    def column(lng: Column, row: Column) -> Column:
        return F.least(F.floor(across(lng, row)).cast("long"), cells(row) - 1)

    row = lambda lat: F.floor(lat / step).cast("long")
    near = lambda at: [at + i for i in (-1, 0, 1)]
    left = a.filter(located("a_lng", "a_lat")).withColumn("cy", F.explode(F.array(*near(row(F.col("a_lat"))))))
    around = F.array_distinct(F.array(*[F.pmod(x, F.col("_n")) for x in near(F.col("_x"))]))
    left = left.withColumns({"_n": cells(F.col("cy")), "_x": column(F.col("a_lng"), F.col("cy"))}).withColumn("cx", F.explode(around)).drop("_n", "_x")
    right = b.filter(located("b_lng", "b_lat")).withColumn("cy", row(F.col("b_lat"))).withColumn("cx", column(F.col("b_lng"), F.col("cy")))

    hot = written(right.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    key = ["cx", "cy"]
    if not hot.isEmpty():
        inside = lambda share: F.least(F.greatest(F.floor(share * 2**DEEPEST), F.lit(0)), F.lit(2**DEEPEST - 1)).cast("int")
        right = right.withColumns({"u": inside(across(F.col("b_lng"), F.col("cy")) - F.col("cx")), "v": inside(F.col("b_lat") / step - F.col("cy"))})
        parts = written(split_cells(right.join(small(hot.select("cx", "cy")), ["cx", "cy"], "left_semi"), most))
        of = parts.select("cx", "cy", F.explode("deep").alias("e"), "part", "salts").select("cx", "cy", "e.u", "e.v", "part", "salts")
        whole = F.coalesce("part", F.lit(""))
        right = right.join(small(of), ["cx", "cy", "u", "v"], "left").withColumns({"part": whole, "salt": F.coalesce(F.pmod(F.xxhash64("b_id"), F.col("salts")), F.lit(0))}).drop("u", "v", "salts")
        # where a part lies, and what of it a point may reach
        size = F.lit(1.0) / F.pow(F.lit(2.0), F.length("part"))
        boxes = parts.withColumns({"n": cells(F.col("cy")), "w": size}).select(
            "cx", "cy", "part", "salts",
            ((F.col("cx") + F.col("pu") * F.col("w")) * 360.0 / F.col("n")).alias("west"), ((F.col("cx") + (F.col("pu") + 1) * F.col("w")) * 360.0 / F.col("n")).alias("east"),
            ((F.col("cy") + F.col("pv") * F.col("w")) * step).alias("south"), ((F.col("cy") + (F.col("pv") + 1) * F.col("w")) * step).alias("north"),
        )
        at = F.pmod(F.col("a_lng") + 180.0, F.lit(360.0))
        turn = F.when(at.between(F.col("west"), F.col("east")), 0.0).otherwise(F.least(F.pmod(F.col("west") - at, F.lit(360.0)), F.pmod(at - F.col("east"), F.lit(360.0))))
        flat = F.greatest(F.least(F.cos(F.radians("south")), F.cos(F.radians("north"))), F.lit(0.0)) * F.cos(F.radians("a_lat"))
        reach = km * (1 + 1e-6) + 1e-3
        beside = 2 * earth_km * F.asin(F.sqrt(F.least(flat * F.pow(F.sin(F.radians(turn) / 2), 2), F.lit(1.0)))) <= reach
        above = F.radians(F.greatest(F.col("south") - F.col("a_lat"), F.col("a_lat") - F.col("north"), F.lit(0.0))) * earth_km <= reach
        left = left.join(small(boxes), ["cx", "cy"], "left").filter(F.col("part").isNull() | (beside & above)).drop("west", "east", "south", "north")
        left = left.withColumns({"part": whole, "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))}).drop("salts")
        key += ["part", "salt"]
    left, right = left.withColumns(on_sphere("a_lng", "a_lat", "_a")), right.withColumns(on_sphere("b_lng", "b_lat", "_b"))
    dist = haversine(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat"), earth_km)
    met = left.join(right, key).filter(within(km, earth_km, "_a", "_b", dist))
    return met.withColumn("dist_km", dist).drop(*key, *[f"_{side}{c}" for side in "ab" for c in "xyz"])


def split_cells(rows: DataFrame, most: int) -> DataFrame:
    """(cx, cy, part, pu, pv, deep, salts): the quarters, by count, of the cells of ``rows`` (cx, cy and the place u, v in them, of 2^DEEPEST steps).

    part names a quarter by its way down (a digit 0 to 3 for each halving); pu, pv say where it lies among those of its size; deep lists the
    places in it that have rows; salts is how many keys it takes where halving doesn't help. Counts are taken once, at the places.
    """
    n = rows.groupBy("cx", "cy", "u", "v").agg(F.count("*").alias("n"))
    digit = lambda d: (F.shiftright("u", DEEPEST - d).bitwiseAND(F.lit(1)) + 2 * F.shiftright("v", DEEPEST - d).bitwiseAND(F.lit(1))).cast("string")
    ways = [F.concat(F.lit(""), *[digit(i) for i in range(1, d + 1)]) for d in range(DEEPEST + 1)]
    n = n.withColumn("way", ways[-1])
    levels = n.select("cx", "cy", "n", F.explode(F.array(*ways)).alias("part")).groupBy("cx", "cy", "part").agg(F.sum("n").alias("held"))
    each = n.select("*", F.explode(F.array(*ways)).alias("part")).join(levels, ["cx", "cy", "part"])
    few = each.filter((F.col("held") <= most) | (F.length("part") == DEEPEST))
    leaf = few.groupBy("cx", "cy", "u", "v").agg(F.min(F.struct(F.length("part").alias("d"), "part", "held")).alias("l"))
    out = leaf.groupBy("cx", "cy", "l.part", F.col("l.d").alias("d"), "l.held").agg(F.collect_list(F.struct("u", "v")).alias("deep"))  # at most 4^DEEPEST places
    first, down = F.col("deep")[0], F.lit(DEEPEST) - F.col("d")
    at = lambda c: F.call_function("shiftright", first[c], down)
    return out.select("cx", "cy", "part", at("u").alias("pu"), at("v").alias("pv"), "deep", F.ceil(F.col("held") / most).cast("long").alias("salts"))


def department_of(postal: Column) -> Column:
    """Five digits give a department: 97 and 98 three digits, 20 split at 20200 into 2A and 2B, else two (PRJ-3)."""
    p = F.trim(postal)
    two = F.substring(p, 1, 2)
    return F.when(p.rlike("^[0-9]{5}$"), F.when(two.isin("97", "98"), F.substring(p, 1, 3)).when(two == "20", F.when(p < "20200", "2A").otherwise("2B")).otherwise(two))


def jitter(df: DataFrame, id_: str = "id", width: float = 0.004) -> DataFrame:
    """Coordinates moved by up to half of ``width`` each way, derived from the id so that a replay places rows alike; flagged as approximate (PRJ-26)."""
    off = lambda salt: (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(salt)))), 1, 8), 16, 10).cast("long"), F.lit(10_001)) / 10_000.0 - 0.5) * width
    return df.withColumns({"lng": F.col("lng") + off(1), "lat": F.col("lat") + off(2), "geo_approx": F.lit(True)})


def pixel_cell(zoom: int, radius_px: int = 56, lng: str = "lng", lat: str = "lat") -> tuple[Column, Column]:
    """The Web-Mercator grid cell of ``radius_px`` pixels at a zoom."""
    world = 256.0 * 2**zoom
    x = (F.col(lng) + 180.0) / 360.0 * world
    s = F.sin(F.radians(F.col(lat)))
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * world
    return F.floor(x / radius_px).cast("long"), F.floor(y / radius_px).cast("long")
