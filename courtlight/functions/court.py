"""Column functions of the court: 20 x 44 ft, the net at y = 22."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: feet
WIDTH, LENGTH, NET, KITCHEN = 20.0, 44.0, 22.0, 7.0
MARGIN_X, MARGIN_Y = 4.0, 8.0
METRES = 0.3048


def oriented(x: Column, y: Column, how: Column) -> Column:
    """A point seen from another corner; an unknown or null orientation gives null."""
    flip_x, flip_y = how.isin("rotate_180", "mirror_x"), how.isin("rotate_180", "mirror_y")
    point = F.struct(F.when(flip_x, WIDTH - x).otherwise(x).alias("x"), F.when(flip_y, LENGTH - y).otherwise(y).alias("y"))
    return F.when(how.isin("identity", "rotate_180", "mirror_x", "mirror_y"), point)


def in_bounds(x: Column, y: Column) -> Column:
    return x.between(0.0, WIDTH) & y.between(0.0, LENGTH)


def visibility(x: Column, y: Column) -> Column:
    near = x.between(-MARGIN_X, WIDTH + MARGIN_X) & y.between(-MARGIN_Y, LENGTH + MARGIN_Y)
    return F.when(in_bounds(x, y), "inside").when(near, "visible_outside").otherwise("dropped")


def in_kitchen(x: Column, y: Column) -> Column:
    return x.between(0.0, WIDTH) & y.between(NET - KITCHEN, NET + KITCHEN)


def band(y: Column) -> Column:
    """Kitchen, transition or backcourt by the distance from the net; null off the court."""
    far = F.abs(y - NET)
    return F.when(far <= KITCHEN, "kitchen").when(far <= KITCHEN + 8.0, "transition").when(far <= NET, "backcourt")


def zone_12(x: Column, y: Column) -> Column:
    """A landing's zone, 1 to 12: thirds of the width by four depths from the net; null off the court."""
    third = F.least(F.lit(2), F.floor(x / (WIDTH / 3)).cast("int"))
    depth = F.abs(y - NET)
    row = F.when(depth < 7, 0).when(depth < 12, 1).when(depth < 17, 2).otherwise(3)
    return F.when(in_bounds(x, y), row * 3 + third + 1).cast("int")


def landing_call(x: Column, y: Column, tolerance: float | Column = 0.1) -> Column:
    """in, out or unknown within the tolerance of a line, by the signed distance to the boundary (positive inside)."""
    inside = F.least(x, WIDTH - x, y, LENGTH - y)
    out_x, out_y = F.greatest(-x, x - WIDTH, F.lit(0.0)), F.greatest(-y, y - LENGTH, F.lit(0.0))
    distance = F.when(in_bounds(x, y), inside).otherwise(-F.sqrt(out_x * out_x + out_y * out_y))
    return F.when(F.abs(distance) <= tolerance, "unknown").when(distance > 0, "in").otherwise("out")


def player_key(name: Column) -> Column:
    """P1, Player 1, player_1 and the like as P1; other names trimmed."""
    number = F.regexp_extract(name, r"(?i)^\s*p(?:layer)?[ _-]*0*([0-9]+)\s*$", 1)
    return F.when(number != "", F.concat(F.lit("P"), number)).otherwise(F.trim(name))
