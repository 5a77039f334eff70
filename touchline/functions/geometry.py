"""Pitch geometry as Column expressions (metres, origin at the centre spot, attack towards +x).

A missing coordinate is NULL. Predicates answer false for it, measures stay NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as C


def to_canonical_x(u: Column) -> Column:
    return (u - F.lit(0.5)) * F.lit(C.PITCH_LENGTH)


def to_canonical_y(v: Column) -> Column:
    # source y grows downwards
    return (F.lit(0.5) - v) * F.lit(C.PITCH_WIDTH)


def to_unit_x(x: Column) -> Column:
    return x / F.lit(C.PITCH_LENGTH) + F.lit(0.5)


def to_unit_y(y: Column) -> Column:
    return F.lit(0.5) - y / F.lit(C.PITCH_WIDTH)


def rotate(coordinate: Column, sign: Column) -> Column:
    """Half-turn of the pitch: apply to both axes with the same sign, never to one."""
    return coordinate * sign


def in_box(x: Column, y: Column) -> Column:
    inside = (x >= C.BOX_X_MIN) & (x <= C.HALF_LENGTH) & (F.abs(y) <= C.BOX_Y_MAX)
    return F.coalesce(inside, F.lit(False))


def on_pitch(x: Column, y: Column, tolerance: float = 0.0) -> Column:
    inside = (F.abs(x) <= C.HALF_LENGTH + tolerance) & (F.abs(y) <= C.HALF_WIDTH + tolerance)
    return F.coalesce(inside, F.lit(False))


def distance(x: Column, y: Column, tx: Column, ty: Column) -> Column:
    return F.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))


def goal_distance(x: Column, y: Column) -> Column:
    return distance(x, y, F.lit(C.HALF_LENGTH), F.lit(0.0))


def goal_angle(x: Column, y: Column) -> Column:
    dx = F.lit(C.HALF_LENGTH) - x
    upper = F.atan2(F.lit(C.GOAL_HALF_WIDTH) - y, dx)
    lower = F.atan2(F.lit(-C.GOAL_HALF_WIDTH) - y, dx)
    return F.coalesce(F.when(dx > 0, F.abs(upper - lower)), F.lit(0.0))
