"""Event taxonomy and parsing helpers as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as C


def event_type(raw: Column) -> Column:
    """Source event name to taxonomy; anything unrecognised becomes ``other``."""
    lookup = F.create_map(*[F.lit(v) for pair in C.RAW_EVENT_TYPES.items() for v in pair])
    return F.coalesce(lookup[F.upper(F.trim(raw))], F.lit("other"))


def is_dead_ball(kind: Column) -> Column:
    return kind.isin(*C.DEAD_BALL_TYPES)


def is_on_ball(kind: Column) -> Column:
    return kind.isin(*C.ON_BALL_TYPES)


def opponent(team: Column) -> Column:
    return F.when(team == "home", "away").when(team == "away", "home")


def team_code(team: Column) -> Column:
    return F.when(team == "home", 0).when(team == "away", 1).otherwise(-1)


def sign_label(sign: Column) -> Column:
    return F.when(sign >= 0, "+x").otherwise("-x")


def sign_of(value: Column) -> Column:
    """Direction sign of a measurement; zero counts as +x."""
    return F.when(value >= 0, 1).otherwise(-1)


def flip(sign: Column) -> Column:
    return -sign


def try_number(text: Column) -> Column:
    """Number, or NULL for blanks, NaN and garbage."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def redact(now: Column, end_frame: Column, value: Column) -> Column:
    """Outcome fields are visible only once the event has ended."""
    return F.when(end_frame <= now, value)


def end_not_before(start: Column, end: Column) -> Column:
    """End defaults to the start when absent or non-positive and never precedes it."""
    return F.greatest(start, F.when(end > 0, end).otherwise(start))


def margin(value: Column, scale: float) -> Column:
    if scale <= 0:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.abs(value) / F.lit(float(scale)))
