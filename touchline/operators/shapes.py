"""What the players of a frame amount to for the team that attacks: a batch of frames at a time.

Arrays of players reach Python as flat lists of numbers and leave it as one number a feature and hypothesis. Inside, a batch is a
matrix (player, frame), so sums over players add in the order of the array. NaN stands for NULL: comparisons with it are false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as C


def _known(v: np.ndarray) -> np.ndarray:
    return (~np.isnan(v)).sum(axis=0)


def _mean(v: np.ndarray) -> np.ndarray:
    return np.nansum(v, axis=0) / np.where(n := _known(v), n, np.nan)


def _or(v: np.ndarray, other: float) -> np.ndarray:
    return np.where(np.isnan(v), other, v)


def _dist(x, y, tx, ty) -> np.ndarray:
    return np.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))


class Team:
    """One team's players: ``own`` marks them, ``gk`` is 1 for a keeper, 0 for others, NaN where unknown."""

    def __init__(self, own: np.ndarray, gk: np.ndarray, x: np.ndarray, y: np.ndarray, vx: np.ndarray | None, ball_x: np.ndarray, ball_y: np.ndarray):
        self.own, self.gk, self.ball_x, self.ball_y = own, gk, ball_x, ball_y
        self.x, self.y = np.where(own, x, np.nan), np.where(own, y, np.nan)
        self.vx = None if vx is None else np.where(own, vx, np.nan)

    @cached_property
    def size(self):
        return self.own.sum(axis=0)

    @cached_property
    def outfield(self):
        return self.own & (self.gk == 0)

    @cached_property
    def far(self):
        """Distance of each player to the ball."""
        return _dist(self.x, self.y, self.ball_x, self.ball_y)

    @cached_property
    def near(self):
        """The same, nearest first."""
        return _rows(np.sort(self.far, axis=0), 3)

    @cached_property
    def xs(self):
        """Outfield x in order, unknown ones last."""
        return _rows(np.sort(np.where(self.outfield, self.x, np.nan), axis=0), 4)

    @cached_property
    def ys(self):
        return np.where(self.outfield, self.y, np.nan)

    @cached_property
    def mean_x(self):
        return _or(_mean(self.xs), 0.0)

    @cached_property
    def sd_x(self):
        return _or(np.sqrt(_mean((self.xs - _mean(self.xs)) ** 2)), 0.0)

    @cached_property
    def sd_y(self):
        return _or(np.sqrt(_mean((self.ys - _mean(self.ys)) ** 2)), 0.0)

    @cached_property
    def mean_vx(self):
        return _or(_mean(self.vx), 0.0)

    @cached_property
    def spread(self):
        """Mean distance of the outfield from its mean x and the team's mean y."""
        middle = _or(_mean(self.y), 0.0)
        return _or(_mean(np.where(self.outfield, _dist(self.x, self.y, self.mean_x, middle), np.nan)), 0.0)

    def keeper(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first marked keeper; without one that of the player with the smallest x, towards ``s``, and then y."""
        marked = self.own & (self.gk == 1)
        up = np.where(s > 0, 1.0, -1.0)
        # an unknown y sorts first, as NULL does, and before the players of other x
        x, y = self.x * up, np.where(np.isnan(self.y), -1e300, self.y) * up
        x = np.where(np.isnan(x), np.inf, x)
        y = np.where(x == x.min(axis=0, initial=np.inf), y, np.inf)
        lines, at = np.arange(self.own.shape[1]), np.where(marked.any(axis=0), marked.argmax(axis=0), y.argmin(axis=0)) if len(marked) else 0
        return (self.x[at, lines], self.y[at, lines]) if len(marked) else (np.full(len(lines), np.nan),) * 2


def _rows(v: np.ndarray, n: int) -> np.ndarray:
    """At least ``n`` rows, so that the first ones can be named."""
    return v if len(v) >= n else np.concatenate([v, np.full((n - len(v), v.shape[1]), np.nan)])


class Attack:
    """A hypothesis: ``a`` attacks, ``d`` defends, ``s`` turns the pitch so that the attack is towards +x."""

    def __init__(self, a: Team, d: Team, s: np.ndarray):
        self.a, self.d, self.s = a, d, s
        self.bx, self.by = a.ball_x * s, a.ball_y * s


def _second(team: Team) -> np.ndarray:
    # a squad of one has no second nearest: the nearest stands in
    return _or(np.where(team.size > 1, team.near[1], team.near[0]), C.FAR_M)


def _in_box(h: Attack, team: Team) -> np.ndarray:
    x = team.x * h.s
    return ((x >= C.BOX_X_MIN) & (x <= C.HALF_LENGTH) & (np.abs(team.y) <= C.BOX_Y_MAX)).sum(axis=0)


def _highest(h: Attack) -> np.ndarray:
    top = np.nanmax(np.where(np.isnan(h.a.xs), -np.inf, h.a.xs), axis=0)
    return _or(np.where(h.s > 0, np.where(np.isinf(top), np.nan, top), -h.a.xs[0]), 0.0)


def _line(h: Attack) -> np.ndarray:
    # the four smallest x, i.e. the most advanced four in this orientation
    turned = np.sort(-h.d.xs, axis=0)
    return _or(np.where(h.s > 0, _mean(h.d.xs[:4]), _mean(turned[:4])), 0.0)


def _keeper_dist(h: Attack, tx, ty) -> np.ndarray:
    x, y = h.d.keeper(h.s)
    return _or(_dist(x * h.s, y * h.s, tx, ty), C.FAR_M)


def _space(h: Attack) -> np.ndarray:
    x, y = h.d.x * h.s, h.d.y * h.s
    ahead = (x > h.bx) & (np.abs(np.arctan2(y - h.by, np.maximum(x - h.bx, 1e-6))) <= np.pi / 4)
    nearest = np.where(ahead & ~np.isnan(h.d.far), h.d.far, np.inf).min(axis=0, initial=np.inf)
    room = np.minimum(np.where(np.isinf(nearest), C.FAR_M, nearest), np.maximum(C.HALF_LENGTH - h.bx, 0.0))
    return np.where(np.isnan(h.bx), 0.0, room)


FEATURES: dict[str, Callable[[Attack], np.ndarray]] = {
    "attackers_ahead_of_ball": lambda h: (h.a.x * h.s > h.bx).sum(axis=0),
    "attackers_in_box": lambda h: _in_box(h, h.a),
    "attackers_in_final_third": lambda h: (h.a.x * h.s >= C.FINAL_THIRD_X).sum(axis=0),
    "attack_centroid_x": lambda h: h.a.mean_x * h.s,
    "attack_width": lambda h: h.a.sd_y,
    "attack_depth": lambda h: h.a.sd_x,
    "attack_highest_x": _highest,
    "attack_mean_v_goalward": lambda h: h.a.mean_vx * h.s,
    "attackers_moving_goalward": lambda h: (h.a.vx * h.s > 0.5).sum(axis=0),
    "defenders_in_box": lambda h: _in_box(h, h.d),
    "defenders_goalside_of_ball": lambda h: (h.d.x * h.s > h.bx).sum(axis=0),
    "defensive_line_x": _line,
    "defensive_compactness": lambda h: h.d.spread,
    "defence_centroid_x": lambda h: h.d.mean_x * h.s,
    "defence_mean_v_goalward": lambda h: h.d.mean_vx * h.s,
    "gk_dist_to_ball": lambda h: _keeper_dist(h, h.bx, h.by),
    "gk_dist_to_goal": lambda h: _keeper_dist(h, C.HALF_LENGTH, 0.0),
    "nearest_defender_dist": lambda h: _or(h.d.near[0], C.FAR_M),
    "second_nearest_defender_dist": lambda h: _second(h.d),
    "mean_three_nearest_defender_dist": lambda h: _or(_mean(h.d.near[:3]), C.FAR_M),
    "nearest_attacker_support_dist": lambda h: _second(h.a),
    "space_ahead_of_ball": _space,
    "defenders_within_10m_of_ball": lambda h: (h.d.far <= C.PRESSURE_RADIUS_M).sum(axis=0),
}
#: features that read the velocities of players
MOVING = frozenset({"attack_mean_v_goalward", "attackers_moving_goalward", "defence_mean_v_goalward"})


def _matrix(lists: pa.ListArray, width: int, values: pa.Array | None = None) -> np.ndarray:
    """(place in the list, row) of numbers, NaN where there is none; ``values`` replaces those of the lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    flat = (lists.flatten() if values is None else values).cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return np.ascontiguousarray(flat.reshape(len(lengths), width).T)
    out = np.full((width, len(lengths)), np.nan)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[place[inside], row[inside]] = flat[inside]
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _measure(names: Sequence[str], team, gk, x, y, vx, ball_x, ball_y, signs: Sequence) -> list[list[np.ndarray]]:
    """The features ``names`` of a batch of frames, the home team attacking and the away team attacking."""
    width = team.value_lengths().fill_null(0).to_numpy().max(initial=0)
    kinds = team.flatten()
    marks, xs, ys = (_matrix(c, width) for c in (gk, x, y))
    speeds = None if vx is None else _matrix(vx, width)
    bx, by = _numbers(ball_x), _numbers(ball_y)
    with np.errstate(invalid="ignore", divide="ignore"):
        sides = [Team(_matrix(team, width, pc.equal(kinds, t)) == 1, marks, xs, ys, speeds, bx, by) for t in C.TEAMS]
        return [
            [np.asarray(FEATURES[n](h), float) for n in names]
            for h in (Attack(a, d, _numbers(s)) for (a, d), s in zip(pairwise([*sides, sides[0]]), signs, strict=True))
        ]


#: columns of :func:`block_features`: the lists of :func:`touchline.operators.features.player_lists`, and what they are measured against
LISTS, AGAINST = ("_team", "_gk", "_x", "_y", "_vx"), ("ball_x", "ball_y", "home_sign", "away_sign")


def block_features(rows: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    """(row, feature) by attacking team: features of the players from their lists, the others from the structs named by team."""
    column = lambda c: rows[c].combine_chunks()
    shaped = [n for n in names if n in FEATURES]
    *against, home, away = map(column, AGAINST)
    made = _measure(shaped, *map(column, LISTS), *against, (home, away))
    out = {}
    for team, values in zip(C.TEAMS, made, strict=True):
        known, rest = dict(zip(shaped, values, strict=True)), column(f"_{team}")
        out[team] = np.stack([known[n] if n in known else _numbers(pc.struct_field(rest, n)) for n in names], axis=1)
    return out


def frame_features(names: Sequence[str], players: dict[str, Column]) -> Column:
    """A struct by attacking team of the features ``names``; ``players`` are lists ``team``, ``is_gk``, ``x``, ``y`` and, where needed, ``vx``."""
    names, moving = tuple(names), bool(MOVING & set(names))
    fields = ", ".join(f"{n}: double" for n in names)

    def run(team: pa.Array, gk: pa.Array, x: pa.Array, y: pa.Array, ball_x: pa.Array, ball_y: pa.Array, home: pa.Array, away: pa.Array, *vx: pa.Array) -> pa.Array:
        sides = _measure(names, team, gk, x, y, vx[0] if vx else None, ball_x, ball_y, (home, away))
        return pa.StructArray.from_arrays([pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in side], list(names)) for side in sides], list(C.TEAMS))

    udf = F.arrow_udf(run, ", ".join(f"{t}: struct<{fields}>" for t in C.TEAMS))
    lists = [players[c] for c in ("team", "is_gk", "x", "y")]
    return udf(*lists, *map(F.col, ("ball_x", "ball_y", "home_sign", "away_sign")), *([players["vx"]] if moving else []))
