"""The error-bound planner: options and a profile to bounds by field and triplet. Pure Python."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from quantara.fields import POSITIONS, VELOCITIES, ParticleError
from quantara.operators.stats import Profile
from quantara.plans.config import Settings

#: Relative bound where nothing is asked for.
DEFAULT_RELATIVE = 1e-3


@dataclass(frozen=True)
class Selection:
    """What was asked for of a class of fields."""

    mode: str  # relative or absolute
    absolute: dict[str, float]
    relative: float | None


@dataclass(frozen=True)
class TripletBound:
    """Euclidean bound of a triplet."""

    requested: float
    codec: float
    preprocess: float
    diagonal: float


@dataclass(frozen=True)
class Bounds:
    positions: Selection
    velocities: Selection
    position_codec: float  # per axis
    velocity_codec: dict[str, float]  # per field
    position_triplet: TripletBound
    velocity_triplet: TripletBound
    preprocess: dict[str, float]  # by field: cast and, for integers, rounding
    id_bound: float = 0.0

    def as_dict(self) -> dict:
        return asdict(self)


def check_bound(value: float, label: str) -> float:
    if value is None or not value >= 0 or math.isinf(value):
        raise ParticleError(f"{label} must be a finite number of at least 0, not {value!r}")
    return float(value)


def select(cfg: Settings, prefix: str, ranges: dict[str, float]) -> Selection:
    """The class's own bound goes before the common one; a relative and an absolute of the same level clash.

    A common absolute bound holds if it is given: the default relative bound does not hide it.
    """
    rel, absolute, label = getattr(cfg, f"{prefix}_rel_eb"), getattr(cfg, f"{prefix}_abs_eb"), prefix
    if rel is None and absolute is None:
        rel, absolute, label = cfg.rel_eb, cfg.abs_eb, "common"
        if rel is None and absolute is None:
            rel = DEFAULT_RELATIVE
    if rel is not None and absolute is not None:
        raise ParticleError(f"the {label} relative and absolute bounds cannot both be set")
    if rel is not None:
        rel = check_bound(rel, f"{label} relative bound")
        return Selection("relative", {f: rel * r for f, r in ranges.items()}, rel)
    absolute = check_bound(absolute, f"{label} absolute bound")
    return Selection("absolute", dict.fromkeys(ranges, absolute), None)


def _norm(values) -> float:
    return math.sqrt(sum(v * v for v in values))


def _triplet(selection: Selection, pre: dict[str, float], diagonal: float, subtract: bool) -> TripletBound:
    """Euclidean bound: of the bounding box's diagonal, or the absolute one; less what preparation already costs."""
    asked = selection.relative * diagonal if selection.mode == "relative" else min(selection.absolute.values())
    lost = _norm(pre.values())
    return TripletBound(asked, max(0.0, asked - lost) if subtract or selection.mode == "relative" else asked, lost, diagonal)


def plan(cfg: Settings, profile: Profile, scale: float, integer_positions: dict[str, bool]) -> Bounds:
    pos_ranges = {f: s.range for f, s in profile.positions.items()}
    vel_ranges = {f: s.range for f, s in profile.velocities.items()}
    pos_pre = {f: profile.positions[f].cast + (0.5 / scale if integer_positions.get(f) else 0.0) for f in POSITIONS}
    vel_pre = {f: profile.velocities[f].cast for f in VELOCITIES}
    pos, vel = select(cfg, "pos", pos_ranges), select(cfg, "vel", vel_ranges)

    if pos.mode == "relative":
        axis = min(max(0.0, pos.absolute[f] - pos_pre[f]) for f in POSITIONS)
    else:
        axis = min(pos.absolute.values())
    pos3 = _triplet(pos, pos_pre, _norm(pos_ranges.values()), subtract=cfg.pos_codec == "lattice")
    vel3 = _triplet(vel, vel_pre, _norm(vel_ranges.values()), subtract=True)
    if cfg.pos_codec == "lattice" and pos3.codec <= 0:
        raise ParticleError("the position bound leaves nothing for the lattice codec after narrowing")
    if cfg.vel_codec == "lattice" and vel3.codec <= 0:
        raise ParticleError("the velocity bound leaves nothing for the lattice codec after narrowing")
    if cfg.vel_codec == "sorted":
        fields = dict.fromkeys(VELOCITIES, min(max(0.0, vel.absolute[f] - vel_pre[f]) for f in VELOCITIES))
    else:
        fields = dict(vel.absolute)
    return Bounds(pos, vel, axis, fields, pos3, vel3, {**pos_pre, **vel_pre}, check_bound(cfg.id_abs_eb, "id bound"))


def targets(cfg: Settings, bounds: Bounds, profile: Profile, scale: float, integer_positions: dict[str, bool]) -> dict[str, float]:
    """By field, the error that the restored table may have in the end.

    Relative bounds hold as asked; an absolute bound of the positions (and of ``sorted`` velocities) holds for
    the codec, so narrowing and rounding come on top. Triplets with a Euclidean bound answer to it on each axis.
    """
    out = {"id": bounds.id_bound}
    for f in POSITIONS:
        if cfg.pos_codec == "lattice":
            out[f] = bounds.position_triplet.requested
        elif bounds.positions.mode == "relative":
            out[f] = bounds.positions.absolute[f]
        else:
            out[f] = bounds.position_codec + profile.positions[f].cast + (0.5 / scale if integer_positions.get(f) else 0.0)
    for f in VELOCITIES:
        if cfg.vel_codec == "lattice":
            out[f] = bounds.velocity_triplet.requested
        elif cfg.vel_codec == "sorted" and bounds.velocities.mode == "absolute":
            out[f] = bounds.velocity_codec[f] + profile.velocities[f].cast
        else:
            out[f] = bounds.velocities.absolute[f]
    return out


def tolerance(bound: float) -> float:
    return 1e-12 + 1e-6 * max(1.0, bound)
