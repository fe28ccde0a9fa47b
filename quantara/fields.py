"""The logical particle table: names, groups, codecs and the errors of bad input."""

from __future__ import annotations

# Logical columns in order, and the names by which each is found, in order of preference.
ALIASES = {
    "id": ("id", "particle_id", "pid"),
    "x": ("x", "posx", "position_x"),
    "y": ("y", "posy", "position_y"),
    "z": ("z", "posz", "position_z"),
    "vx": ("vx", "velx", "velocity_x"),
    "vy": ("vy", "vely", "velocity_y"),
    "vz": ("vz", "velz", "velocity_z"),
}
LOGICAL = tuple(ALIASES)
POSITIONS = ("x", "y", "z")
VELOCITIES = ("vx", "vy", "vz")
GROUPS = {"positions": POSITIONS, "id": ("id",), "velocities": VELOCITIES}

#: Triplet codecs fix a row order of their own; the others work field by field in a given order.
#: ``sorted``: per-axis (max-norm) bound, spatial order. ``lattice``: Euclidean bound, spatial order.
#: ``linear``: per-field quantiser. ``delta``: per-field quantiser and differences.
TRIPLET_CODECS = ("sorted", "lattice")
FIELD_CODECS = ("linear", "delta")
CODECS = TRIPLET_CODECS + FIELD_CODECS
LOSSLESS = ("packed",)

#: Bytes of a value by Spark type.
ITEM_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "decimal(20,0)": 8}
INTEGERS = ("tinyint", "smallint", "int", "bigint", "decimal(20,0)")
FLOATS = ("float", "double")
#: Values of one batch of equal chunks, and the largest chunk (its places are 32-bit).
BATCH_VALUES = 1 << 20
MAX_CHUNK = 1 << 31


class ParticleError(RuntimeError):
    """Input, options or a package that cannot be used."""


def check_codec_pair(positions: str, velocities: str) -> None:
    """Velocities may have a triplet codec only beside positions that have one; ``sorted`` only beside ``sorted``."""
    if positions not in CODECS or velocities not in CODECS:
        raise ParticleError(f"codecs are {', '.join(CODECS)}; got {positions!r} and {velocities!r}")
    allowed = {"sorted": ("sorted",), "lattice": TRIPLET_CODECS}.get(velocities, CODECS)
    if positions not in allowed:
        raise ParticleError(f"velocity codec {velocities!r} needs a position codec of {', '.join(allowed)}, not {positions!r}")
