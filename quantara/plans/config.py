"""Options: defaults, a file of them, and their checks, all before any data is touched."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from quantara.fields import LOSSLESS, TRIPLET_CODECS, ParticleError, check_codec_pair
from quantara.operators.chunk import check_options

SCALES = ("auto", "attr", "raw", "value")


@dataclass(frozen=True)
class Settings:
    abs_eb: float | None = None
    rel_eb: float | None = None
    pos_abs_eb: float | None = None
    pos_rel_eb: float | None = None
    vel_abs_eb: float | None = None
    vel_rel_eb: float | None = None
    id_abs_eb: float = 0.0
    position_scale: str = "auto"
    position_scale_attr: str = "bitwidth"
    position_scale_value: float | None = None
    pos_codec: str = "sorted"
    vel_codec: str = "linear"
    lossless: str = "packed"
    vel_chunk_size: int = 0
    limit: int | None = None
    sort: bool = False
    force: bool = False

    @property
    def sort_by_id(self) -> bool:
        """Sorting by id counts only where no codec has an order of its own."""
        return self.sort and self.pos_codec not in TRIPLET_CODECS

    def checked(self) -> Settings:
        check_codec_pair(self.pos_codec, self.vel_codec)
        if self.lossless not in LOSSLESS:
            raise ParticleError(f"lossless codecs are {', '.join(LOSSLESS)}, not {self.lossless!r}")
        if self.position_scale not in SCALES:
            raise ParticleError(f"scale modes are {', '.join(SCALES)}, not {self.position_scale!r}")
        for name in _NUMBERS:
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise ParticleError(f"{name} must be a number or null, not {value!r}")
            if value is not None and not value >= 0:
                raise ParticleError(f"{name} must not be negative")
        for a, b in (("pos_abs_eb", "pos_rel_eb"), ("vel_abs_eb", "vel_rel_eb"), ("abs_eb", "rel_eb")):
            if getattr(self, a) is not None and getattr(self, b) is not None:
                raise ParticleError(f"{a} and {b} cannot both be set")
        if isinstance(self.vel_chunk_size, bool) or not isinstance(self.vel_chunk_size, int) or self.vel_chunk_size < 0:
            raise ParticleError("vel_chunk_size must be a whole number of at least 0")
        if self.vel_chunk_size:
            check_options(self.vel_chunk_size)
            if self.vel_codec not in TRIPLET_CODECS:
                raise ParticleError(f"chunks need a velocity codec of {', '.join(TRIPLET_CODECS)}")
        if self.limit is not None and self.limit <= 0:
            raise ParticleError("limit must be positive")
        return self


_NUMBERS = ("abs_eb", "rel_eb", "pos_abs_eb", "pos_rel_eb", "vel_abs_eb", "vel_rel_eb", "id_abs_eb", "position_scale_value")


def from_mapping(values: dict) -> Settings:
    """Settings over the defaults; unknown names are refused, numbers may be written as text."""
    known = {f.name for f in fields(Settings)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ParticleError(f"unknown options: {', '.join(unknown)}")
    clean = dict(values)
    for name in _NUMBERS:
        if isinstance(clean.get(name), str):
            try:
                clean[name] = float(clean[name])
            except ValueError:
                raise ParticleError(f"{name} must be a number, not {clean[name]!r}") from None
    return replace(Settings(), **clean).checked()


def load(path: str) -> dict:
    """A JSON object, or ``name: value`` lines, of options; those of a nested section count as well."""
    with open(path) as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        found = json.loads(text)
        return {k: v for name, value in found.items() for k, v in (value.items() if isinstance(value, dict) else [(name, value)])}
    out = {}
    lines = [x for line in text.splitlines() if (x := line.split("#")[0].rstrip())]
    indents = [len(x) - len(x.lstrip()) for x in lines]
    for k, line in enumerate(lines):
        line = line.strip()
        if line.endswith(":") and indents[k + 1 : k + 2] > indents[k : k + 1]:
            continue  # the name of a section
        if line:
            name, _, value = line.partition(":")
            value = value.strip()
            try:
                out[name.strip()] = json.loads(value) if value else None
            except json.JSONDecodeError:
                out[name.strip()] = value.strip("'\"")
    return out
