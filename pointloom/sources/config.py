"""Driver-side settings: YAML-like mappings with defaults, required keys and a fallback list of paths."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass
class DecoderSettings:
    """Settings of one sensor source; unknown keys are an error."""

    sensor_type: str = ""
    min_distance: float = 0.2
    max_distance: float = 200.0
    start_angle: float = 0.0
    end_angle: float = 360.0
    dense_points: bool = False
    wait_for_info: bool = True
    use_sensor_clock: bool = False
    first_point_stamp: bool = False
    split_mode: int = 1
    split_blocks: int = 1
    transform: dict = field(default_factory=dict)

    @classmethod
    def of(cls, settings: dict) -> DecoderSettings:
        known = {f.name for f in fields(cls)}
        extra = set(settings) - known
        if extra:
            raise KeyError(f"unknown settings: {sorted(extra)}")
        return cls(**{k: v for k, v in settings.items() if v is not None})


def required(settings: dict, key: str):
    """The value of a key that must be there."""
    if settings.get(key) is None:
        raise KeyError(f"{key} is missing")
    return settings[key]


def as_list(value) -> list:
    """A scalar counts as a list of one, null as an empty one."""
    return [] if value is None else list(value) if isinstance(value, list | tuple) else [value]


def first_existing(paths: list[str]) -> str:
    for p in paths:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_settings(path: str) -> dict:
    """A YAML file as a mapping; an empty file gives an empty one."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def write_calibration(path: str, rotation: list[float], translation: list[float], rms: float, per_pose: dict[str, float] | None = None) -> None:
    """The 4×4 transform with its parts, Euler angles (degrees), error and, if given, the errors of single poses."""
    import math

    import yaml

    r = [list(map(float, rotation[3 * k : 3 * k + 3])) for k in range(3)]
    t = list(map(float, translation))
    lock = math.hypot(r[0][0], r[1][0]) < 1e-6
    angles = [math.atan2(-r[1][2], r[1][1]) if lock else math.atan2(r[2][1], r[2][2]), math.atan2(-r[2][0], math.hypot(r[0][0], r[1][0])), 0.0 if lock else math.atan2(r[1][0], r[0][0])]
    out = {"transform": [[*row, x] for row, x in zip(r, t, strict=True)] + [[0.0, 0.0, 0.0, 1.0]], "translation": t, "euler_deg": [math.degrees(a) for a in angles], "rms": float(rms)}
    if per_pose is not None:
        out |= {"num_poses": len(per_pose), "per_pose_rms": {str(k): float(v) for k, v in per_pose.items()}}
    with open(path, "w") as f:
        yaml.safe_dump(out, f, sort_keys=False)
