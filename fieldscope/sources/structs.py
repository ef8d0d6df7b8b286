"""Little-endian layouts of the built-in structs, as text in the format of the struct module, and their decoding."""

from __future__ import annotations

import math
import struct

#: Name -> (format, fields). Suffix _rad yields a derived value in degrees.
LAYOUTS = {
    "Pose2d": ("<3d", "x y rotation_rad"),
    "Transform2d": ("<3d", "x y rotation_rad"),
    "Pose3d": ("<7d", "x y z qw qx qy qz"),
    "Transform3d": ("<7d", "x y z qw qx qy qz"),
    "Translation2d": ("<2d", "x y"),
    "Translation3d": ("<3d", "x y z"),
    "Rotation2d": ("<d", "radians"),
    "Rotation3d": ("<4d", "qw qx qy qz"),
    "Twist2d": ("<3d", "dx dy dtheta"),
    "Twist3d": ("<6d", "dx dy dz rx ry rz"),
    "ChassisSpeeds": ("<3d", "vx_mps vy_mps omega_radps"),
    "SwerveModuleState": ("<2d", "speed_mps angle_rad"),
    "SwerveModulePosition": ("<2d", "distance_m angle_rad"),
    "TargetObservation": ("<4dfi", "yaw_rad pitch_rad skew_rad area confidence objectID"),
    "PoseObservation": ("<9didi", "timestamp pose_x pose_y pose_z pose_qw pose_qx pose_qy pose_qz ambiguity tagCount averageTagDistance type"),
    "SwerveSample": ("<18d", "timestamp x y heading vx vy omega ax ay alpha moduleForcesX_0 moduleForcesX_1 moduleForcesX_2 moduleForcesX_3 moduleForcesY_0 moduleForcesY_1 moduleForcesY_2 moduleForcesY_3"),
}
#: Fields that number a name.
NAMED = {"PoseObservation": ("type", ("MEGATAG_1", "MEGATAG_2", "PHOTONVISION"))}
OWN: dict[str, tuple[str, str]] = {}


def register(name: str, layout: str, fields: str) -> None:
    if name in LAYOUTS or name in OWN:
        raise ValueError(f"struct {name} is already known")
    OWN[name] = (layout, fields)


def decode(name: str, payload: bytes) -> dict[str, float] | None:
    """Fields of one struct; None for an unknown name or too short a payload."""
    layout, fields = (LAYOUTS | OWN).get(name, (None, ""))
    if layout is None or len(payload) < struct.calcsize(layout):
        return None
    out = dict(zip(fields.split(), map(float, struct.unpack_from(layout, payload)), strict=True))
    for k, v in list(out.items()):
        if k.endswith("_rad"):
            out[k[:-4] + "_deg"] = math.degrees(v)
        elif k in ("radians", "heading"):
            out["degrees" if k == "radians" else "heading_deg"] = math.degrees(v)
    return out


def text_of(name: str, payload: bytes) -> str | None:
    """What numbers cannot say of a struct: that its payload is too short, or the name that a field numbers. None for all others."""
    layout = (LAYOUTS | OWN).get(name, (None,))[0]
    if layout is None:
        return None
    if len(payload) < struct.calcsize(layout):
        return f"insufficient data for {name}"
    if name in NAMED:
        field, names = NAMED[name]
        n = int(decode(name, payload)[field])
        return names[n] if 0 <= n < len(names) else f"UNKNOWN({n})"
    return None


def decode_array(name: str, payload: bytes) -> list[dict[str, float]] | None:
    layout = (LAYOUTS | OWN).get(name, (None,))[0]
    if layout is None:
        return None
    n = struct.calcsize(layout)
    return [decode(name, payload[i : i + n]) for i in range(0, len(payload) - n + 1, n)]


def listing(spark):
    """name, size (bytes), fields of every known struct."""
    rows = [(n, struct.calcsize(f), fields.split()) for n, (f, fields) in sorted((LAYOUTS | OWN).items())]
    return spark.createDataFrame(rows, "name string, size int, fields array<string>")
