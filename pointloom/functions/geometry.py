"""Column expressions for points, planes, projections, colours and rotations. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.80665


def _c(x: str | Column | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def finite(*cols: str | Column) -> Column:
    """All present and neither NaN nor infinite."""
    out = F.lit(True)
    for x in cols:
        v = _c(x).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def norm(x, y, z) -> Column:
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def inside_box(lo: Sequence[float], hi: Sequence[float], xyz: Sequence = ("x", "y", "z")) -> Column:
    """Bounds belong to the box; NaN lies in no box."""
    out = F.lit(True)
    for c, a, b in zip(xyz, lo, hi, strict=True):
        out = out & ~F.isnan(_c(c)) & _c(c).between(a, b)
    return out


def range_gate(near, far, xyz: Sequence = ("x", "y", "z")) -> Column:
    r = norm(*xyz)
    return ~F.isnan(r) & (r >= _c(near)) & (r <= _c(far))


def azimuth_gate(start: float, end: float, x="x", y="y") -> Column:
    """Azimuth in degrees [0, 360) from ``start`` to ``end``, through zero where start > end."""
    a = F.pmod(F.degrees(F.atan2(_c(y), _c(x))), F.lit(360.0))
    return a.between(start, end) if start <= end else (a >= start) | (a <= end)


def rigid(t: Sequence[Sequence[float | Column]], xyz: Sequence = ("x", "y", "z")) -> list[Column]:
    """R p + t for a 3×4 or 4×4 matrix of numbers or columns."""
    p = [_c(c) for c in xyz]
    return [_c(r[0]) * p[0] + _c(r[1]) * p[1] + _c(r[2]) * p[2] + _c(r[3]) for r in t[:3]]


def fisheye(xyz: Sequence, fx: float, fy: float, cx: float, cy: float, k: Sequence[float]) -> tuple[Column, Column]:
    """Equidistant fisheye with four coefficients; on the axis the principal point."""
    x, y, z = (_c(c) for c in xyz)
    r = F.sqrt(x * x + y * y)
    th = F.atan2(r, z)
    t2 = th * th
    d = th * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = F.when(r > 1e-12, d / F.greatest(r, F.lit(1e-12))).otherwise(0.0)
    return fx * scale * x + cx, fy * scale * y + cy


def pinhole(xyz: Sequence, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    x, y, z = (_c(c) for c in xyz)
    safe = F.when(z != 0, z)
    return fx * x / safe + cx, fy * y / safe + cy


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(_c(r).cast("int"), 16).bitwiseOR(F.shiftleft(_c(g).cast("int"), 8)).bitwiseOR(_c(b).cast("int"))


def jet(v: Column, lo: Column, hi: Column, eps: float) -> list[Column]:
    """r, g, b in [0, 1] of a value between two bounds."""
    s = F.least(F.greatest((v - lo) / (hi - lo + eps), F.lit(0.0)), F.lit(1.0))
    return [F.least(F.greatest(1.5 - F.abs(4 * s - k), F.lit(0.0)), F.lit(1.0)) for k in (3, 2, 1)]


def rainbow(i: Column, n: Column) -> list[Column]:
    """Hue i / n at full saturation, by sixths of the circle."""
    h = 6.0 * i / n
    f = h - F.floor(h)
    s = F.floor(h).cast("int") % 6
    pick = lambda *v: F.element_at(F.array(*[_c(x) for x in v]), s + 1)
    return [pick(1.0, 1 - f, 0.0, 0.0, f, 1.0), pick(f, 1.0, 1.0, 1 - f, 0.0, 0.0), pick(0.0, 0.0, f, 1.0, 1.0, 1 - f)]


def plane_distance(a, b, c, d, xyz: Sequence = ("x", "y", "z")) -> Column:
    """Signed distance to ax + by + cz + d = 0."""
    x, y, z = (_c(v) for v in xyz)
    return (_c(a) * x + _c(b) * y + _c(c) * z + _c(d)) / norm(_c(a), _c(b), _c(c))


def dominant_axis(a, b, c) -> Column:
    """'+x', '-z' …: axis of the largest component, of equal ones the first."""
    a, b, c = _c(a), _c(b), _c(c)
    m = F.greatest(F.abs(a), F.abs(b), F.abs(c))
    sign = lambda v, n: F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("-")), F.lit(n))
    return F.when(F.abs(a) == m, sign(a, "x")).when(F.abs(b) == m, sign(b, "y")).otherwise(sign(c, "z"))


def nearest_plane(planes: Sequence[tuple], xyz: Sequence = ("x", "y", "z")) -> Column:
    """struct(d, i): smallest |distance| and the number of its plane; of equal distances the first plane."""
    each = [F.struct(F.abs(plane_distance(*p[:4], xyz=xyz)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(planes)]
    return F.array_min(F.array(*each))


def euler_xyz(r: Sequence[Sequence[Column]]) -> list[Column]:
    """Degrees about x, y, z of a rotation matrix; at gimbal lock z is 0."""
    sy = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    lock = sy < 1e-6
    return [
        F.degrees(F.when(lock, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))),
        F.degrees(F.atan2(-r[2][0], sy)),
        F.degrees(F.when(lock, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))),
    ]


def stamp_split(ns: Column) -> tuple[Column, Column]:
    """Whole seconds and nanoseconds in [0, 1e9) of integer nanoseconds, negative ones too."""
    nano = F.pmod(ns, F.lit(1_000_000_000))
    sec = ((ns - nano) / F.lit(1_000_000_000)).cast("bigint")
    return sec, nano


def det3(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: Sequence[Sequence[Column]], y: Sequence[Column], eps: float = 1e-12) -> list[Column]:
    """Cramer's rule; null where the matrix is (nearly) singular."""
    d = det3(m)
    safe = F.when(F.abs(d) > eps, d)
    out = []
    for k in range(3):
        mk = [[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
        out.append(det3(mk) / safe)
    return out


def rpy(x, y, z, roll, pitch, yaw) -> list[list[Column]]:
    """3×4 matrix of a pose: turned about x by roll, then y by pitch, then z by yaw (radians), then moved."""
    (sr, cr), (sp, cp), (sy, cy) = [(F.sin(_c(a)), F.cos(_c(a))) for a in (roll, pitch, yaw)]
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, _c(x)],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, _c(y)],
        [-sp, cp * sr, cp * cr, _c(z)],
    ]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def plane_line(p: Sequence, q: Sequence) -> tuple[list[Column], list[Column]]:
    """(point nearest the origin, unit direction) of the line in which two planes (a, b, c, d) meet; nulls where they are
    parallel."""
    m, n = [_c(v) for v in p[:3]], [_c(v) for v in q[:3]]
    along = _cross(m, n)
    size = norm(*along)
    safe = F.when(size >= 1e-6, size)
    mixed = [_c(q[3]) * a - _c(p[3]) * b for a, b in zip(m, n, strict=True)]
    return [v / (safe * safe) for v in _cross(mixed, along)], [v / safe for v in along]


def on_line(xyz: Sequence, at: Sequence, along: Sequence) -> tuple[list[Column], Column]:
    """(foot of the perpendicular on a line with unit direction, distance to it)."""
    x, at, along = [_c(v) for v in xyz], [_c(v) for v in at], [_c(v) for v in along]
    t = sum((a - b) * c for a, b, c in zip(x, at, along, strict=True))
    foot = [b + t * c for b, c in zip(at, along, strict=True)]
    return foot, norm(*[a - b for a, b in zip(x, foot, strict=True)])


def snapped(xyz: Sequence, lines: Column, near: float) -> Column:
    """struct(x, y, z): the point moved onto each line (array of p, u: structs of x, y, z) in turn that is nearer than ``near``."""

    def move(acc: Column, line: Column) -> Column:
        foot, far = on_line([acc[c] for c in "xyz"], [line["p"][c] for c in "xyz"], [line["u"][c] for c in "xyz"])
        hit = F.coalesce(far < near, F.lit(False))
        return F.struct(*[F.when(hit, f).otherwise(acc[c]).alias(c) for f, c in zip(foot, "xyz", strict=True)])

    return F.aggregate(lines, F.struct(*[_c(v).cast("double").alias(c) for v, c in zip(xyz, "xyz", strict=True)]), move)


def colour_or(colours: Sequence, fallback: Sequence[float]) -> list[Column]:
    """Stored r, g, b where all three are there, else the constant ones."""
    have = _c(colours[0]).isNotNull() & _c(colours[1]).isNotNull() & _c(colours[2]).isNotNull()
    return [F.when(have, _c(c)).otherwise(F.lit(float(f))) for c, f in zip(colours, fallback, strict=True)]


def known_or(name, known: Sequence[str], default: str) -> tuple[Column, Column]:
    """(name if it is one of ``known`` in any letter case, else ``default``; whether the default was taken)."""
    clean = F.upper(F.trim(_c(name)))
    ok = F.coalesce(clean.isin([k.upper() for k in known]), F.lit(False))
    return F.when(ok, clean).otherwise(F.lit(default)), ~ok


def channel(name, choices: dict[str, str]) -> Column:
    """The column that ``name`` chooses; null for a null name, an error for one that is no channel."""
    out = F.when(_c(name).isNull(), F.lit(None).cast("double"))
    for k, v in choices.items():
        out = out.when(_c(name) == k, F.col(v))
    return out.otherwise(F.raise_error(F.concat(F.lit("no channel "), _c(name))).cast("double"))
