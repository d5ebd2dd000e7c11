"""Poses, rotations and kinematics as column expressions over structs (x, y, heading) and arrays of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollgrid.functions.arrays import bound


def pose(x: Column, y: Column, heading: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), heading.cast("double").alias("heading"))


def wrapped(angle: Column) -> Column:
    """Into [-pi, pi] by atan2 of sine and cosine."""
    return F.atan2(F.sin(angle), F.cos(angle))


def wrapped_modulo(angle: Column) -> Column:
    """Into [-pi, pi): pi becomes -pi."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def wrapped_loop(angle: Column) -> Column:
    """Into [-pi, pi] by whole turns, keeping both ends as they are."""
    turns = F.when(angle > math.pi, F.ceil((angle - math.pi) / (2 * math.pi))).when(angle < -math.pi, -F.ceil((-angle - math.pi) / (2 * math.pi))).otherwise(F.lit(0))
    return angle - turns * (2 * math.pi)


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def to_relative(poses: Column, origin: Column) -> Column:
    """Global poses seen from an origin pose."""

    def one(p: Column) -> Column:
        x, y = rotated(p["x"] - origin["x"], p["y"] - origin["y"], -origin["heading"])
        return pose(x, y, wrapped(p["heading"] - origin["heading"]))

    return F.transform(poses, one)


def to_global(poses: Column, origin: Column) -> Column:
    def one(p: Column) -> Column:
        x, y = rotated(p["x"], p["y"], origin["heading"])
        return pose(origin["x"] + x, origin["y"] + y, wrapped(origin["heading"] + p["heading"]))

    return F.transform(poses, one)


def shifted(poses: Column, along: Column | float, across: Column | float = 0.0) -> Column:
    """Poses moved along their heading and its left normal."""
    along, across = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (along, across))
    return F.transform(poses, lambda p: pose(p["x"] + along * F.cos(p["heading"]) - across * F.sin(p["heading"]), p["y"] + along * F.sin(p["heading"]) + across * F.cos(p["heading"]), p["heading"]))


def composed(deltas: Column) -> Column:
    """Poses from a start at the origin and relative moves, each in the frame of the one before."""
    zero = F.struct(pose(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("at"), F.array().cast("array<struct<x:double,y:double,heading:double>>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        x, y = rotated(d["x"], d["y"], s["at"]["heading"])
        new = pose(s["at"]["x"] + x, s["at"]["y"] + y, wrapped(s["at"]["heading"] + d["heading"]))
        return F.struct(new.alias("at"), F.concat(s["out"], F.array(new)).alias("out"))

    return F.aggregate(deltas, zero, step, lambda s: s["out"])


def corners(p: Column, length: float, width: float, rear_to_center: float = 0.0) -> Column:
    """Front left, rear left, rear right and front right corners, and the centre, of a box at a pose."""
    cx, cy = p["x"] + rear_to_center * F.cos(p["heading"]), p["y"] + rear_to_center * F.sin(p["heading"])
    out = []
    for a, b in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5), (0.0, 0.0)):
        x, y = rotated(F.lit(a * length), F.lit(b * width), p["heading"])
        out.append(F.struct((cx + x).alias("x"), (cy + y).alias("y")))
    return F.array(*out)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring of (x, y), by crossing number; points on an edge may fall on either side."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda count, i: count
        + F.when(
            ((F.get(ring, i)["y"] > y) != (F.get(ring, F.pmod(i + 1, n))["y"] > y))
            & (x < (F.get(ring, F.pmod(i + 1, n))["x"] - F.get(ring, i)["x"]) * F.try_divide(y - F.get(ring, i)["y"], F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, i)["y"]) + F.get(ring, i)["x"]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    return (crossings % 2) == 1


def path_progress(points: Column) -> Column:
    """Cumulative length along points (x, y), from 0."""
    n = F.size(points)
    zero = F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("out"))

    def step(s: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        new = s["at"] + F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        return F.struct(new.alias("at"), F.concat(s["out"], F.array(new)).alias("out"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, step, lambda s: s["out"])


def mean_distance(a: Column, b: Column) -> Column:
    """Mean distance of two trajectories point by point; NULL where their lengths differ."""
    each = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2))))
    return F.when(F.size(a) == F.size(b), F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, d: s + d), F.size(a)))


def final_distance(a: Column, b: Column) -> Column:
    p, q = F.try_element_at(a, F.lit(-1)), F.try_element_at(b, F.lit(-1))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2))))


def shifted_velocity(vx: Column, vy: Column, rate: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Velocity of a point of a rigid body that is displaced from the reference point."""
    return vx - rate * dy, vy + rate * dx


def shifted_acceleration(ax: Column, ay: Column, rate: Column, acceleration: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    return ax - rate * rate * dx - acceleration * dy, ay - rate * rate * dy + acceleration * dx


def constant_speed(vx: Column, vy: Column, steps: int, interval: float) -> Column:
    """The poses of straight motion at constant velocity."""
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: pose(vx * i * interval, vy * i * interval, F.lit(0.0)))


def denormalised(poses: Column, mean: list[list[float]], std: list[list[float]]) -> Column:
    """array<array<double>> times std plus mean, element by element."""
    m, s = (F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in t]) for t in (mean, std))
    return F.zip_with(poses, F.arrays_zip(m, s), lambda p, ms: F.zip_with(p, F.arrays_zip(ms["0"], ms["1"]), lambda v, c: v * c["1"] + c["0"]))


def future(frames: Column, history: int, steps: int, column: str = "pose") -> Column:
    """Poses of the frames after the current one (the last of the history), seen from it."""
    now = F.element_at(frames, history)[column]
    return to_relative(F.transform(F.slice(frames, history + 1, steps), lambda f: f[column]), now)


def history(frames: Column, length: int, column: str = "pose") -> Column:
    """Poses of the history frames, seen from its last."""
    return to_relative(F.transform(F.slice(frames, 1, length), lambda f: f[column]), F.element_at(frames, length)[column])


def sampled_indices(iteration: int, horizon: float, samples: int, interval: float, past: bool = False) -> list[int]:
    """Frame numbers of evenly spaced samples up to a horizon after (or before, in order of time) an iteration."""
    step = int(round(horizon / interval / samples))
    if step < 1:
        raise ValueError("more samples than frames")
    offsets = [step * i for i in range(1, samples + 1)]
    return [iteration - o for o in reversed(offsets)] if past else [iteration + o for o in offsets]


def completed(poses: Column, steps: int, interval: float) -> Column:
    """Exactly ``steps`` poses: cut, or carried on with the last velocity and acceleration (and turning alike)."""
    n = F.size(poses)

    def at(k: int) -> Column:
        return F.try_element_at(poses, F.lit(-k))

    zero = F.lit(0.0)
    velocity = {c: F.when(n >= 2, (at(1)[c] - at(2)[c]) / interval).otherwise(zero) for c in ("x", "y")}
    before = {c: (at(2)[c] - at(3)[c]) / interval for c in ("x", "y")}
    accel = {c: F.when(n >= 3, (velocity[c] - before[c]) / interval).otherwise(zero) for c in ("x", "y")}
    omega = F.when(n >= 2, wrapped(at(1)["heading"] - at(2)["heading"]) / interval).otherwise(zero)
    omega_before = wrapped(at(2)["heading"] - at(3)["heading"]) / interval
    alpha = F.when(n >= 3, (omega - omega_before) / interval).otherwise(zero)

    def extended(i: Column) -> Column:
        t = i * interval
        x, y = (at(1)[c] + velocity[c] * t + 0.5 * accel[c] * t * t for c in ("x", "y"))
        return pose(x, y, wrapped(at(1)["heading"] + omega * t + 0.5 * alpha * t * t))

    more = F.when(n < steps, F.transform(F.sequence(F.lit(1), F.lit(steps) - n), extended)).otherwise(F.slice(poses, 1, 0))
    return F.slice(F.concat(poses, more), 1, steps)


def at_distance(points: Column, distance: Column, lengths: Column | None = None) -> Column:
    """The point (x, y) of a path at a distance from its start, clipped to the path; NaN counts as 0."""
    if lengths is None:
        return bound(path_progress(points), lambda d: at_distance(points, distance, d))
    want = F.when(F.isnan(distance), F.lit(0.0)).otherwise(distance)
    want = F.greatest(F.lit(0.0), F.least(want, F.element_at(lengths, -1)))
    i = F.greatest(F.size(F.filter(lengths, lambda d: d < want)), F.lit(1))
    a, b = F.get(points, i - 1), F.try_element_at(points, F.least(i + 1, F.size(points)))
    start = F.get(lengths, i - 1)
    share = F.coalesce(F.try_divide(want - start, F.get(lengths, F.least(i, F.size(lengths) - 1)) - start), F.lit(0.0))
    return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))


def projected(points: Column, x: Column, y: Column) -> Column:
    """Distance from the start of a path to its point nearest to (x, y)."""
    return bound(path_progress(points), lambda d: _projected(points, x, y, d))


def _projected(points: Column, x: Column, y: Column, lengths: Column) -> Column:
    n = F.size(points)

    def segment(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        px, py = a["x"] + share * dx - x, a["y"] + share * dy - y
        return F.struct((px * px + py * py).alias("d"), (F.get(lengths, i - 1) + share * (F.get(lengths, i) - F.get(lengths, i - 1))).alias("s"))

    return F.when(n > 1, F.array_min(F.transform(F.sequence(F.lit(1), n - 1), segment))["s"]).otherwise(F.lit(0.0))


def between_distances(points: Column, start: Column, stop: Column) -> Column:
    """The part of a path between two distances, with interpolated ends."""
    return bound(path_progress(points), lambda d: _between(points, start, stop, d))


def _between(points: Column, start: Column, stop: Column, lengths: Column) -> Column:
    inner = F.filter(F.transform(F.arrays_zip(points.alias("p"), lengths.alias("d")), lambda z: F.struct(z["d"].alias("d"), z["p"]["x"].alias("x"), z["p"]["y"].alias("y"))), lambda z: (z["d"] > start) & (z["d"] < stop))
    return F.concat(F.array(at_distance(points, start, lengths)), F.transform(inner, lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y"))), F.array(at_distance(points, stop, lengths)))


def tracks(names: Column, boxes: Column, velocities: Column, ids: Column) -> Column:
    """Parallel annotation arrays as one array of tracks: id, type, agent or static, pose and velocity."""
    moving = F.array(*[F.lit(t) for t in ("vehicle", "pedestrian", "bicycle")])
    z = F.arrays_zip(names.alias("n"), boxes.alias("b"), velocities.alias("v"), ids.alias("i"))
    return F.transform(
        z,
        lambda t: F.struct(
            t["i"].alias("id"), t["n"].alias("type"), F.array_contains(moving, t["n"]).alias("agent"), t["b"][0].alias("x"), t["b"][1].alias("y"), t["b"][6].alias("heading"), t["b"][3].alias("length"), t["b"][4].alias("width"), t["v"][0].alias("vx"), t["v"][1].alias("vy"),
        ),
    )


def to_pixel(x: Column, y: Column, per_metre: float, width: int, height: int) -> tuple[Column, Column]:
    """Grid place of a point, fractions cut towards zero."""
    return (x * per_metre + width / 2).cast("int"), (y * per_metre + height / 2).cast("int")
