"""Numeric kernels over trajectories: smoothing derivatives, comfort, tracking, following. Plain NumPy on arrays of
shape (proposals, steps, ...), and a wrapper that runs them by scene with applyInPandas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Places of a simulated state. Fixed values.
X, Y, HEADING, VX, VY, AX, AY, STEER, STEER_RATE, YAW_RATE, YAW_ACC = range(11)

#: Comfort bounds (low, high). Fixed values.
LON_ACCELERATION = (-4.05, 2.40)
LAT_ACCELERATION = (-4.89, 4.89)
JERK = (-8.37, 8.37)
LON_JERK = (-4.13, 4.13)
YAW_ACCELERATION = (-1.93, 1.93)
YAW_RATE_BOUND = (-0.95, 0.95)
#: Largest root mean square changes between two frames: acceleration, jerk, yaw rate, yaw acceleration. Fixed values.
FRAME_CHANGES = (0.7, 0.5, 0.1, 0.1)


def smoothing_filter(window: int, order: int, derivative: int = 0, step: float = 1.0, at: float | None = None) -> np.ndarray:
    """Weights that give a derivative of the least-squares polynomial of a window at a place in it (the middle, which lies
    between two samples of an even window)."""
    place = (window - 1) / 2 if at is None else at
    basis = np.vander(np.arange(window) - place, order + 1, increasing=True)
    factorial = float(np.prod(np.arange(1, derivative + 1))) if derivative else 1.0
    return np.linalg.pinv(basis)[derivative] * factorial / step**derivative


def smoothed(values: np.ndarray, window: int, order: int, derivative: int = 0, step: float = 1.0) -> np.ndarray:
    """Polynomial smoothing or derivative along the last axis; both ends use the polynomial of the outermost window.

    A window is cut to the number of values; it has to be longer than the order. An even window around a value reaches
    one value further ahead than back, and its polynomial is taken at its middle, half a step ahead.
    """
    n = values.shape[-1]
    window = min(window, n)
    if order >= window:
        raise ValueError(f"{n} values are too few for order {order}")
    half = window // 2
    out = np.empty(values.shape, float)
    middle = smoothing_filter(window, order, derivative, step)
    for i in range(n):
        if i < half or i >= n - half:
            low = 0 if i < half else n - window
            weights = smoothing_filter(window, order, derivative, step, i - low)
        else:
            low, weights = i - (window - 1) // 2, middle
        out[..., i] = values[..., low : low + window] @ weights
    return out


def unwrapped(angles: np.ndarray) -> np.ndarray:
    """Angles without jumps of whole turns along the last axis."""
    turns = np.rint(np.diff(angles, axis=-1) / (2 * np.pi))
    out = angles.astype(float).copy()
    out[..., 1:] -= 2 * np.pi * np.cumsum(turns, axis=-1)
    return out


def accelerations(states: np.ndarray, which: str, rear_to_center: float = 0.0) -> np.ndarray:
    """Smoothed acceleration, rounded to 8 places: longitudinal (x) or lateral (y) at the centre, or its magnitude at the
    rear axle."""
    if which == "magnitude":
        raw = np.hypot(states[..., AX], states[..., AY])
    else:
        raw = states[..., AX] - states[..., YAW_RATE] ** 2 * rear_to_center if which == "x" else states[..., AY] + states[..., YAW_ACC] * rear_to_center
    return np.round(smoothed(raw, 8, 2), 8)


def jerks(states: np.ndarray, which: str, step: float, rear_to_center: float = 0.0) -> np.ndarray:
    return np.round(smoothed(accelerations(states, which, rear_to_center), 15, 2, 1, step), 8)


def yaw_derivative(states: np.ndarray, step: float, derivative: int = 1, order: int = 2) -> np.ndarray:
    """Yaw rate or acceleration over windows of five headings, rounded to 8 places."""
    return np.round(smoothed(unwrapped(states[..., HEADING]), 5, order, derivative, step), 8)


def _inside(values: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
    return ((values > bounds[0]) & (values < bounds[1])).all(axis=-1)


def comfort(states: np.ndarray, step: float, rear_to_center: float = 0.0) -> np.ndarray:
    """Six flags for each proposal: longitudinal and lateral acceleration, jerk, longitudinal jerk, yaw acceleration, yaw rate."""
    checks = [
        _inside(accelerations(states, "x", rear_to_center), LON_ACCELERATION),
        _inside(accelerations(states, "y", rear_to_center), LAT_ACCELERATION),
        _inside(jerks(states, "magnitude", step, rear_to_center), JERK),
        _inside(jerks(states, "x", step, rear_to_center), LON_JERK),
        _inside(yaw_derivative(states, step, 2, order=3), YAW_ACCELERATION),
        _inside(yaw_derivative(states, step, 1), YAW_RATE_BOUND),
    ]
    return np.stack(checks, axis=-1)


def frame_to_frame_comfort(a: np.ndarray, b: np.ndarray, step: float, bounds: Sequence[float] = FRAME_CHANGES) -> np.ndarray:
    """Whether overlapping plans of two frames differ little in acceleration, jerk, yaw rate and yaw acceleration."""
    features = [lambda s: accelerations(s, "magnitude"), lambda s: jerks(s, "magnitude", step), lambda s: yaw_derivative(s, step, 1), lambda s: yaw_derivative(s, step, 2)]
    changes = [np.sqrt(np.mean((f(a) - f(b)) ** 2, axis=-1)) for f in features]
    return np.logical_and.reduce([c <= bound for c, bound in zip(changes, bounds)])


def overlap(current: np.ndarray, previous: np.ndarray, dt: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The common part of two plans that begin ``dt`` apart, which must be more than 0 and less than 0.55."""
    if not 0 < dt < 0.55:
        raise ValueError(f"frames {dt} s apart do not overlap")
    k = round(dt / step)
    return current[..., : current.shape[-2] - k, :], previous[..., k:, :]


def resampled(times: np.ndarray, values: np.ndarray, at: np.ndarray, angles: Sequence[int] = ()) -> np.ndarray:
    """Rows at other times, linear between neighbours and clipped to the range; angle columns turn the short way."""
    out = np.empty((len(at), values.shape[1]))
    for j in range(values.shape[1]):
        column = unwrapped(values[:, j]) if j in angles else values[:, j]
        out[:, j] = np.interp(at, times, column)
    return out


@dataclass(frozen=True)
class Bicycle:
    """Kinematic bicycle with first-order lag of acceleration and steering."""

    wheelbase: float = 3.089
    max_steer: float = np.pi / 3
    accel_lag: float = 0.2
    steer_lag: float = 0.05

    def step(self, states: np.ndarray, accel: np.ndarray, steer_rate: np.ndarray, dt: float) -> np.ndarray:
        """States one step later, given commanded acceleration and steering rate."""
        s = states.copy()
        ideal = dt * steer_rate + s[:, STEER]
        s[:, AX] += dt / (dt + self.accel_lag) * (accel - s[:, AX])
        rate = (dt / (dt + self.steer_lag) * (ideal - s[:, STEER])) / dt
        s[:, AY] = 0
        h, v = states[:, HEADING], states[:, VX]
        s[:, X] = states[:, X] + v * np.cos(h) * dt
        s[:, Y] = states[:, Y] + v * np.sin(h) * dt
        turn = v * np.tan(states[:, STEER]) / self.wheelbase
        s[:, HEADING] = np.arctan2(np.sin(h + turn * dt), np.cos(h + turn * dt))
        s[:, VX] = v + s[:, AX] * dt
        s[:, VY] = 0
        s[:, STEER] = np.clip(states[:, STEER] + rate * dt, -self.max_steer, self.max_steer)
        s[:, STEER_RATE] = rate
        s[:, YAW_RATE] = s[:, VX] * np.tan(s[:, STEER]) / self.wheelbase
        s[:, YAW_ACC] = (s[:, YAW_RATE] - states[:, YAW_RATE]) / dt
        return s


def velocity_profile(displacements: np.ndarray, headings: np.ndarray, dt: float, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Initial velocity and accelerations that explain displacements (n, m, 2) along headings (n, m), jerk penalised."""
    n, m = headings.shape
    along = displacements[..., 0] * np.cos(headings) + displacements[..., 1] * np.sin(headings)
    a = np.zeros((m, m))
    a[:, 0] = dt
    for i in range(1, m):
        a[i, 1 : i + 1] = dt * dt
    smooth = np.zeros((m, m))
    for i in range(2, m):
        smooth[i, i - 1], smooth[i, i] = -1, 1
    solve = np.linalg.pinv(a.T @ a + penalty * smooth.T @ smooth)
    x = along @ a @ solve.T
    return x[:, 0], x[:, 1:]


def curvature_profile(heading_changes: np.ndarray, velocities: np.ndarray, dt: float, penalty: float = 1e-2, prior: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Initial curvature and its rates that explain heading changes (n, m) at velocities (n, m)."""
    n, m = heading_changes.shape
    first, rates = np.empty(n), np.empty((n, m - 1))
    for k in range(n):
        a = np.tril(np.ones((m, m))) * dt
        a[:, 0] = 1
        a = a * (velocities[k][:, None] * dt)
        weight = np.diag([prior, *[penalty] * (m - 1)])
        x = np.linalg.pinv(a.T @ a + weight) @ a.T @ heading_changes[k]
        first[k], rates[k] = x[0], x[1:]
    return first, rates


def following_acceleration(velocity, gap, lead_velocity, target, min_gap: float = 1.0, headway: float = 1.5, accel: float = 1.5, decel: float = 3.0, exponent: float = 10.0):
    """Acceleration of the intelligent driver model."""
    desired = min_gap + velocity * headway + velocity * (velocity - lead_velocity) / (2 * np.sqrt(accel * decel))
    return accel * (1 - (velocity / np.maximum(target, 1e-6)) ** exponent - (np.maximum(desired, 0) / np.maximum(gap, 1e-6)) ** 2)


def follow(progress: float, velocity: float, lead_progress: np.ndarray, lead_velocity: np.ndarray, target: float, dt: float, **options) -> np.ndarray:
    """(progress, velocity) at each step of an Euler rollout behind a leading object; speed is never negative."""
    out = np.empty((len(lead_progress), 2))
    for i, (p, v) in enumerate(zip(lead_progress, lead_velocity)):
        a = following_acceleration(velocity, p - progress, v, target, **options)
        progress, velocity = progress + velocity * dt, max(0.0, velocity + float(a) * dt)
        out[i] = progress, velocity
    return out


def one_step_acceleration(velocity: np.ndarray, reference: np.ndarray, horizon: float, q: float = 10.0, r: float = 1.0) -> np.ndarray:
    """Acceleration of the one-step quadratic regulator that leads a velocity to its reference over a horizon."""
    return -(q * horizon * (velocity - reference)) / (q * horizon * horizon + r)


def lateral_state(states: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Speeds of states, and their lateral, heading and steering error seen from the reference's pose."""
    dx, dy = states[:, X] - reference[:, X], states[:, Y] - reference[:, Y]
    heading = reference[:, HEADING]
    turn = states[:, HEADING] - heading
    errors = [dy * np.cos(heading) - dx * np.sin(heading), np.arctan2(np.sin(turn), np.cos(turn)), states[:, STEER]]
    return states[:, VX], np.stack(errors, axis=-1)


def looked_ahead(velocities: np.ndarray, curvatures: np.ndarray, at: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """The reference velocity a horizon ahead, and the curvatures up to it; the last ones stand for what lies beyond."""
    last = velocities.shape[1] - 1
    return velocities[:, min(at + horizon, last)], curvatures[:, np.minimum(np.arange(at, at + horizon), last)]


def stopping_command(velocity: np.ndarray, reference: np.ndarray, gain: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Acceleration in proportion to the velocity error, and no steering, for vehicles that are about to stand."""
    return gain * (reference - velocity), np.zeros_like(velocity)


def at_fault(ego_speed: float, track_speed: float, track_in_front: bool, track_behind: bool, stopped: float = 5e-2) -> str:
    """Kind of a collision, decided in order: stopped ego, stopped track, rear, front, lateral."""
    if ego_speed <= stopped:
        return "stopped_ego"
    if track_speed <= stopped:
        return "stopped_track"
    if track_behind:
        return "active_rear"
    return "active_front" if track_in_front else "active_lateral"


def step_score(total: float, low: float = 2.0, high: float = 6.0) -> float:
    """1 up to low, 0.5 up to high, 0 beyond: driving against traffic."""
    return 1.0 if total < low else 0.5 if total < high else 0.0


def by_scene(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel over all rows of a scene at once; a scene is a few proposals by nature."""
    return df.groupBy(key).applyInPandas(f, schema)


def _alike(lengths: pd.Series) -> list[list[int]]:
    """Positions of the rows of each length."""
    return [np.flatnonzero(lengths.to_numpy() == n).tolist() for n in sorted(lengths.unique())]


def comfort_by_proposal(df: DataFrame, key: str, proposal: str, states: str, step: float) -> DataFrame:
    """For rows with states (array of 11 numbers per step): all comfortable, and the six flags."""

    def run(frames):
        for frame in frames:
            flags = [None] * len(frame)
            for rows in _alike(frame[states].map(len)):  # trajectories of one length go through the kernel together
                block = np.stack([np.stack(s) for s in frame[states].iloc[rows]]).astype(float)
                for row, flag in zip(rows, comfort(block, step)):
                    flags[row] = flag.tolist()
            yield pd.DataFrame({key: frame[key], proposal: frame[proposal], "comfortable": [all(f) for f in flags], "flags": flags})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, proposal, states).mapInPandas(run, f"{key} {kinds[key]}, {proposal} {kinds[proposal]}, comfortable boolean, flags array<boolean>")


def simulated(df: DataFrame, key: str, proposal: str, start: str, commands: str, dt: float) -> DataFrame:
    """States of every step from a start state and commands (acceleration, steering rate)."""
    model = Bicycle()

    def run(frames):
        for frame in frames:
            outs = [None] * len(frame)
            for rows in _alike(frame[commands].map(len)):
                state = np.stack(frame[start].iloc[rows]).astype(float)
                orders = [np.stack(c) if len(c) else np.empty((0, 2)) for c in frame[commands].iloc[rows]]
                path = [state]
                for i in range(len(orders[0])):
                    state = model.step(state, np.array([o[i][0] for o in orders], float), np.array([o[i][1] for o in orders], float), dt)
                    path.append(state)
                for row, out in zip(rows, np.stack(path, axis=1)):
                    outs[row] = out.tolist()
            yield pd.DataFrame({key: frame[key], proposal: frame[proposal], "states": outs})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, proposal, start, commands).mapInPandas(run, f"{key} {kinds[key]}, {proposal} {kinds[proposal]}, states array<array<double>>")


def steering_rate(error: np.ndarray, speeds: np.ndarray, curvatures: np.ndarray, dt: float, wheelbase: float = 3.089, q: Sequence[float] = (1.0, 10.0, 0.0), r: float = 1.0) -> float:
    """The constant steering rate over a horizon that least leaves of lateral, heading and steering error.

    ``error`` is the state now; ``speeds`` and ``curvatures`` are those of the reference at each step. The error moves
    as A x + B u + g at each step, so after the horizon it is affine in the rate, and the quadratic cost has one least.
    """
    whole_a, whole_b, whole_g = np.eye(3), np.zeros(3), np.zeros(3)
    for v, k in zip(speeds, curvatures):
        a = np.array([[1, v * dt, 0], [0, 1, v * dt / wheelbase], [0, 0, 1]])
        whole_a, whole_b, whole_g = a @ whole_a, a @ whole_b + [0, 0, dt], a @ whole_g + [0, -v * k * dt, 0]
    weight = np.diag(q)
    return float(-(whole_b @ weight @ (whole_a @ error + whole_g)) / (whole_b @ weight @ whole_b + r))


def rail_traffic(lanes: Sequence[str], progress: np.ndarray, velocity: np.ndarray, ego: Sequence[tuple[str, float, float]], target: float, dt: float, length: float = 5.0, **options) -> np.ndarray:
    """Agents on lane rails, one after the other at each step: each follows the nearest object ahead in its lane, the
    vehicle (lane, progress, speed at each step) or another agent where that now is. Shape (steps, agents, 2)."""
    s, v = progress.astype(float).copy(), velocity.astype(float).copy()
    out = np.empty((len(ego), len(s), 2))
    for t, (ego_lane, ego_s, ego_v) in enumerate(ego):
        for i, lane in enumerate(lanes):
            ahead = [(s[j], v[j]) for j in range(len(s)) if j != i and lanes[j] == lane and s[j] > s[i]]
            if ego_lane == lane and ego_s > s[i]:
                ahead.append((ego_s, ego_v))
            lead_s, lead_v = min(ahead, default=(s[i] + 1e9, target))
            a = float(following_acceleration(v[i], lead_s - s[i] - length, lead_v, target, **options))
            s[i], v[i] = s[i] + v[i] * dt, max(0.0, v[i] + a * dt)
        out[t, :, 0], out[t, :, 1] = s, v
    return out
