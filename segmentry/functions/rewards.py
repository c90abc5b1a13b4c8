"""Reward and success formulas on state columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmentry.functions.vectors import distance

SIGMOIDS = ("gaussian", "hyperbolic", "long_tail", "reciprocal", "cosine", "linear", "quadratic", "tanh_squared")
#: These reach 0, so their value at the margin may be 0.
REACH_ZERO = ("cosine", "linear", "quadratic")


def pole_reward(theta: Column) -> Column:
    return -F.abs(F.degrees(theta))


def pole_success(theta: Column) -> Column:
    return F.abs(F.degrees(theta)) < 5


def rope_reward(d: Column, length: float) -> Column:
    return F.least(d, F.lit(1.1 * length))


def rope_success(d: Column, length: float) -> Column:
    return rope_reward(d, length) >= 0.95 * length


def water_reward(out: Column, total: Column, x: Column, target: Column, water: float = 1.0, reach: float = 1.0) -> Column:
    return -(water * F.try_divide(out.cast("double"), total.cast("double"))) - reach * F.abs(target - x)


def water_success(reward: Column) -> Column:
    return reward > -0.36


def _decay(d: Column, at_margin: float, sigmoid: str) -> Column:
    """A fall from 1 at d = 0 to at_margin at d = 1; the scale is a number known here, not a column."""
    if sigmoid not in SIGMOIDS:
        raise ValueError(f"unknown sigmoid {sigmoid!r}")
    if not (0 < at_margin < 1 or at_margin == 0 and sigmoid in REACH_ZERO):
        raise ValueError(f"value at margin {at_margin} doesn't suit {sigmoid}")
    v = at_margin
    if sigmoid == "gaussian":
        return F.exp(d * d * math.log(v))
    if sigmoid == "hyperbolic":
        return 1 / F.cosh(d * math.acosh(1 / v))
    if sigmoid == "long_tail":
        return 1 / (1 + d * d * (1 / v - 1))
    if sigmoid == "reciprocal":
        return 1 / (1 + F.abs(d) * (1 / v - 1))
    if sigmoid == "tanh_squared":
        t = F.tanh(d * math.atanh(math.sqrt(1 - v)))
        return 1 - t * t
    scale = {"cosine": math.acos(2 * v - 1) / math.pi, "linear": 1 - v, "quadratic": math.sqrt(1 - v)}[sigmoid]
    s = d * scale
    inside = {"cosine": (1 + F.cos(s * math.pi)) / 2, "linear": 1 - s, "quadratic": 1 - s * s}[sigmoid]
    return F.when(F.abs(s) < 1, inside).otherwise(0.0)


def tolerance(x: Column, bounds: tuple[float, float] = (0.0, 0.0), margin: float = 0.0, sigmoid: str = "gaussian", value_at_margin: float = 0.1) -> Column:
    """1 inside the bounds, falling outside them to value_at_margin at the margin's distance, or to 0 at once without a margin."""
    low, high = bounds
    if low > high:
        raise ValueError("the lower bound is above the upper one")
    if margin < 0:
        raise ValueError("the margin is negative")
    outside = F.lit(0.0) if margin == 0 else _decay(F.when(x < low, low - x).otherwise(x - high) / margin, value_at_margin, sigmoid)
    return F.when((x >= low) & (x <= high), 1.0).otherwise(outside)


def inverse_tolerance(x: Column, bounds: tuple[float, float] = (0.0, 0.0), margin: float = 0.0, sigmoid: str = "linear") -> Column:
    return 1 - tolerance(x, bounds, margin, sigmoid, 0.0)


def hamacher(a: Column, b: Column) -> Column:
    """The Hamacher product of two numbers from 0 to 1; null outside them."""
    product = F.coalesce(F.try_divide(a * b, a + b - a * b), F.lit(0.0))
    return F.when(a.between(0, 1) & b.between(0, 1), product)


def rect_prism_tolerance(point: list[Column], zero: list[float], one: list[float]) -> Column:
    """Inside the prism between two corners the product of the shares of the way from zero to one; 1 outside it."""
    inside = F.lit(True)
    share = F.lit(1.0)
    for p, z, o in zip(point, zero, one):
        inside = inside & p.between(min(z, o), max(z, o))
        share = share * F.coalesce(F.try_divide(p - z, F.lit(float(o - z))), F.lit(1.0))
    return F.when(inside, share).otherwise(1.0)


def distance_reward(achieved: Column, goal: Column, threshold: float | None = None) -> Column:
    """The negative distance; with a threshold -1 beyond it and 0 within."""
    d = distance(achieved, goal)
    return -d if threshold is None else -F.when(d > threshold, 1.0).otherwise(0.0)


def goal_reached(achieved: Column, goal: Column, threshold: float) -> Column:
    """0 within the threshold, -1 beyond."""
    return F.when(distance(achieved, goal) < threshold, 0.0).otherwise(-1.0)


def quantise(pixels: Column, bits: int = 5) -> Column:
    """8-bit values as centres of 2**bits levels over [-0.5, 0.5)."""
    levels = 2**bits
    return F.transform(pixels, lambda p: F.floor(p / F.lit(2.0 ** (8 - bits))) / F.lit(float(levels)) - 0.5)


def dequantise(values: Column, bits: int = 5) -> Column:
    """Back to 8-bit values, at the lower edge of their levels."""
    levels = 2**bits
    return F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 0.5) * levels) * (2 ** (8 - bits)))).cast("int"))


def camera_matrix(angle: tuple[float, float, float], position: tuple[float, float, float]):
    """World to camera: a turn about x, one about y, a half turn of the picture, and the shift; 4 x 4, on the driver."""
    import numpy as np

    def turn(a: float, i: int, j: int):
        m = np.eye(4)
        m[i, i] = m[j, j] = math.cos(a)
        m[i, j], m[j, i] = -math.sin(a), math.sin(a)
        return m

    shift = np.eye(4)
    shift[:3, 3] = [-p for p in position]
    return turn(math.pi, 1, 2) @ turn(-angle[1], 1, 2) @ turn(-angle[0], 2, 0) @ shift


def unproject(u: Column, v: Column, depth: Column, height: int, width: int, matrix, fov: float = 90.0) -> list[Column]:
    """x, y, z of the world point of pixel (u, v) at a depth; matrix is world to camera."""
    import numpy as np

    focal = width / (2 * math.tan(math.radians(fov) / 2))
    inverse = np.linalg.inv(matrix)
    x, y = (u - width / 2) * depth / focal, (v - height / 2) * depth / focal
    return [float(r[0]) * x + float(r[1]) * y + float(r[2]) * depth + float(r[3]) for r in inverse[:3]]
