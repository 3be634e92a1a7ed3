"""Trip formulas as Column expressions: speeds, scores, rewards, turns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..spec import NEAREST_MODE_ORDER


def velocity(distance: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.try_divide(distance.cast("double"), seconds.cast("double"))).otherwise(F.lit(0.0))


def true_speed(distance: Column, minutes: Column) -> Column:
    """km a minute, of the observed trip."""
    return distance / (minutes + F.lit(0.001))


def normal_pdf(v: Column, mean: Column, std: Column) -> Column:
    return F.exp(F.lit(-0.5) * F.pow((v - mean) / std, F.lit(2.0))) / (std * F.lit(math.sqrt(2 * math.pi)))


def z_score(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / std


def reward_base(match: Column, t_lower: Column, t_upper: Column) -> Column:
    return (match - 1) * F.abs(t_lower - t_upper)


def reward_velocity(match: Column, expected: Column, observed: Column) -> Column:
    """Null where both speeds are equal."""
    return F.try_divide(match, F.abs(expected - observed))


def reward_zscore(match: Column, observed: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(match, F.abs(observed * 60 - mean)) * std


def reward_pdf(match: Column, observed: Column, mean: Column, std: Column) -> Column:
    return match * normal_pdf(observed * 60, mean, std)


def reward_penalty(z: Column, matched: Column, total: Column) -> Column:
    return -F.abs(z) * (F.lit(1.0) - matched / (total + F.lit(0.1)))


def nearest_mode(speed: Column, means: dict) -> Column:
    """The mode whose mean is nearest to a speed; the first in order wins a tie."""
    pairs = F.array(*[F.struct(F.abs(speed - F.lit(float(means[m]))).alias("d"), F.lit(k).alias("k"), F.lit(m).alias("mode")) for k, m in enumerate(NEAREST_MODE_ORDER)])
    return F.array_min(pairs)["mode"]


def upper_state(distance: Column, minutes: Column, support: list, rate_variant: bool = False) -> Column:
    """The trip's state: its speed, then the support of each mode."""
    speed = F.try_divide(distance, (minutes + F.lit(0.0001)) * 60) if rate_variant else true_speed(distance, minutes)
    return F.array(speed.cast("double"), *[s.cast("double") for s in support])


def turn_cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Inner product of two vectors over the root of their squared lengths' product plus one."""
    return (ax * bx + ay * by) / (F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)) + 1)


def step_reward(on_road: Column, remaining: Column, start: Column, hold: float = 0.0, normalised: bool = False) -> Column:
    """One step's reward: road bonus, penalty while away from the goal, bonus at it. normalised: both scaled by the distance left
    over the distance at the start."""
    share = F.try_divide(remaining, start) if normalised else F.lit(1.0)
    bonus = F.when(on_road, F.lit(0.65) * share).otherwise(F.lit(0.0))
    return bonus - F.when(remaining > hold, share).otherwise(F.lit(0.0)) + F.when(remaining <= hold, F.lit(2.0)).otherwise(F.lit(0.0))
