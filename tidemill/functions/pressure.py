"""Queue pressure: scores, levels and delays of back-pressure, as expressions over metrics columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

# Weights of queue, throughput and performance, thresholds of levels, and delays in the middle of a level's range.
WEIGHTS = (0.4, 0.3, 0.3)
LEVELS = (50, 70, 85)
BASE_DELAYS = {"normal": 0.15, "warning": 0.65, "danger": 1.75, "critical": 3.75}


def score(usage: Column, rate_difference: Column, timeout_rate: Column, success_rate: Column) -> Column:
    performance = (1 - timeout_rate) * 50 + success_rate * 50
    return usage * 100 * WEIGHTS[0] + F.least(F.abs(rate_difference) * 10, F.lit(100.0)) * WEIGHTS[1] + performance * WEIGHTS[2]


def level(value: Column) -> Column:
    return F.when(value >= LEVELS[2], "critical").when(value >= LEVELS[1], "danger").when(value >= LEVELS[0], "warning").otherwise("normal")


def fixed_delay(utilization: Column, base: float = 0.1, most: float = 5.0, threshold: float = 0.8) -> Column:
    """No delay below the threshold, then growing from base, four times base from 0.90, the most from 0.95."""
    room = 0.95 - threshold
    ratio = (utilization - threshold) / room if room > 1e-9 else F.lit(1.0)
    return F.when(utilization >= 0.95, most).when(utilization >= 0.90, base * 4).when(utilization >= threshold, base * (1 + ratio * 3)).otherwise(0.0)


def pressure_level(utilization: Column, warning: float = 0.7, critical: float = 0.9) -> Column:
    return F.when(utilization >= 1.0, "full").when(utilization >= critical, "critical").when(utilization >= warning, "warning").otherwise("normal")


def composite_delay(*delays: Column) -> Column:
    """The longest that several strategies ask for."""
    return F.greatest(*delays) if len(delays) > 1 else delays[0]


def adaptive_delay(base: Column, recorded: Column, order: WindowSpec, most: float = 5.0) -> Column:
    """The delay asked for now, up to twice as long where the last ten recorded ones were longer on average. No delay stays none."""
    recent = F.avg(recorded).over(order.rowsBetween(-10, -1))
    return F.when((recent > base) & (base > 0), F.least(base * F.least(recent / base, F.lit(2.0)), F.lit(most))).otherwise(base)


def adjustment(usage: Column, rate_difference: Column, timeout_rate: Column, success_rate: Column) -> Column:
    return (
        F.when(usage > 0.9, 1.5).when(usage > 0.8, 1.2).otherwise(1.0)
        * F.when(rate_difference > 50, 1.5).when(rate_difference > 20, 1.2).otherwise(1.0)
        * F.when(timeout_rate > 0.3, 1.3).when(timeout_rate > 0.2, 1.1).otherwise(1.0)
        * F.when(success_rate < 0.7, 1.4).when(success_rate < 0.85, 1.1).otherwise(1.0)
    )


def prediction(growth: Column) -> Column:
    return F.when(growth > 100, 0.5).when(growth > 50, 0.3).when(growth > 20, 0.1).otherwise(0.0)


def raw_delay(level_: Column, adjusted: Column, predicted: Column, most: float = 5.0) -> Column:
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in BASE_DELAYS.items() for x in pair)), level_), F.lit(BASE_DELAYS["normal"]))
    return F.greatest(F.lit(0.0), F.least(base * adjusted + predicted, F.lit(most)))


def smooth_delay(delay: Column, order: WindowSpec, step: float = 0.5) -> Column:
    """At most step away from the raw delay before."""
    before = F.lag(delay).over(order)
    return F.when(before.isNull(), delay).otherwise(F.greatest(F.least(delay, before + step), before - step))


def growth_rate(size: Column, seconds: Column, order: WindowSpec, samples: int = 10) -> Column:
    """Growth a second over the last samples; 0 with fewer than two or no time between them."""
    frame = order.rowsBetween(-(samples - 1), W.currentRow)
    took = F.last(seconds).over(frame) - F.first(seconds).over(frame)
    return F.when(took > 0, (F.last(size).over(frame) - F.first(size).over(frame)) / took).otherwise(0.0)


def concurrency(mean_seconds: Column, now: Column, base: int) -> Column:
    """Five more for fast answers up to three times base, five fewer for slow ones down to a third."""
    return F.when(mean_seconds < 0.2, F.least(now + 5, F.lit(base * 3))).when(mean_seconds > 1.0, F.greatest(now - 5, F.lit(max(1, base // 3)))).otherwise(now)
