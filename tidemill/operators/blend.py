"""Blending of sources: round robin by weight, random draws by weight, schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrr_cycle(weights: dict[str, float]) -> list[str]:
    """One round of weighted round robin: the source with most weight left goes next, the first of equals; ceil(weight) picks each."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive, and there must be some")
    left, out = dict(weights), []
    while any(v > 0 for v in left.values()):
        best = max(left.values())
        name = next(k for k, v in left.items() if v == best)
        out.append(name)
        left[name] -= 1
    return out


def smooth_wrr_cycle(weights: dict[str, int]) -> list[str]:
    """One round in exact ratio of integer weights, spread evenly."""
    total, now, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for _ in range(total):
        now = {k: v + weights[k] for k, v in now.items()}
        name = max(now, key=lambda k: now[k])
        now[name] -= total
        out.append(name)
    return out


def at_cycle(cycle: Sequence[str], pos: Column) -> Column:
    """The source of a position."""
    return F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(pos, F.lit(len(cycle))) + 1).cast("int"))


def draw(u: Column, weights: Sequence[float], fallback: int = 0) -> Column:
    """Index of the source that a uniform number draws: negative weights count as 0; with all 0 the fallback."""
    if not 0 <= fallback < len(weights):
        raise ValueError("fallback is no source")
    clamped = [max(0.0, w) for w in weights]
    total = math.fsum(clamped)
    if not total > 0:
        return F.lit(fallback)
    out, low = F, 0.0
    for i, w in enumerate(clamped):
        low += w
        if w > 0:
            out = out.when(u * total < low, i)
    return out.otherwise(max(i for i, w in enumerate(clamped) if w > 0))


def resolve_points(points: Sequence[tuple[float | int, float]], max_steps: int) -> list[tuple[int, float]]:
    """(step, weight) in order: integers are steps, floats from 0 to 1 are fractions, rounded half to even; the first of equal steps stays."""
    if not points:
        raise ValueError("a schedule needs points")
    for s, _ in points:
        if isinstance(s, bool) or s < 0 or (isinstance(s, float) and s > 1):
            raise ValueError(f"{s} is neither a step nor a fraction")
    steps: dict[int, float] = {}
    for s, w in sorted(((s if isinstance(s, int) else round(s * max_steps), w) for s, w in points), key=lambda x: x[0]):
        steps.setdefault(s, float(w))
    return list(steps.items())


def schedule(step: Column, points: Sequence[tuple[int, float]]) -> Column:
    """Linear interpolation between points, constant beyond the ends."""
    out = F.when(step <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(step <= x1, F.lit(float(y0)) + F.lit(float(y1 - y0)) * (step - x0) / F.lit(float(x1 - x0)))
    return out.otherwise(float(points[-1][1]))


def uniform_union(frames: Sequence[DataFrame], tags: Sequence[str]) -> DataFrame:
    """The union of the columns that all frames have, with the source's tag."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = None
    for f, tag in zip(frames, tags):
        one = f.select(*common).withColumn("source_tag", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    return out
