"""The scoring algebra: normalisation, blend, decay, priors, routes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Weights of the blend, decay and rank fusion.
WEIGHTS = {"bm25": 0.2, "dense": 0.3, "rerank": 0.5}
HALF_LIFE_DAYS, DECAY_STRENGTH, RRF_K = 180.0, 0.15, 60


def min_max(value: Column, *keys: str) -> Column:
    """Within the rows of keys; 0 for nulls and where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull() | (high - low < 1e-9), 0.0).otherwise((value - low) / (high - low))


def blend(**signals: Column) -> Column:
    """Weighted mean of normalised signals; a missing one counts 0 and stays in the denominator."""
    top = sum((F.lit(WEIGHTS[k]) * F.coalesce(v, F.lit(0.0)) for k, v in signals.items()), F.lit(0.0))
    return top / F.lit(sum(WEIGHTS.values()))


def decay(age_days: Column, half_life: float = HALF_LIFE_DAYS, strength: float = DECAY_STRENGTH) -> Column:
    """1 without an age; strength 1 decays wholly, less keeps a floor of 1 - strength."""
    if half_life <= 0 or strength <= 0:
        return F.lit(1.0)
    full = F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life)
    return F.coalesce(full if strength >= 1 else (1 - strength) + strength * full, F.lit(1.0))


def prior(delta: Column, boost: Column | None = None) -> Column:
    base = F.greatest(F.lit(0.1), 1 + F.coalesce(delta, F.lit(0.0)))
    return base if boost is None else base * F.greatest(F.lit(0.0), F.coalesce(boost, F.lit(1.0)))


def folded_prior(steps: Column) -> Column:
    """Ordered deltas added up, each sum clamped to [-0.9, 4]; what ends within 1e-6 of 0 is 0."""
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: F.least(F.lit(4.0), F.greatest(F.lit(-0.9), a + x)))
    return F.when(F.abs(total) < 1e-6, 0.0).otherwise(total)


def clamped_sum(steps: Column) -> Column:
    """struct(s, low, high) of the function that an ordered array of deltas is, each sum clamped to [-0.9, 4]:
    x -> min(high, max(low, x + s)). Such functions compose into another, so pieces of a sequence can be folded apart."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    clamp = lambda x: F.least(F.lit(4.0), F.greatest(F.lit(-0.9), x))
    return F.aggregate(steps, start, lambda a, d: F.struct((a["s"] + d).alias("s"), clamp(a["low"] + d).alias("low"), clamp(a["high"] + d).alias("high")))


def composed_prior(pieces: Column) -> Column:
    """``folded_prior`` from an ordered array of ``clamped_sum`` pieces."""
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: F.least(p["high"], F.greatest(p["low"], a + p["s"])))
    return F.when(F.abs(total) < 1e-6, 0.0).otherwise(total)


def route(query: Column, late_interaction: bool = False) -> Column:
    """struct(route, k) by length, capitals and question marks."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda x: x != "")
    n, asks = F.size(words), F.contains(query, F.lit("?"))
    pick = lambda name, k: F.struct(F.lit(name).alias("route"), F.lit(k).alias("k"))
    out = F.when((n <= 3) & ~asks, pick("sparse", 24)).when((n <= 4) & query.rlike("[A-Z]"), pick("hybrid", 32))
    out = out.when(asks | (n > 10), pick("colbert", 32) if late_interaction else pick("rerank", 24))
    return (out.when(n >= 6, pick("colbert", 24)) if late_interaction else out).otherwise(pick("hybrid", 24))


def needs_retry(best: Column, tokens: Column, top_text: Column, is_table: Column, threshold: float = 0.0) -> Column:
    """Whether a result should be tried again lexically; best null: there were no rows."""
    share = F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(F.lower(top_text), t))) / F.size(tokens)).otherwise(1.0)
    return (
        F.when(best.isNull(), True)
        .when((best >= max(threshold, 0.35)) | (F.size(tokens) == 0), False)
        .when(F.coalesce(top_text, F.lit("")) == "", True)
        .when(share < 0.25, True)
        .otherwise(~is_table & (share < 0.4) & (best < 0.2))
    )
