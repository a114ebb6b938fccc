"""Score fusion and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fused(parts: list[tuple[Column, float]], penalties: list[Column]) -> Column:
    """Weighted mean of the parts that are there, less the penalties, held in [0, 1]; 0 if no part is there."""
    total, weight, off = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        if w > 0:
            total += F.coalesce(value * w, F.lit(0.0))
            weight += F.when(value.isNotNull(), w).otherwise(0.0)
    for p in penalties:
        off += F.coalesce(p, F.lit(0.0))
    return F.when(weight > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(total, weight) - off))).otherwise(0.0)


def tier(confidence: Column, anomaly: Column, least_anomaly: float = 0.5) -> Column:
    return F.when(confidence >= 80, "hazard").when(confidence >= 50, "review").when((anomaly >= least_anomaly) & (confidence >= 30), "anomaly").otherwise("hidden")
