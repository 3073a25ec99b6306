"""Texts shown beside scores and contributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wordings of a contribution's direction (positive, otherwise).
DIRECTION_RISK = ("Increase Risk", "Decrease Risk")
DIRECTION_ARROW = ("↑ Risk", "↓ Risk")
DIRECTION_IMPACT = ("⬆️ Increases Risk", "⬇️ Decreases Risk")

# A probability above the upper cut is high, above the lower cut medium.
RISK_CUTS = (0.2, 0.5)
RISK_BANDS = ("low", "medium", "high")


def direction(contribution: Column, wording: tuple[str, str] = DIRECTION_RISK) -> Column:
    return F.when(contribution > 0, wording[0]).otherwise(wording[1])


def risk_band(
    probability: Column,
    cuts: tuple[float, float] = RISK_CUTS,
    bands: tuple[str, str, str] = RISK_BANDS,
) -> Column:
    return (
        F.when(probability.isNull(), None)
        .when(probability > cuts[1], bands[2])
        .when(probability > cuts[0], bands[1])
        .otherwise(bands[0])
    )


def percent_text(probability: Column, decimals: int = 2) -> Column:
    return F.when(probability.isNotNull(), F.format_string(f"%.{decimals}f%%", probability * 100))


def signed_text(value: Column, decimals: int = 4) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%+.{decimals}f", value))


def fixed_text(value: Column, decimals: int = 2) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))
