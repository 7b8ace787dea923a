"""Decision tables and scores of single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def similarity_verdict(overall: Column, same_brand: Column, same_product: Column) -> Column:
    """Verdict from an overall similarity; the first line that holds decides."""
    return (
        F.when((overall >= 0.95) & same_brand, F.lit("near_duplicate"))
        .when((overall >= 0.75) & same_brand & same_product, F.lit("same_campaign"))
        .when((overall >= 0.75) & same_brand, F.lit("same_brand_related"))
        .when(overall >= 0.70, F.lit("related"))
        .otherwise(F.lit("different"))
    )


def likelihood(has_keyword: Column, seconds: Column) -> Column:
    """How likely an item is an advertisement: a keyword, and a class by duration with a veto for long forms."""
    by_length = F.when(seconds <= 95, F.lit(0.5)).when(seconds <= 180, F.lit(0.2)).otherwise(F.lit(0.0))
    score = F.when(has_keyword, F.lit(0.5)).otherwise(F.lit(0.0)) + by_length
    return F.when(seconds > 180, F.least(score, F.lit(0.25))).otherwise(F.least(score, F.lit(1.0)))


def signal_confidence(tier: Column, likely: Column, before: Column, bonus: float = 0.15, each: float = 0.2, cap: float = 0.4) -> Column:
    """Tier weight, likelihood bonus and capped corroboration, clamped to 0..1."""
    return clamp(tier + bonus * likely + F.least(each * before, F.lit(cap)))


def iso_week_key(ts: Column) -> Column:
    """``YYYY-wWW`` of the ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-w"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def backoff_hours(interval: Column, errors: Column, cap: float = 168.0) -> Column:
    """Hours until the next poll: doubled with each error in a row, capped."""
    return F.least(interval * F.pow(F.lit(2.0), F.least(errors, F.lit(8))), F.lit(cap))
