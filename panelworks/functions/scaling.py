"""Target and feature scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(value: Column) -> Column:
    """Tolerant cast: text that is no number, and NaN, become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Map [low, high] to [0, 1] without clipping; 0 where the range is empty."""
    return F.when(high - low <= 0, F.lit(0.0)).otherwise((value - low) / (high - low))


def inverse_log_minmax(scaled: Column, low: Column, high: Column) -> Column:
    """Undo log1p followed by min-max scaling."""
    return F.expm1(scaled * (high - low) + low)


def finite(value: Column) -> Column:
    """Null where the value is NaN or infinite."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standardise; whatever is missing or not finite afterwards becomes 0."""
    return F.coalesce(finite((value - mean) / std), F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value on either side; null stays null."""
    bounded = value
    if high is not None:
        bounded = F.when(bounded > high, F.lit(high)).otherwise(bounded)
    if low is not None:
        bounded = F.when(bounded < low, F.lit(low)).otherwise(bounded)
    return bounded


def hard_threshold(prediction: Column, zero_probability: Column, threshold: float = 0.5) -> Column:
    """Prediction 0 wherever the zero probability reaches the threshold."""
    return F.when(zero_probability >= threshold, F.lit(0.0)).otherwise(prediction)


def sigmoid(value: Column) -> Column:
    """Logistic function in the form that does not overflow for either sign."""
    small = F.exp(-F.abs(value))
    return F.when(value >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softplus(value: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(value, F.lit(0.0)) + F.log1p(F.exp(-F.abs(value)))


def soft_gate(zero_logit: Column, raw_value: Column) -> Column:
    """(1 - sigmoid(zero logit)) * softplus(raw value)."""
    return (1 - sigmoid(zero_logit)) * softplus(raw_value)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share in percent."""
    return F.round(safe_ratio(part * 100.0, whole), digits)
