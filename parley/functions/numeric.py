"""Numeric column helpers: score coercion, exact half-up rounding, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are carried as whole units of 1e-15, read from the decimal digits of
# the JSON text, so sums are exact integers and a result depends neither on
# the order of summation nor on how a double is rounded.
UNIT = 10**15
_SCORE = "decimal(27,15)"


def score_number(raw: Column) -> Column:
    """A score given as JSON text, as DECIMAL(27,15): its exact digits where
    it is written as a number, the double's value otherwise (white space
    around it is accepted; ``true`` and ``false`` count 1 and 0, as for
    Python's ``float``). NULL for anything that is not a finite number below
    1e12; :func:`parley.operators.scoring.rejected_scores` lists those."""
    t = F.trim(raw)
    return (F.when(t == "true", F.lit(1).cast(_SCORE)).when(t == "false", F.lit(0).cast(_SCORE))
            .otherwise(F.coalesce(t.try_cast(_SCORE), t.try_cast("double").try_cast(_SCORE))))


def score_value(raw: Column) -> Column:
    """SC-8: numeric coercion of a score given as JSON text."""
    return score_number(raw).cast("double")


def score_units(raw: Column) -> Column:
    """Exact whole units of a score."""
    return (score_number(raw) * F.lit(UNIT).cast("decimal(16,0)")).cast("decimal(27,0)")


def exact_mean(units: Column, weight: Column) -> Column:
    """Rounded ``units / weight`` (see :func:`round_ratio_half_up`)."""
    return round_ratio_half_up(units, weight.cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(16,0)"))


def round_ratio_half_up(num: Column, den: Column, digits: int = 2) -> Column:
    """SC-7: ``round(num / den, digits)``, HALF_UP on the exact ratio.

    ``num`` and ``den`` are integer columns with ``den > 0``. Integral
    division keeps the result exact, so it never depends on how a double
    happens to be rounded (``round(1.005, 2)`` differs between engines)."""
    scale = 10 ** digits
    # DECIMAL(38,0) keeps 2*scale*|num| exact far beyond the 64-bit range
    # (a hot agent with billions of meetings).
    n = num.cast("decimal(38,0)")
    d = den.cast("decimal(38,0)")
    a = F.abs(n)
    # ``div`` truncates toward zero; both operands are non-negative, so it
    # is floor((2*scale*|num| + den) / (2*den)).
    q = F.call_function("div", a * F.lit(2 * scale) + d, F.lit(2) * d)
    return (F.signum(n.cast("double")) * q.cast("double") / F.lit(float(scale))).cast("double")


# Score band thresholds (a score is banded after rounding).
BAND_GREEN_MIN = 7.5
BAND_AMBER_MIN = 5.0


def score_band(rounded_score: Column) -> Column:
    """PRJ-16: band of an already rounded score: >=7.5 green, >=5 amber,
    else red. Returns the band name rather than a colour."""
    return (F.when(rounded_score >= BAND_GREEN_MIN, F.lit("green"))
            .when(rounded_score >= BAND_AMBER_MIN, F.lit("amber"))
            .otherwise(F.lit("red")))
