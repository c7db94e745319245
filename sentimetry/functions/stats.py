"""Aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation that is NULL (not an error under ANSI mode) when a
    series is constant: cov(a, b) / (sd(a) · sd(b)) with ``try_divide``."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
