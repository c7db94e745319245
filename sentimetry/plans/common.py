"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lexicon import lexicon_setup
from ..sources import fixtures as fx

DIGITS = 6


def r6(c) -> F.Column:
    """Round a double to 6 decimals (and turn -0.0 into 0.0) so sums taken in
    another order compare equal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, DIGITS) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round({expr}, {DIGITS}) + 0.0)"


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return fx.corpus(spark, sf)


def lexicons(spark: SparkSession) -> DataFrame:
    """F2 after O51 set-up with the F3 shifters."""
    return lexicon_setup(fx.lexicons(spark), fx.valence(spark))


LEX_NAMES = sorted({r[0] for r in fx.LEXICON_ROWS})

