"""Corpus sources (O01 corpus_scan, O09 distinct_dates_peek, O10 corpus_build)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType()), True),
])


def corpus_from_table(df: DataFrame, id_col: str = "id", date_col: str = "date", text_col: str = "text",
                      feature_cols: list[str] | None = None) -> DataFrame:
    """Project a wide table to the corpus shape.

    Feature columns (numeric, meant to lie in [0, 1]) are folded into one map so
    the plan does not depend on which features a corpus carries.  A table that
    already has a ``features`` map keeps it.
    """
    cols = df.columns
    if feature_cols is None and "features" in cols:
        feats = F.col("features").cast("map<string,double>")
    else:
        names = feature_cols if feature_cols is not None else [
            c for c in cols if c not in (id_col, date_col, text_col)]
        if names:
            feats = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
        else:
            feats = F.create_map().cast("map<string,double>")
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(date_col).cast("date").alias("date"),
        F.col(text_col).cast("string").alias("text"),
        feats.alias("features"),
    )


def corpus_scan(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Read a parquet corpus; filters on id/date reach the scan."""
    return corpus_from_table(spark.read.parquet(path), **kw)


def distinct_dates_peek(corpus: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` distinct dates (``head(unique(date))``), a top-k."""
    return corpus.select("date").distinct().orderBy("date").limit(n)


def corpus_build(corpus: DataFrame) -> DataFrame:
    """Validate a corpus and min-max scale features that leave [0, 1].

    Per feature the min and max come from one aggregate over the exploded map,
    which doesn't read the text; as a one-row map (feature → bounds) they are a
    scalar subquery, and each document scales its own map in place: no text is
    shuffled.
    """
    missing = {"id", "date", "text"} - set(corpus.columns)
    if missing:
        raise ValueError(f"corpus lacks columns {sorted(missing)}")
    bounds = corpus.select(F.explode("features").alias("feature", "v")).groupBy("feature").agg(
        F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("b"))
    by_name = bounds.agg(F.map_from_entries(F.collect_list(F.struct("feature", "b")))).scalar()

    def scale(name, v):
        b = F.try_element_at(F.col("_bounds"), name)
        return F.when((b["lo"] >= 0) & (b["hi"] <= 1), v).otherwise(
            F.coalesce(F.try_divide(v - b["lo"], b["hi"] - b["lo"]), F.lit(0.0)))

    scaled = F.transform_values("features", scale)
    return corpus.withColumn("_bounds", by_name).withColumn("features", scaled).drop("_bounds")
