"""Small tables with the odd cases every operator must take."""

from pyspark.sql import functions as F


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + ("en", "src0"))[:4] if len(r) == 2 else r for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long"))


def with_clashes(df):
    """Extra columns named like an operator's own working columns."""
    for name in ("key", "row", "hash", "words", "n", "host", "line", "spans", "size", "runs", "label", "score", "h"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(7))
    return df


def lorem(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def stage_folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
