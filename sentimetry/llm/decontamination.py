"""Operator 6: benchmark decontamination by a broadcast hash set of word windows.

A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters.  A
window is ``width`` consecutive words of a benchmark item, or all words of a
shorter item.  The distinct windows, as hashes, are broadcast when their number
is at most ``broadcast_windows`` (else Spark joins by shuffle); every training
window is looked up, and what is hit goes back to the texts by row, where the
words themselves are compared before a word counts as hit.

Defined results: null or empty text has no words, no hits and isn't
contaminated; items without words are ignored; a null doc_id keeps its hits;
repeated rows are judged each; an empty table gives no rows, an empty benchmark
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
BROADCAST_WINDOWS = 200_000  # some 60 MB with their words
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower()), F.lit(WORD), F.lit(0))


def with_window_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (with words ``w``) and, for each k of ``sizes``, ``h<k>``: the hash of each
    window of k words, by its first word.

    Words are hashed once; runs of 2, 4, 8, ... words hash the hashes of their
    halves, and a window of k those of its first and last run of the greatest
    power of two up to k, so a window costs a few hashes of numbers."""
    pair = lambda a, b: F.xxhash64(a, b)
    rows, run = rows.withColumn("run1", F.transform("w", lambda x: F.xxhash64(x))), 1
    for k in sorted(sizes):
        while 2 * run <= k:
            half = F.col(f"run{run}")
            rows, run = rows.withColumn(f"run{2 * run}", F.zip_with(half, F.slice(half, run + 1, F.size(half)), pair)), 2 * run
        last = F.col(f"run{run}")
        whole = last if run == k else F.zip_with(last, F.slice(last, k - run + 1, F.size(last)), pair)
        rows = rows.withColumn(f"h{k}", F.slice(whole, 1, F.greatest(F.size("w") - (k - 1), F.lit(0))))
    return rows


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(size, hash, grams): distinct windows; grams: [(words, item ids)], as a rule one."""
    item = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("size", F.least(F.size("w"), F.lit(width)))
    gram = item.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.slice("w", i + 1, F.col("size")))).alias("gram"))
    gram = gram.groupBy("size", "gram").agg(F.collect_set("item_id").alias("items"))
    every = list(range(1, width + 1))
    gram = with_window_hashes(gram.withColumnRenamed("gram", "w"), every).withColumnRenamed("w", "gram")
    by_size = F.coalesce(*[F.when(F.col("size") == k, F.get(f"h{k}", F.lit(0))) for k in every])
    return gram.withColumn("hash", by_size).groupBy("size", "hash").agg(F.collect_list(F.struct("gram", "items")).alias("grams"))


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, n_words, hit_spans, n_hit, items, contaminated): each row of ``docs``
    as a struct, whatever its columns are called, and what was found in it."""
    windows = benchmark_windows(benchmark, width).persist()
    sizes = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}  # width rows at most
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.col("text")).alias("version"), words(F.col("text")).alias("w"))
    row = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text")).alias("version"))
    if not sizes:
        both = row.withColumn("hits", F.expr("cast(array() as array<struct<at:int,size:int,grams:array<struct<gram:array<string>,items:array<bigint>>>>>)"))
    else:
        placed = lambda k: F.transform(F.col(f"h{k}"), lambda h, at: F.struct(F.lit(k).alias("size"), at.alias("at"), h.alias("hash")))
        every = [placed(k) for k in sorted(sizes)]
        found = with_window_hashes(text, sorted(sizes)).select("id", "version", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("x")).select("id", "version", "x.*")
        found = found.join(F.broadcast(windows) if small else windows, ["size", "hash"])
        by_doc = found.groupBy("id", "version").agg(F.collect_list(F.struct("at", "size", "grams")).alias("hits"))
        r, h = row.alias("r"), by_doc.alias("h")
        both = r.join(h, F.col("r.id").eqNullSafe(F.col("h.id")) & (F.col("r.version") == F.col("h.version")), "left").select("doc", "hits")
    both = both.withColumn("w", words(F.col("doc.text")))
    same = lambda h: F.transform(F.filter(h["grams"], lambda g: g["gram"] == F.slice(F.col("w"), h["at"] + 1, h["size"])), lambda g: g["items"])
    sure = F.filter(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["size"]).alias("end"), F.flatten(same(h)).alias("items"))), lambda h: F.size(h["items"]) > 0)
    sure = F.array_sort(F.coalesce(sure, F.array().cast("array<struct<at:int,end:int,items:array<bigint>>>")))
    # a generator keeps the optimizer from repeating the comparison of words wherever its result is read
    both = both.select("doc", F.explode(F.array(F.struct(F.size("w").cast("long").alias("n_words"), sure.alias("sure")))).alias("x")).select("doc", "x.*")
    none = F.struct(F.array().cast("array<struct<first:int,end:int>>").alias("spans"))
    span = lambda a, b: F.array(F.struct(a.alias("first"), b.alias("end")))

    def add(so_far: Column, h: Column) -> Column:
        last = F.try_element_at(so_far["spans"], F.lit(-1))
        rest = F.slice(so_far["spans"], 1, F.greatest(F.size(so_far["spans"]) - 1, F.lit(0)))
        joins = last.isNotNull() & (h["at"] <= last["end"])
        return F.struct(F.when(joins, F.concat(rest, span(last["first"], F.greatest(last["end"], h["end"])))).otherwise(F.concat(so_far["spans"], span(h["at"], h["end"]))).alias("spans"))

    both = both.withColumn("hit_spans", F.aggregate("sure", none, add)["spans"])
    beyond = lambda n, h: F.struct(F.greatest(n["upto"], h["end"]).alias("upto"), (n["hit"] + F.greatest(h["end"] - F.greatest(h["at"], n["upto"]), F.lit(0))).alias("hit"))
    hit = F.aggregate("sure", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("hit")), beyond)["hit"]
    return both.select(
        "doc", "n_words", "hit_spans", hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("sure", lambda h: h["items"])), lambda i: i.cast("string")))).alias("items"),
        (hit * 20 >= F.greatest("n_words", F.lit(20))).alias("contaminated"),  # and so n_hit > 0
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of (first, end) word numbers, merged),
    n_hit, items (sorted array of strings) and contaminated; columns of ``docs``
    with these names give way to them."""
    own = ["n_words", "hit_spans", "n_hit", "items", "contaminated"]
    return judged(docs, benchmark, width).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in own], *own)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, its own columns as they came;
    stray hits of others stay."""
    return judged(docs, benchmark, width).where(~F.col("contaminated")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontamination_sql(docs: str = "documents", benchmark: str = "benchmark", width: int = WIDTH) -> str:
    """The digest in DuckDB SQL."""
    w = rf"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {w} AS w FROM {docs}),
b AS (SELECT item_id, {w} AS w FROM {benchmark}),
i AS (SELECT item_id, w, least(len(w), {width}) AS size FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS k FROM i)),
sizes AS (SELECT DISTINCT size FROM g),
h AS (SELECT d.r, t.k, t.size, g.item_id FROM (SELECT r, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS k FROM d, sizes WHERE len(w) >= size) t
      JOIN d USING (r) JOIN g ON g.size = t.size AND g.gram = array_to_string(t.w[t.k:t.k + t.size - 1], ' ')),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(k, (k + size)::BIGINT)) AS place FROM h) GROUP BY r),
own AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""
