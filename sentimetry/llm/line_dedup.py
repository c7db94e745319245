"""Operator 5: boilerplate lines by their frequency within a site.

Pages are grouped by host; the number of pages that hold a line is divided by
the host's pages, and lines above ``ratio`` (and on at least ``least_pages``
pages) are dropped.  A line counts once a page, trimmed of blanks; lines without
a word are never dropped.  A page all of whose lines would go is left whole: it
is a copy of other pages, not boilerplate around a text.

Only hashes of lines are shuffled, reduced to one count for each host and line
before the exchange, so neither a hot host nor a hot line meets in one task.  A
host has at most (lines of a page on average / ratio) such lines, so they fit a
row of their host.  These rows are written, counted, and broadcast when they are
few, so texts filter their own lines in place and never move.

Defined results: null text stays null; a null host is a host of its own; a
page's repeated rows are pages of their own; a page whose lines partly go keeps
the rest in order, joined by line feeds; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

BROADCAST_LINES = 1_000_000  # hashes; beyond, texts are joined to them by host, a hot host in splits
BLANK = " \t\r\f\v"


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """(host, boilerplate): the hashes of each host's boilerplate lines, as an array."""
    lines = pages.select(host.alias("host"), F.array_distinct(F.transform(F.filter(F.split(text, "\n"), _has_word), _hash)).alias("lines"))
    sizes = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    common = lines.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("having")).where(F.col("having") >= least_pages)
    same = common.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host")))
    return same.where(F.col("having") > F.col("pages") * ratio).groupBy(F.col("c.host").alias("host")).agg(F.collect_list("line").alias("boilerplate"))


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """(page, lines_dropped): each row of ``pages`` as a struct, whatever its columns
    are called, without the boilerplate lines in its ``text``."""
    marks = boilerplate_lines(pages, F.col(host), F.col(text), ratio, least_pages)
    marks = stored(marks, "boilerplate")
    hashes = marks.agg(F.sum(F.size("boilerplate") + 1)).first()[0] or 0
    p, m = pages.select(F.struct("*").alias("page"), F.col(host).alias("page_host")), marks
    both = p.join(F.broadcast(m) if hashes <= BROADCAST_LINES else m, F.col("page_host").eqNullSafe(F.col("host")), "left")
    old = F.col("page").getField(text)
    goes = lambda line: _has_word(line) & F.array_contains(F.col("boilerplate"), _hash(line))
    lines = F.split(old, "\n")
    kept = F.filter(lines, lambda line: ~goes(line))
    touched = F.col("boilerplate").isNotNull() & old.isNotNull()
    both = both.withColumn("kept", F.when(touched, kept))
    some_left = F.exists("kept", _has_word)
    dropped = F.when(touched & some_left, F.size(lines) - F.size("kept")).otherwise(0)
    columns = [F.col("page").getField(c).alias(c) if c != text else F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(old).alias(text) for c in pages.columns]
    return both.select(F.struct(*columns).alias("page"), dropped.alias("lines_dropped"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``, and ``lines_dropped`` (int),
    to which a column of that name gives way."""
    columns = [F.col("page").getField(c).alias(c) for c in pages.columns if c != "lines_dropped"]
    return without_boilerplate(pages, host, text, ratio, least_pages).select(*columns, "lines_dropped")


def line_dedup_sql(table: str = "documents", ratio: float = 0.1, least_pages: int = 5) -> str:
    """The same in DuckDB SQL, for doc_id, text and lines_dropped."""
    trim = "trim(x, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS xs FROM {table}),
sizes AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
marks AS (
  SELECT e.source, e.line FROM (SELECT DISTINCT r, source, unnest(list_transform(xs, lambda x: {trim})) AS line FROM d) e
  JOIN sizes s ON e.source IS NOT DISTINCT FROM s.source
  WHERE e.line <> '' GROUP BY e.source, e.line, s.pages HAVING count(*) >= {least_pages} AND count(*) > s.pages * {ratio}::DOUBLE),
lists AS (SELECT source, list(line) AS marked FROM marks GROUP BY source),
k AS (
  SELECT d.*, CASE WHEN l.marked IS NULL THEN xs ELSE list_filter(xs, lambda x: NOT list_contains(l.marked, {trim})) END AS kept
  FROM d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
n AS (SELECT *, CASE WHEN len(list_filter(kept, lambda x: {trim} <> '')) > 0 THEN len(xs) - len(kept) ELSE 0 END AS gone FROM k)
SELECT doc_id, CASE WHEN gone > 0 THEN array_to_string(kept, chr(10)) ELSE text END AS text, CAST(coalesce(gone, 0) AS INTEGER) AS lines_dropped FROM n"""
