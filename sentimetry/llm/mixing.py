"""Operator 10: mixing sources to target weights by entropy balancing.

Sources, by code point and null last, weigh ``weights`` in turn and share all
words; a target stops at ``most`` times its source's size and the excess goes
to the others by weight (water filling, solved by running totals over sources).

Document rates r minimise the sum of r log r - r + 1, that is they stay as near
to one copy of each document as possible, subject to each source's token
constraint sum(r * size) = target and to r <= ``most``.  The dual is convex with
one variable a source; its solution tilts exponentially, r = min(most,
exp(dual * size / mean size of the source)).  Newton rounds run in Spark over
counts of (source, size), all sources at once, inside a bracket that halves
where a step would leave it.  Sums are exact decimals, so reruns agree.

Rates become copies by systematic rounding of counts of (source, size): along
the sizes of a source one more copy is due where the running total of fractions
passes an integer, and what is left of the target then goes to sizes that fit it.
The copies due are spread evenly over the documents of that size, ranked by
hash; ranks are taken within (source, size, salt), so no hot source or size is
one group.

Defined results: null text has size 0 and one copy; a null source is a source,
the last; repeated rows are documents of their own; a source of size 0 has
target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

UNIT = 1 << 20  # rates are whole numbers of this fraction
SALTS = 64
STEPS = 4  # Newton rounds between two written states
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size, n) with target: water filling over sources."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.get(F.array(*map(F.lit, weights)), (rank - 1) % len(weights)).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    return s.withColumn("target", F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))).drop("weight", "cap", "level")


def _rate(dual, size, mean, most: float):
    """The tilted rate in whole units."""
    return F.round(F.least(F.lit(most), F.exp(F.least(dual * size / mean, F.lit(50.0)))) * UNIT).cast("long")


def balance(counts: DataFrame, sources: DataFrame, most: float = 3.0, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """Solve the dual.  ``counts`` (name, size, n), ``sources`` (name, source_size,
    n, target) -> (name, dual, mean).  Stops when every source is within
    ``tolerance`` of its target or one unit in the rate can't bring it nearer."""
    exact = lambda x: F.sum(F.round(x).cast("decimal(38,0)"))
    state = sources.select(
        "name", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.when(F.col("target") >= F.col("source_size") * most * (1 - 1e-12), 1e9).otherwise(0.0).alias("dual"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(False).alias("done"),
    ).where("mean > 0")
    state = stored(state.withColumn("done", F.col("dual") > 0), "duals")
    for _ in range(0, rounds, STEPS):
        for _ in range(STEPS):
            tilt = counts.join(state, "name").withColumn("rate", _rate(F.col("dual"), F.col("size"), F.col("mean"), most))
            words = F.col("n").cast("decimal(20,0)") * F.col("size")
            slope = F.when(F.col("rate") < int(most * UNIT), F.col("n") * F.col("size") * F.col("size") / F.col("mean") * F.col("rate")).otherwise(0.0)
            step = tilt.groupBy("name").agg(*[F.first(c).alias(c) for c in ("target", "mean", "dual", "low", "high", "done")], (F.sum(words * F.col("rate")).cast("double") / UNIT).alias("taken"), (exact(slope).cast("double") / UNIT).alias("slope"))
            off = F.col("target") - F.col("taken")
            step = step.withColumn("low", F.when(off > 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(off < 0, F.col("dual")).otherwise(F.col("high")))
            newton = F.col("dual") + off / F.greatest(F.col("slope"), F.lit(1e-9))
            inside = (newton > F.col("low")) & (newton < F.col("high"))
            half = F.when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.lit(1.0))).when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
            near = (F.abs(off) <= F.greatest(F.lit(0.5), F.col("target") * tolerance)) | (F.col("high") - F.col("low") < 1e-13)
            moved = F.when(inside & (F.abs(newton - F.col("dual")) < 8), newton).otherwise(half)
            state = step.select("name", "target", "mean", F.when(F.col("done") | near, F.col("dual")).otherwise(moved).alias("dual"), "low", "high", (F.col("done") | near).alias("done"))
        state = stored(state, "duals")
        if state.where("not done").isEmpty():
            break
    return state.select("name", "dual", "mean")


def extra_copies(rated: DataFrame, most: float) -> DataFrame:
    """Round rates within each (name, size) of n documents: ``base`` copies of each
    and one more of ``extra`` of them.  Systematic along sizes; then, where the
    words still miss their total, one copy more or less in the smallest sizes
    that fit, again for what is left."""
    part = F.col("rate") % UNIT
    along = Window.partitionBy("name").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    source = Window.partitionBy("name")
    out = rated.withColumn("base", F.floor(F.col("rate") / UNIT)).withColumn("share", F.col("n") * part).withColumn("upto", F.sum("share").over(along))
    passed = lambda x: F.floor((x + UNIT // 2) / UNIT)
    out = out.withColumn("extra", passed(F.col("upto")) - passed(F.col("upto") - F.col("share")))
    for _ in range(6):
        aim = F.round(F.sum(F.col("share").cast("decimal(28,0)") * F.col("size")).over(source) / UNIT).cast("long")
        out = out.withColumn("miss", aim - F.sum(F.col("extra") * F.col("size")).over(source))
        more = (F.col("miss") > 0) & (F.col("base") < int(most)) & (F.col("extra") < F.col("n")) & (F.col("size") > 0)
        less = (F.col("miss") < 0) & (F.col("extra") > 0) & (F.col("size") > 0)
        out = out.withColumn("can", F.when(more, 1).when(less, -1).otherwise(0))
        best = F.max(F.when((F.col("can") != 0) & (F.col("size") <= F.abs("miss")), F.col("size"))).over(source)
        out = out.withColumn("best", best).withColumn("extra", F.col("extra") + F.when(F.col("size") == F.col("best"), F.col("can")).otherwise(0))
    return out.select("name", "size", F.col("n").alias("alike"), "rate", "base", "extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, rate, copies, taken) for every row of
    ``docs`` (doc_id, text, source); key: hash of the row's id and text."""
    name = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    doc = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("key"), size.alias("size")).withColumn("name", name), "sizes")
    counts = stored(doc.groupBy("name", "source", "size").agg(F.count("*").alias("n")), "counts")
    sources = targets(counts.groupBy("name", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n")), weights, most)
    sources = stored(sources.select("name", "source_size", "n", "target"), "sources")
    duals = balance(counts.select("name", "size", "n"), sources, most)

    rated = counts.select("name", "size", "n").join(duals, "name", "left").withColumn("rate", F.when(F.col("mean").isNull() | (F.col("size") == 0), UNIT).otherwise(_rate(F.col("dual"), F.col("size"), F.col("mean"), most)))
    rated = stored(extra_copies(rated, most), "rates")
    doc = doc.withColumn("salt", F.pmod("key", F.lit(SALTS)))
    salts = doc.groupBy("name", "size", "salt").agg(F.count("*").alias("n"))
    salts = salts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("name", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("name", "size", "salt").orderBy("key", "doc_id"))
    doc = doc.withColumn("rank", rank).join(salts, ["name", "size", "salt"]).join(rated, ["name", "size"]).join(sources.drop("n"), "name")
    place = F.col("first") + F.col("rank")
    evenly = lambda j: F.floor(j * F.col("extra") / F.col("alike"))
    copies = (F.col("base") + evenly(place) - evenly(place - 1)).cast("long")
    return doc.withColumn("copies", copies).select("doc_id", "key", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``docs`` with ``copies`` (``mix_copies`` where the documents have a column of
    that name, which stays), without documents that the mix takes no copy of."""
    taken = mix(docs, weights, most).groupBy("doc_id", "key", "source").agg(F.sort_array(F.collect_list("copies")).alias("each"))
    order = Window.partitionBy("id", "key", "of").orderBy(F.lit(0))  # equal rows
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.col("source").cast("string").alias("of")).withColumn("nth", F.row_number().over(order))
    t = taken.alias("t")
    both = rows.join(t, F.col("id").eqNullSafe(F.col("t.doc_id")) & (rows["key"] == F.col("t.key")) & F.col("of").eqNullSafe(F.col("t.source")))
    name = "copies"
    while name in docs.columns:
        name = "mix_" + name
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    return both.withColumn("copies", F.get("each", F.col("nth") - 1)).where("copies > 0").select(*columns, F.col("copies").alias(name))
