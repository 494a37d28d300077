"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a random but repeatable place on the 64-bit ring, from a hash of
its id and text. The ring is cut into equal ranges. Word counts are summed per source
and range where the rows lie, so a source with a third of all rows is as many small
sums as it has ranges; prefix sums of those find the one range of a source in which its
budget runs out. Only that range is sorted by place, to cut at the exact word. No text
is shuffled, and the only tables that meet a document are one row per source.

Defined results
    null text: size 0, nothing taken. Null source: a source of its own, after the others.
    Empty table: empty result. A source without words: target 0.
    Repeated rows (same id and text) have one place. When the cut falls on them, each
    takes the same number of words, so the source may miss less than a word for each.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.session import materialize, sized

WORD = r"[^\x20\x09-\x0D]+"

#: Ranges of the ring, as bits of a place: 4 096 sums for each source, and at 10^10
#: documents of a source some 2.5 million of them in a range.
RANGE_BITS = 12

PLACE, SIZE = "_place", "_size"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def _ring(c: Column) -> Column:
    """The range of a place; shifting keeps the order of signed places."""
    return F.shiftright(c, 64 - RANGE_BITS)


def targets(totals: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Words each source shall give; ``totals`` has one row per source: source, total.

    Sources by code point, null last, take the weights in turn. They share ``share`` of
    all words by weight; none gives more than ``epochs`` times its own, and the excess is
    shared by the others again. At the end all that are not full have the same target per
    weight (the level), so with the sources in order of ``epochs * total / weight`` the
    level follows from the sums before and after each. The number of sources is far
    below that of rows, and the two windows see one row for each.
    """
    everyone = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = (
        totals.withColumn("_w", weight)
        .withColumn("_full", F.lit(float(epochs)) * F.col("total"))
        .withColumn("_all", F.lit(float(share)) * F.sum("total").over(everyone))
    )
    by_ratio = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    # the first source that the level does not fill sets it for all; if none does, all are full
    ratio = F.col("_full") / F.col("_w")
    candidate = F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), "source", level.alias("level"))
    return (
        rows.withColumn("_open", F.when(level * F.col("_w") <= F.col("_full"), candidate))
        .withColumn("_level", F.min("_open").over(everyone)["level"])
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_full"))
                    .otherwise(F.least(F.col("_full"), F.col("_level") * F.col("_w"))))
        .select("source", F.col("total").alias("source_size"), "target")
    )


def cuts(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """One row per source: how often it is taken whole, and where the rest is cut.

    ``sizes`` has a row per document: source, ``_place``, ``_size``.
    """
    ranges = materialize(
        sizes.groupBy("source", _ring(F.col(PLACE)).alias("range")).agg(F.sum(SIZE).alias("words"))
    )
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("total")), weights, share, epochs)
    budget = F.round("target").cast("long")
    goal = (
        goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("rest", budget - F.col("times") * F.col("source_size"))
    )
    goal = materialize(goal)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    g, r = sized(goal.select("source", "rest")).alias("g"), ranges.alias("r")
    border = (
        r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")))
        .filter("r.before < g.rest AND g.rest <= r.before + r.words")
        .select("r.source", "r.range", (F.col("g.rest") - F.col("r.before")).alias("left"))
    )
    border = sized(border)
    # the rows of one range of each source, in order of their places
    ties = sizes.groupBy("source", PLACE).agg(F.sum(SIZE).alias("words"), F.count("*").alias("copies"))
    t, b = ties.alias("t"), border.alias("b")
    inside = t.join(b, F.col("t.source").eqNullSafe(F.col("b.source")) & (_ring(F.col(f"t.{PLACE}")) == F.col("b.range")))
    walk = Window.partitionBy("t.source").orderBy(f"t.{PLACE}").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("_before", F.coalesce(F.sum("t.words").over(walk), F.lit(0)))
        .filter("_before < b.left AND b.left <= _before + t.words")
        .select("t.source", F.col(f"t.{PLACE}").alias("cut"),
                F.floor((F.col("b.left") - F.col("_before")) / F.col("t.copies")).alias("part"))
    )
    c = cut.alias("c")
    g = goal.alias("g")
    return materialize(
        g.join(c, F.col("g.source").eqNullSafe(F.col("c.source")), "left")
        .select("g.source", "g.source_size", "g.target", "g.times", "c.cut", "c.part")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, epochs: int = 3,
        seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    A source whose target exceeds its size is repeated: taken whole ``times`` over, then in
    part. The document on the cut gives only the words that are missing.
    """
    results = ("size", "source_size", "target", "taken")
    docs = docs.drop(*results)
    key = place(F.col(doc_id), F.col(text), seed)
    sizes = materialize(docs.select(
        F.col(source).alias("source"), key.alias(PLACE), word_count(F.col(text)).alias(SIZE)))
    plan = sized(cuts(sizes, weights, share, epochs).select(F.col("source").alias("_source"), F.struct(
        "source_size", "target", "times", "cut", "part").alias("_plan")))
    p = F.col("_plan")
    rest = (F.when(F.col(PLACE) < p["cut"], F.col(SIZE))
            .when(F.col(PLACE) == p["cut"], F.least(F.col(SIZE), p["part"])).otherwise(0))
    rows = docs.withColumn(PLACE, key).withColumn(SIZE, word_count(F.col(text)))
    return (
        rows.join(plan, rows[source].eqNullSafe(plan["_source"]))
        .withColumn("size", F.col(SIZE))
        .withColumn("source_size", p["source_size"])
        .withColumn("target", p["target"])
        .withColumn("taken", (p["times"] * F.col(SIZE) + F.coalesce(rest, F.lit(0))).cast("long"))
        .drop(PLACE, SIZE, "_source", "_plan")
    )
