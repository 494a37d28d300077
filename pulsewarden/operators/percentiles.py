"""Exact percentiles without holding a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.session import materialize, sized

#: Cells that a cell is cut into, and cells for each doubling of a value.
BINS = 4096
PER_DOUBLING = 4
#: A cell with no more rows is counted by value.
FEW = 1 << 16


def magnitude_bin(x: Column) -> Column:
    """Cell of a double: sign and size on a scale of doublings, whatever the range of the data.

    Never falls as ``x`` grows, so a cell holds all values between any two of its own.
    """
    size = F.abs(x)
    step = F.floor((F.log2(size) + 1075) * PER_DOUBLING) + 1
    step = F.when(size == 0, 0).when(size == float("inf"), 2100 * PER_DOUBLING).otherwise(step)
    return F.when(x < 0, -step).otherwise(step).cast("long")


def _holding(counts: DataFrame, part: list[str], cell: str) -> DataFrame:
    """The cells of ``counts`` in which an order statistic k0 or k1 lies, and the rows ahead of them."""
    run = Window.partitionBy(*part).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("_ahead", F.col("_base") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
    return c.filter((F.col("_ahead") <= F.col("_k1")) & (F.col("_ahead") + F.col("_c") > F.col("_k0")))


def exact_percentile(df: DataFrame, q: float, value: str = "value", keys: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """Percentile ``q`` (0–100) with linear interpolation, per key; NaN and null do not count.

    Values are counted in cells: first by magnitude, so that no outlier can stretch a
    cell, then, while a wanted cell still has more than ``few`` rows, in ``BINS`` equal
    parts of it; at the end by value. All counts are combined on the map side. Of the
    cells, at most two per key are followed, and only those meet the rows again. What is
    never cut further is a cell with one distinct value: it is one count.

    Reads ``df`` once for each step, two steps for most data.
    """
    x = F.col(value).cast("double")
    key_cols = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    keys = list(keys) or ["_all"]
    rows = df.select(*key_cols, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    size = [F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]

    counts = materialize(rows.groupBy(*keys, magnitude_bin(F.col("_x")).alias("_cell")).agg(*size))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rank = (F.col("_n") - 1) * (q / 100.0)
    total = total.select(*keys, F.floor(rank).alias("_k0"), F.ceil(rank).alias("_k1"), (rank - F.floor(rank)).alias("_w"))
    counts = counts.join(total, keys).withColumn("_base", F.lit(0).cast("long"))
    carry = ["_k0", "_k1", "_w"]
    cells = sized(_holding(counts, keys, "_cell").select(*keys, *carry, "_lo", "_hi", "_c", F.col("_ahead").alias("_base")))

    def inside() -> DataFrame:
        """Rows in a followed cell. Cells of a key do not overlap."""
        if keys == ["_all"]:  # two cells at most: part of the plan, no join
            own = cells.drop("_all").withColumnRenamed("_c", "_rows").collect()
            if not own:
                return rows.join(cells.withColumnRenamed("_c", "_rows"), "_all").limit(0)
            found = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in own])
            return rows.select("*", F.inline(F.filter(found, lambda c: (F.col("_x") >= c["_lo"]) & (F.col("_x") <= c["_hi"]))))
        c = cells.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_c", "_rows")
        same = [rows[k].eqNullSafe(c[f"_k_{k}"]) for k in keys]
        within = (rows["_x"] >= c["_lo"]) & (rows["_x"] <= c["_hi"])
        on = within
        for s in same:
            on = s & on
        return rows.join(c, on).drop(*[f"_k_{k}" for k in keys])

    wide = (F.col("_c") > few) & (F.col("_lo") < F.col("_hi"))
    while not cells.filter(wide).isEmpty():
        # a border may round either way; the ends of a part are those of its values
        part = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BINS
        part = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(part), F.lit(BINS - 1))).otherwise(0)
        finer = inside().groupBy(*keys, *carry, "_base", F.col("_lo").alias("_from"), part.alias("_cell")).agg(*size)
        cells = sized(_holding(finer, [*keys, "_from"], "_cell").select(
            *keys, *carry, "_lo", "_hi", "_c", F.col("_ahead").alias("_base")))
    by_value = inside().groupBy(*keys, *carry, "_base", F.col("_lo").alias("_from"), "_x").agg(F.count("*").alias("_c"))
    picked = _holding(by_value, [*keys, "_from"], "_x")
    out = picked.groupBy(*keys).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.first("_w").alias("_w"))
    between = F.when(F.col("_x0") == F.col("_x1"), F.col("_x0")).otherwise(
        F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_w"))
    return out.select(*keys, between.alias("percentile")).drop("_all")


# ---- on streams ----------------------------------------------------------------

#: Size of a quantile sketch.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows by which a sketch's percentile may lie off its rank, with 99 % confidence.

    Fixed values: the fit that the sketch's authors publish for one rank.
    """
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, keys: Sequence[str | Column] = (), value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """One mergeable sketch (``sketch`` binary) of the values per key, NaN and null left out.

    Works on streams as well, grouped by a window: state is a few kilobytes for each key,
    whatever the number of rows.
    """
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.kll_sketch_agg_double(x, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Sketches of parts (days, windows) → those of the whole."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentile(sketches: DataFrame, q: float, name: str = "percentile") -> DataFrame:
    """Percentile ``q`` (0–100) of each sketch: a value that occurred, ``rank_error`` off its rank at most."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(q / 100.0))).drop("sketch")
