"""Skew-proof ordering: positions, neighbours and newest rows per key.

A plain window over ``partitionBy(key)`` puts a whole key in one task. Here the
rows are range-partitioned on (key, order) by Spark, numbered by place, and cut
into chunks of equal length. Each chunk also receives copies of the last
``before`` rows ahead of it (and the first ``after`` rows behind it), so any
bounded row frame can be evaluated inside the group (key, chunk) however many
rows the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsewarden.session import materialize, sized

KEYS = ("server_id", "name")
ORDER = ("timestamp", "seq")

CHUNK = "_chunk"
HOME = "_home"
POS = "_g"
PART = "_part"

#: Bytes of the rows of a partition, before compression.
PARTITION_BYTES = 96 << 20

_PLACE_BITS = 33  # monotonically_increasing_id keeps the row's place in the low 33 bits


def ordered(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``_g``, the row's place (0, 1, 2 …) in the global (keys, order) sort.

    Rows of one key are contiguous in ``_g``.
    """
    return placed(df, keys, order)[0]


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with their place, and how many there are.

    The range-partitioned rows are written once, so that the partition sizes and the
    rows come from the same partitioning. Only the sizes, one number per partition,
    pass through the driver.
    """
    cols = [*keys, *order]
    # the scan position splits even a long run of equal rows
    written = materialize(
        df.withColumn("_scan", F.monotonically_increasing_id())
        .repartitionByRange(*cols, "_scan")
        .sortWithinPartitions(*cols)
        .drop("_scan")
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _PLACE_BITS)
    sizes = sorted(written.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for r in sizes:
        starts.append((r["p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_file long, _start long")
    place = F.col("_mid").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    rows = (
        written.withColumn("_file", part)
        .join(F.broadcast(offsets), "_file")
        .withColumn(POS, F.col("_start") + place)
        .drop("_file", "_start", "_mid")
    )
    return rows, total


def numbered(df: DataFrame, name: str = "rn", keys: Sequence[str] = KEYS,
             order: Sequence[str] = ORDER) -> DataFrame:
    """Number the rows of each key from 1, without a window over the key."""
    rows = ordered(df, keys, order)
    starts = sized(rows.groupBy(*keys).agg(F.min(POS).alias("_first")))
    return rows.join(starts, list(keys)).withColumn(name, F.col(POS) - F.col("_first") + 1).drop(POS, "_first")


def layout(total: int, width: int, cores: int, least: int, chunk_rows: int) -> tuple[int, int, int]:
    """Rows of a chunk, chunks of a partition, and partitions, for ``total`` rows of ``width`` bytes.

    Chunks are small enough to give each core two, down to 1024 rows or ``least``; partitions
    hold ``PARTITION_BYTES``, or less where the cores would run out of work.
    """
    size = max(least, min(chunk_rows, max(1024, -(-total // (2 * cores)))))
    chunks = max(1, -(-total // size))
    per = max(1, min(PARTITION_BYTES // (max(1, width) * size), chunks // (2 * cores)))
    return size, per, -(-chunks // per)


def chunked(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows near a chunk border appear in both chunks.

    Chunks are stretches of the global order, and a partition holds neighbouring ones, so all
    partitions hold the same number of rows and none is empty. Evaluate windows over
    ``chunk_window(keys)`` and keep only ``_home`` rows.
    """
    return chunks_of(*placed(df, keys, order), before, after, chunk_rows)


def chunks_of(rows: DataFrame, total: int, before: int, after: int, chunk_rows: int) -> DataFrame:
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size, per, parts = layout(total, rows._jdf.schema().defaultSize(), cores, 4 * (before + after) + 1, chunk_rows)
    place, chunk = F.col(POS) % size, F.floor(F.col(POS) / size)
    last = max(0, (total - 1) // size)
    targets = F.filter(
        F.array(
            F.lit(0),
            F.when((place >= size - before) & (chunk < last), F.lit(1)),
            F.when((place < after) & (chunk > 0), F.lit(-1)),
        ),
        lambda t: t.isNotNull(),
    )
    return (
        rows.withColumn("_to", F.explode(targets))
        .withColumn(CHUNK, chunk + F.col("_to"))
        .withColumn(HOME, F.col("_to") == 0)
        .withColumn(PART, F.floor(F.col(CHUNK) / per).cast("int"))
        .drop("_to")
        .repartitionById(parts, PART)
    )


def chunk_window(keys: Sequence[str] = KEYS) -> WindowSpec:
    # the partition is part of the grouping, so that the rows need not move again
    return Window.partitionBy(PART, *keys, CHUNK).orderBy(POS)


def home(df: DataFrame) -> DataFrame:
    """Keep each row's own chunk and drop the helper columns."""
    return df.filter(HOME).drop(CHUNK, HOME, POS, PART)


def first_per_key(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], rank: str | None = None,
    keep_apart: bool = False,
) -> DataFrame:
    """The first ``n`` rows of each key, so that no key meets in one task.

    Up to Spark's window group limit each map task already drops what cannot be among
    the first n. Rows are ranked per key and salt, and only the survivors per key. The
    salt is the input split, so a task holds one salt.

    ``keep_apart`` fixes the number of partitions for costly work per key: coalescing
    by bytes would put many keys in one task.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    inner = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    kept = salted.withColumn("_r", inner).filter(F.col("_r") <= n).drop("_r", "_salt")
    if keep_apart:
        kept = kept.repartition(salts, *keys)
    name = rank or "_r"
    outer = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = kept.withColumn(name, outer).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def newest(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], rank: str | None = None,
    keep_apart: bool = False,
) -> DataFrame:
    """The newest ``n`` rows of each key; ``rank`` names a column counting from the newest."""
    return first_per_key(df, n, keys, [F.col(c).desc() for c in order], rank, keep_apart)
