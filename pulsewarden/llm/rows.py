"""Row ids that stay the same when a table is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsewarden.session import materialize

#: Plan nodes below which rows keep their order from one reading to the next.
_STEADY = {"Project", "LogicalRelation", "SubqueryAlias"}


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only chooses or computes columns of files, by deterministic expressions."""
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        if node.getClass().getSimpleName() not in _STEADY or not node.deterministic():
            return False
        if node.children().size() == 0:
            return "HadoopFsRelation" in node.relation().getClass().getSimpleName()
        node = node.children().apply(0)


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """``df`` with a number for each row, the same whenever it is computed.

    Rows of a plain scan are numbered by their place; anything else (a shuffled, limited or
    joined frame, whose rows may come in another order on another reading) is written first.
    """
    rows = df if is_scan(df) else materialize(df)
    return rows.withColumn(name, F.monotonically_increasing_id())


#: Bits of the filter of ``maybe_in``, in longs: 2^17 rows of two numbers.
FILTER_BITS = 23


def maybe_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``ids`` (one column).

    For a join that would otherwise move wide rows only to lose them: all rows with an id stay,
    a few others may. The filter has a fixed size whatever the number of ids, and is broadcast;
    the more ids, the more others stay.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).cast("int")
    hashed, row, bits = "_filter_hash", "_filter_row", "_filter_bits"  # not names that a caller would have
    named = ids.select(h(ids.columns[0]).alias(hashed))
    filled = materialize(named.groupBy(F.shiftright(hashed, 6).alias(row)).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {hashed} & 63)")).alias(bits)))
    kept = rows.withColumn(hashed, h(column)).withColumn(row, F.shiftright(hashed, 6)).join(F.broadcast(filled), row)
    return kept.filter(f"shiftright({bits}, {hashed} & 63) & 1 = 1").select(*rows.columns)


#: Bits of the number of rows that a row of the table of ``only_in`` tells apart.
BLOCK_BITS = 12


def only_in(rows: DataFrame, rids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among ``rids`` (one column, numbers of ``with_rid``), exactly, none of them moved.

    The numbers go as bits, some two for each row of the table they come from, and are broadcast: a
    thousandth of texts of some hundred bytes.
    """
    block, word, bits, held = "_rid_block", "_rid_word", "_rid_bits", "_rid_held"  # not names that a caller would have
    place = lambda c: ((F.shiftright(c, 6) % (1 << BLOCK_BITS - 6)).cast("int"))
    bit = lambda c: f"shiftleft(1L, cast({c} & 63 AS int))"
    name = rids.columns[0]
    words = rids.groupBy(F.shiftright(name, BLOCK_BITS).alias(block), place(name).alias(word)).agg(F.bit_or(F.expr(bit(f"`{name}`"))).alias(bits))
    table = materialize(words.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct(word, bits))).alias(held)))
    found = rows.withColumn(block, F.shiftright(column, BLOCK_BITS)).join(F.broadcast(table), block)
    return found.withColumn(word, place(column)).filter(f"{held}[{word}] & {bit(f'`{column}`')} <> 0").select(*rows.columns)
