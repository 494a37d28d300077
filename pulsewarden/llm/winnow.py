"""Line dedup: winnowing over line hashes, extended to whole repeated runs.

A line's hash is that of its text without outer blanks; lines without a word take no part.
A window is the shortest run of lines from a line onwards (or back from it) with at least
``min_words`` words, so it depends on nothing but its own lines. The smallest line hash of
a window is its fingerprint (the first, if equal): every repeated run of ``min_words`` words
or more holds a whole window, hence the same fingerprint at the same line. Fingerprints
that lie at one position only are dropped, in the tasks that count them and behind; documents
without any other are done. In what is left the fingerprints' positions are joined to the
windows around them, which extends a match both ways from the fingerprint to the window's ends;
windows with equal lines meet in one row. All but the first in document order are later
repeats, and overlapping ones make up the maximal repeated runs, whose lines are deleted.

So a line goes if and only if it is part of a run of at least ``min_words`` words that
also occurs earlier: in a document with a smaller id, or further up in the same one.

Nothing is joined pairwise: a passage in n documents is n rows that are counted where
they lie. Line hashes, not texts, are shuffled, and texts once to cut them.

Defined results
    null text: kept null, 0 lines. Null ids come last; equal ids follow each other by text.
    Empty table: empty result. Repeated rows: all but one lose their runs.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsewarden.llm.mixing import word_count
from pulsewarden.llm.rows import maybe_in, with_rid
from pulsewarden.session import materialize

MIN_WORDS = 50

LINES = "_lines"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: _row, place (order of documents), pos, nth, h, from_word, to_word."""
    spaces = F.lit(" \t\n\x0b\x0c\r")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.xxhash64("_text").alias("h"), F.col("_row").alias("r"))
    # what a text has once is worked out before its lines are
    cut = docs.select("_row", place.alias("place"), _lines(F.col("_text")).alias("lines"))
    lines = (
        cut.select("_row", "place", F.posexplode("lines").alias("pos", "line"))
        .withColumn("bare", F.trim("line", spaces)).filter("bare <> ''")
        .select("_row", "place", "pos", F.xxhash64("bare").alias("h"), F.xxhash64(F.lit(1), "bare").alias("g"), word_count(F.col("bare")).alias("words"))
    )
    upto = Window.partitionBy("_row").orderBy("pos")
    return (
        lines.withColumn("to_word", F.sum("words").over(upto))
        .withColumn("from_word", F.col("to_word") - F.col("words"))
        .withColumn("nth", F.row_number().over(upto))
    )


def _windows(min_words: int) -> tuple[WindowSpec, WindowSpec]:
    """Frames of the window onwards from a line, and back from it, as ranges of word numbers."""
    onwards = Window.partitionBy("_row").orderBy("from_word").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("_row").orderBy("to_word").rangeBetween(-(min_words - 1), 0)
    return onwards, back


def _windowed(lines: DataFrame, min_words: int, **wanted: Column) -> DataFrame:
    """Windows from both of their ends: _row, place, w (fingerprint and its position, and ``wanted`` over the lines)."""
    out = lines
    for name, w in zip(("_f", "_b"), _windows(min_words)):
        out = out.withColumn(name, F.when(F.sum("words").over(w) >= min_words, F.struct(
            F.min(F.struct("h", "pos")).over(w).alias("finger"), *[c.over(w).alias(k) for k, c in wanted.items()])))
    return out.select("_row", "place", F.explode(F.array("_f", "_b")).alias("w")).filter("w IS NOT NULL")


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The selected positions, each once: _row, at, finger. Fewer than the lines."""
    chosen = _windowed(lines, min_words).select("_row", F.col("w.finger.pos").alias("at"), F.col("w.finger.h").alias("finger"))
    return chosen.distinct()


def repeated(positions: DataFrame) -> DataFrame:
    """The positions whose fingerprint lies at another one too."""
    several = positions.groupBy("finger").agg(F.count("*").alias("n")).filter("n > 1").select("finger")
    return positions.join(several, "finger")


def window_table(lines: DataFrame, positions: DataFrame, min_words: int) -> DataFrame:
    """The windows around ``positions``: fingerprint, both ends, and a hash of the lines."""
    windows = _windowed(
        lines, min_words, a=F.min("pos"), b=F.max("pos"), from_nth=F.min("nth"), to_nth=F.max("nth"), run=F.collect_list("g"))
    windows = windows.select("_row", "place", "w.a", "w.b", "w.from_nth", "w.to_nth", F.col("w.finger.h").alias("finger"),
                             F.col("w.finger.pos").alias("at"), F.xxhash64("w.run").alias("extension"))
    # a window may be found from both of its ends
    return windows.join(positions, ["_row", "at", "finger"], "left_semi").distinct()


def repeats(windows: DataFrame) -> DataFrame:
    """The windows that are not the first with their lines: _row, a, b, from_nth, to_nth."""
    first = (
        windows.groupBy("finger", "extension")
        .agg(F.min(F.struct("place", "a")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    return (
        windows.join(first, ["finger", "extension"])
        .filter(F.struct("place", "a") != F.col("first"))
        .select("_row", "a", "b", "from_nth", "to_nth")
    )


def runs(found: DataFrame) -> DataFrame:
    """Per document the lines to delete, as runs without a kept line with a word: _row, runs array<struct<a,b>>."""
    w = Window.partitionBy("_row").orderBy("a", "b")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("from_nth") > F.max("to_nth").over(before) + 1, F.lit(True))
    return (
        found.withColumn("_new", starts.cast("int"))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy("_row", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cut, and n_lines, n_removed (lines).

    Blank lines between deleted ones go with them.
    """
    docs = with_rid(docs.drop("n_lines", "n_removed"), "_row")
    slim = docs.select("_row", F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    positions = materialize(repeated(materialize(fingerprints(line_table(slim), min_words))))
    some = maybe_in(slim, positions.select("_row").distinct(), "_row")  # others have no position to be joined to
    windows = materialize(window_table(line_table(some), positions, min_words))
    cut = runs(repeats(windows))
    lines = _lines(F.col(text))
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    return (
        docs.join(cut, "_row", "left")
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.aggregate(
            "runs", F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"] + 1)), F.lit(0).cast("long")))
        .withColumn(text, F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept)))
        .drop("_row", "runs")
    )
