"""A corpus pipeline: each stage reads what the one before has written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Nulls, empty texts, repeated rows and empty tables are taken as
the operators say; a document without a word passes the stages on repeats and leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsewarden.llm import decontam, language, mixing, ngramjoin, winnow
from pulsewarden.llm.rows import is_scan, with_rid
from pulsewarden.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Cosine that a text shares with a language by chance: the standard deviation is 1/32.
CHANCE = 0.05
#: Random letters share more, the longer the text: of m letters and gaps, up to LETTERS * m / (m + HALF) beyond
#: CHANCE. Of 25 to 1000 random words, at most one text in twenty lies higher (four languages, sf0.01);
#: shorter ones can't be told from clean texts as short, which lie at 0.1 and more.
LETTERS, HALF = 0.12, 60


def by_chance(text: Column) -> Column:
    """Cosine up to which a text is no closer to a language than random letters."""
    m = F.length(F.regexp_replace(text, r"\P{L}+", " "))
    return F.lit(CHANCE) + LETTERS * m / (m + HALF)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no closer to any language than by chance."""
    rows = language.identify(docs)
    # no chance reaches the sum of both: most texts are beyond it, and their letters need not be counted
    beyond = (F.col("score") >= CHANCE + LETTERS) | (F.col("score") > by_chance(F.col("text")))
    return rows.filter((F.col("lang_pred") != language.UND) & beyond).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents that were nothing else."""
    rows = winnow.dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & (mixing.word_count(F.col("text")) == 0)
    return rows.filter(~empty).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a similarity of 0.8, that with the smallest id stays."""
    docs = docs if is_scan(docs) else materialize(docs)
    groups = ngramjoin.link_documents(docs, words=5, percent=80)
    first = groups.filter("first").select("rid")
    # the rids of link_documents: places in the same table
    return with_rid(docs).join(first, "rid", "left_semi").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_leaks(docs, items).filter(F.size("leaks") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with the words that it gives, repeats counted (0: it is not taken)."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("line_dedup", without_repeated_lines),
    ("jaccard", one_of_each_group),
    ("decontamination", without_leaks),
    ("mix", mixed),
]

#: Language, edit distance and hashes can't be said in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
