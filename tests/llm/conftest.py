import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """A table of documents from rows (doc_id, text[, lang[, source]])."""
    count = iter(range(10**6))

    def make(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / str(next(count)))
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    return make


#: Rows that every operator must take: nulls, empty and blank texts, one word, repeats, ties.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (5, "two words"), (None, "no id at all"),
    (None, None), (6, "Ünïcödé ñandú ß 北京 \U0001f600"), (6, "same id, other text"), (7, "a\x00b\x0bc\x0cd"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
