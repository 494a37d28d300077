"""Hard negatives against all products in plain integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from pulsewarden.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, percent=80, positives=5, negatives=5, anchor=lambda i: i is not None and i % 100 == 0):
    clip = lambda x, b: max(-b, min(b - 1, x))
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [max(-2**61, min(2**61, math.floor(x * 256) if abs(x) < 1e300 else int(math.copysign(2**61, x)))) for x in v], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(use):
        if not anchor(i):
            continue
        scored = [(clip(sum(a * b for a, b in zip(v, w)), 2**63), j, other) for n, (j, w, other) in enumerate(use) if n != k and len(w) == len(v)]
        for p in sorted([s for s in scored if s[2] == label], key=order)[:positives]:
            fit = [s for s in scored if s[2] != label and percent * p[0] <= 100 * s[0] <= 100 * p[0]]
            for rank, q in enumerate(sorted(fit, key=order)[:negatives], 1):
                out.append((i, p[1], rank, q[1], p[0], q[0]))
    return sorted(out, key=str)


def found(df, **limits):
    return sorted((tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0, **limits).collect()), key=str)


def cloud(seed, n, d, labels=4):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    out = []
    for i in range(n):
        k = r.randrange(labels)
        out.append((i, [float(np.float32(m + r.gauss(0, 0.8))) for m in middles[k]], k if r.random() < 0.7 else r.randrange(labels)))
    return out


@pytest.mark.parametrize("limits", [{}, {"anchors": 2, "rows": 90}])
def test_equals_all_products(spark, limits):
    rows = cloud(1, 900, 8)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), **limits) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5], i % 3) for i in range(0, 30)]  # ties
    rows += [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (200, [1.0, 0.25], 2), (300, None, 1), (400, [1.0, None], 1), (500, [nan, 1.0], 1),
             (600, [1.0, inf], 1), (700, [1.0, 2.0], None), (None, [1.0, 0.5], 0), (800, [], 1), (801, [], 1), (802, [], 2),
             (900, [1.0, 2.0, 3.0], 0), (901, [-1.0, 0.1, 0.0], 0), (902, [0.0, 0.0, 0.0], 1), (1000, [-1.0, -2.0], 5), (1001, [1.0, 2.0], 5),
             (1100, [0.0, 0.0], 6), (1101, [3.0, 1.0], 6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rid", "2 AS id", "3 AS v", "4 AS rank", "5 AS asks", "6 AS block")
    got = found(df)
    assert got == brute(rows) and got
    assert found(spark.createDataFrame([], SCHEMA)) == []
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    assert found(spark.createDataFrame(rows, schema)) == brute(rows)


def test_products_are_exact_at_any_width():
    r = np.random.default_rng(3)
    for bits in (1, 3, 8, 12, 14, 20, 31, 45, 61):
        for d in (0, 1, 7, 300):
            a = r.integers(-2**bits, 2**bits, (4, d), endpoint=True)
            b = r.integers(-2**bits, 2**bits, (37, d), endpoint=True)
            want = [[max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
            assert hardneg.products(a, b).tolist() == want


def test_large_components_and_long_vectors(spark):
    r = random.Random(5)
    rows = [(100 * i if i % 4 == 0 else i, [r.uniform(-1, 1) * 10.0**r.choice([3, 9, 16]) for _ in range(3)], i % 3) for i in range(60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    long = [(i * 50, [r.uniform(-1, 1) for _ in range(3000)], i % 2) for i in range(40)]
    assert found(spark.createDataFrame(long, SCHEMA)) == brute(long)


def test_the_query_equals_plain_products(spark, sf):
    from pulsewarden.llm import queries

    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_hard_negatives"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
