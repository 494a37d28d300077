"""Groups of linked documents against brute force."""

import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulsewarden.llm import ngramjoin
from pulsewarden.llm.rows import only_in

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def sets(rows, n):
    out = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append({tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, n, percent):
    s = sets(rows, n)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = {g: min(ids, key=lambda x: (x is None, x or 0)) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(s[i]), least[root(i)]) for i in range(len(rows))), key=str)


def near_copies(seed, families, size, vocabulary=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    rows = []
    shared = " ".join(word() for _ in range(12))
    for _ in range(families):
        base = [word() for _ in range(r.randint(8, 90))]
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                k = r.randrange(len(w))
                w[k: k + r.choice([0, 1, 1])] = [word().upper()] if r.random() < 0.8 else []
                w = w or ["x"]
            rows.append((len(rows), " ".join(w) + (" " + shared if r.random() < 0.3 else "")))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, percent, limits", [
    (1, 3, 90, {}),
    (6, 3, 90, {"cover": 5}),
    (2, 3, 90, {"frequent": 2, "paired": 6, "block": 4, "cover": 3}),
    (3, 3, 80, {"frequent": 3, "paired": 12, "block": 3, "cover": 2}),
    (4, 5, 80, {"frequent": 1, "paired": 30, "block": 8}),
    (5, 3, 90, {"frequent": 2, "paired": 100, "block": 5}),
])
def test_groups_equal_brute_force(make_docs, odd, seed, words, percent, limits):
    rows = near_copies(seed, 14, 14) + [(10_000 + (i or 0) if i is not None else None, t) for i, t in odd]
    got = ngramjoin.link_documents(make_docs(rows), words, percent, **limits)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert found == brute(rows, words, percent)


def test_one_row_of_each_group_is_first(make_docs):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "A b c d e"), (2, "")] * 2
    got = ngramjoin.link_documents(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in got if r["first"]) == [1, 2, 2]


def test_empty_table_and_clashing_columns(make_docs):
    assert ngramjoin.link_documents(make_docs([])).count() == 0
    docs = make_docs([(1, "a b c d"), (2, None)]).selectExpr("*", "7 AS rid", "8 AS first", "9 AS component_id", "1 AS size", "2 AS class")
    got = ngramjoin.link_documents(docs)
    assert sorted(got.columns) == sorted(["doc_id", "lang", "source", "n_chars", "size", "class", "rid", "n_shingles", "component_id", "first"])
    assert sorted(r["component_id"] for r in got.collect()) == [1, 2]


def test_products_of_long_sets_are_bounded():
    sketch = [np.arange(k, 2_560_000, 128) for k in range(128)]  # 20 000 numbers each, none in common
    sketch[127] = sketch[3].copy()
    n, last = np.full(128, 20_000), np.array([x[-1] << 32 for x in sketch])
    tracemalloc.start()
    found = ngramjoin._left_over(-1, np.arange(128), np.ones(128, bool), n, last, sketch, 90)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {3, 127} <= {member for _, member in found}
    assert peak < 400 << 20  # 128 sets by all tokens take 1.3 GB


def test_shards_follow_the_sketches(make_docs, monkeypatch):
    rows, seen, cover_keys = near_copies(2, 14, 14), [], ngramjoin.cover_keys
    monkeypatch.setattr(ngramjoin, "cover_keys", lambda r, p, shards: seen.append(shards) or cover_keys(r, p, shards))
    limits = {"frequent": 2, "paired": 6, "block": 4, "cover": 3}
    for held, wide in ((1 << 22, 1 << 13), (10, 16)):
        monkeypatch.setattr(ngramjoin, "HELD", held)
        monkeypatch.setattr(ngramjoin, "WIDE", wide)
        got = ngramjoin.link_documents(make_docs(rows), 3, 90, **limits)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute(rows, 3, 90)
    assert seen[1] > 2 * seen[0]


def test_texts_that_share_passages_but_do_not_link_have_few_keys(make_docs, monkeypatch):
    """Each two of 20 texts share a passage of their own: most tokens of a prefix lie in another one too."""
    passage = {(i, j): " ".join(f"w{i}x{j}x{k}" for k in range(30)) for i in range(20) for j in range(i)}
    rows = [(i, " ".join(passage[max(i, j), min(i, j)] for j in range(20) if j != i)) for i in range(20)]
    counts, stars = [], ngramjoin.stars
    monkeypatch.setattr(ngramjoin, "stars", lambda keys, *a: counts.append(keys.count()) or stars(keys, *a))
    got = ngramjoin.link_documents(make_docs(rows))
    assert all(r["component_id"] == r["doc_id"] for r in got.collect())
    assert counts[0] <= 20


@pytest.mark.parametrize("percent, limits", [(50, {"frequent": 2, "paired": 10, "cover": 3}), (66, {}), (70, {"frequent": 1, "paired": 12}), (95, {"block": 4})])
def test_groups_by_runs_and_by_tokens(make_docs, odd, percent, limits):
    """Sets that runs don't fit are indexed by tokens, and meet those they fit."""
    rows = near_copies(7, 10, 10) + [(10_000 + (i or 0) if i is not None else None, t) for i, t in odd]
    got = ngramjoin.link_documents(make_docs(rows), 3, percent, **limits)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert found == brute(rows, 3, percent)


def test_sets_that_link_share_a_run():
    """Whatever tokens differ, also if they are the first ones."""
    r, linked = random.Random(1), 0

    def keys(x, percent):
        n, uses, out = np.array([len(x)]), ngramjoin.run_lengths(len(x), percent)[:, len(x)], set()
        for g in range(2, ngramjoin.RUN + 1):
            if uses[g - 1]:
                end = int(ngramjoin.run_reach(n, g, percent)[0])
                out |= {tuple(x[i: i + g]) for i in range(max(0, end - g + 1))}
        return out, uses[0]

    for _ in range(6000):
        percent, n = r.choice((70, 80, 90, 95)), r.randint(1, 120)
        a = sorted(r.sample(range(10_000), n))
        b = list(a)
        for _ in range(r.randint(0, int(ngramjoin.differ(np.array(n), percent)) + 2)):
            if r.random() < 0.5 and len(b) > 1:
                b.pop(int(r.random() ** 3 * len(b)))
            else:
                b.append(r.random() ** 3 * 10_000)
        b = sorted(set(b))
        if a != b and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
            linked += 1
            (x, by_token), (y, also) = keys(a, percent), keys(b, percent)
            assert x & y or (by_token and also)
    assert linked > 1000


def test_prefixes_are_written_as_short_as_pairs_of_sets_need(make_docs, monkeypatch):
    """The runs that sets are indexed by reach over three quarters of them, and come from the texts."""
    r, held, linked_classes = random.Random(5), [], ngramjoin.linked_classes
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(204))) for i in range(20)]
    rows += [(20, rows[3][1] + " more"), (21, rows[3][1])]
    monkeypatch.setattr(ngramjoin, "linked_classes", lambda docs, sets, *a, **k: held.extend(
        len(x["prefix"]) for x in sets.collect()) or linked_classes(docs, sets, *a, **k))
    got = ngramjoin.link_documents(make_docs(rows), words=5, percent=80)
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()), key=str) == brute(rows, 5, 80)
    assert len(held) == 21 and max(held) <= 43


def test_rows_are_chosen_exactly(spark):
    ids = [0, 1, 63, 64, 4095, 4096, (1 << 33) - 1, 1 << 33, (5 << 33) + 4097]
    rows = spark.createDataFrame([(i, i % 7) for i in [*range(5000), *ids[5:], 6 << 33]], "rid long, _rid_other long")
    got = only_in(rows, spark.createDataFrame([(i,) for i in ids + ids], "class long"), "rid")
    assert got.columns == rows.columns
    assert sorted(r["rid"] for r in got.collect()) == sorted(ids + [4096])
    assert only_in(rows, spark.createDataFrame([], "class long"), "rid").count() == 0


@pytest.mark.parametrize("meet, cover", [(1 << 18, 256), (7, 256), (7, 2)])
def test_a_centres_sketches_go_once_to_each_part_of_its_keys(make_docs, monkeypatch, meet, cover):
    rows, seen, cover_keys = near_copies(2, 14, 14), [], ngramjoin.cover_keys
    monkeypatch.setattr(ngramjoin, "MEET", meet)
    monkeypatch.setattr(ngramjoin, "COVER", cover)
    monkeypatch.setattr(ngramjoin, "cover_keys", lambda r, p, shards: seen.extend(
        x[0] for x in r.filter("sketch IS NOT NULL").groupBy("centre", "part", "class").count().select("count").collect()) or cover_keys(r, p, shards))
    got = ngramjoin.link_documents(make_docs(rows), 3, 90, frequent=2, paired=6, block=4, cover=3)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute(rows, 3, 90)
    assert seen and set(seen) == {1}


class Table:
    """Stands for the rows of an operator, and gives the function that it runs on a group of them."""

    def __init__(self, spark):
        self.sparkSession = spark

    withColumn = repartition = groupBy = lambda self, *a: self

    def applyInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("most", [2048, 300])
def test_sets_of_many_keys_are_tried_once(spark, monkeypatch, most):
    """700 sets of one centre meet in 40 keys, each with a tenth missing; the centre links with every other one."""
    r, n, keys, tried, may_link = np.random.default_rng(1), 700, 40, [], ngramjoin._may_link
    monkeypatch.setattr(ngramjoin, "SETS", most, raising=False)
    monkeypatch.setattr(ngramjoin, "_may_link", lambda size, *a: tried.append(len(size)) or may_link(size, *a))
    family = r.integers(0, 5, n)
    sketch = [np.sort(np.concatenate([np.arange(50) + 1000 * f, 10_000 + 7 * k + np.arange(3)])).astype(np.int32) for k, f in enumerate(family)]
    inside = r.random((keys, n)) < 0.9
    key, name = np.nonzero(inside)
    column = lambda values, kind, rest: pa.array([*values, *[None] * rest], kind)
    rows = pa.table({
        "centre": pa.array([-1] * (len(key) + n), pa.int64()), "part": pa.array([0] * (len(key) + n), pa.int32()),
        "key": column(key.tolist(), pa.int64(), n), "class": pa.array([*name.tolist(), *range(n)], pa.int64()),
        "tied": column((name % 2 == 0).tolist(), pa.bool_(), n), "a": column([0] * len(key), pa.int32(), n), "b": column([0] * len(key), pa.int32(), n),
        "size": pa.array([None] * len(key) + [53] * n, pa.int32()), "last": pa.array([None] * len(key) + [int(x[-1]) << 32 for x in sketch], pa.int64()),
        "sketch": pa.array([None] * len(key) + [x.tolist() for x in sketch], pa.list_(pa.int32()))})
    stars = defaultdict(set)
    for centre, member in zip(*ngramjoin.cover_keys(Table(spark), 80, 1)(rows).to_pydict().values()):
        stars[centre].add(member)
    stars[-1] |= set(range(0, n, 2))  # those that may link with the centre are in its star
    may = may_link(np.full(n, 53), np.array([int(x[-1]) << 32 for x in sketch]), sketch, 80)
    may &= (inside.T.astype(int) @ inside.astype(int)) > 0
    together = np.zeros((n, n), bool)
    for star in stars.values():
        own = np.array(sorted(star - {-1}))
        together[np.ix_(own, own)] = True
    loose = np.arange(n) % 2 == 1
    assert not (may & ~together & (loose[:, None] | loose[None, :])).any()
    assert may.any()
    if most > n:
        assert tried == [n]  # not once for each key


def test_keys_are_moved_in_packs(make_docs, monkeypatch):
    """A row is a shard's keys of many texts, not a key."""
    rows, packs, with_others = near_copies(9, 14, 14, 2000), [], ngramjoin.with_others
    monkeypatch.setattr(ngramjoin, "with_others", lambda packed: packs.append(packed) or with_others(packed))
    got = ngramjoin.link_documents(make_docs(rows, 1), 3, 90)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute(rows, 3, 90)
    spark, held = got.sparkSession, pa.table({
        "shard": pa.array([0, 0], pa.int32()), "keys": pa.array([np.array([5, 7, 7, -2]).tobytes(), np.array([5, 9]).tobytes()], pa.binary()),
        "names": pa.array([np.array([1, 2, 3, 4]).tobytes(), np.array([6, 8]).tobytes()], pa.binary())})
    found = with_others(Table(spark))(held).to_pydict()
    assert sorted(zip(found["key"], found["class"])) == [(5, 1), (5, 6), (7, 2), (7, 3)]
    assert packs and dict(packs[0].dtypes) == {"shard": "int", "keys": "binary", "names": "binary"}
