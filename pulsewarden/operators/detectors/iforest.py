"""Isolation forest (Liu, Ting and Zhou): trees grown in parallel, scoring as a map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.scalars import clip01, nan_to_num, nan_to_num_array
from pulsewarden.operators.detectors.base import Detector
from pulsewarden.operators.percentiles import exact_percentile
from pulsewarden.session import materialize, spread

_HASH_SPACE = 1 << 31
_NODE = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


def rank_per_tree(df: DataFrame, n_rows: int, id_col: str, n_trees: int, sample: int, seed: int) -> DataFrame:
    """Rows that may be among the first ``sample`` of each tree, with their rank ``_w`` in it.

    A rank depends on the row's id alone, so the first rows of a union are the first of
    the parts' first rows. One hash says where a row stands among the rows of a tree, another
    which share of the trees see it there; in the other trees it stands behind all such rows.
    A row is hashed once, to see if any tree may have it, and only then once for each
    tree, so the cost per row does not depend on the number of trees in a large table. Some
    eight standard deviations more rows are offered than a tree keeps.
    """
    i = F.col(id_col)

    def draw(*salt) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *salt, i), F.lit(_HASH_SPACE))

    each = min(1.0, (sample + 8 * sqrt(sample) + 16) / max(n_rows, 1))
    any_tree = min(1.0, n_trees * each)
    seen = _HASH_SPACE // n_trees
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    row = draw(F.lit("row"))

    def rank(t: Column) -> Column:
        return F.when(draw(t) < seen, row).otherwise(_HASH_SPACE + draw(t))

    offered = seen if any_tree < 1 else max(seen, int(_HASH_SPACE * each))
    chosen = F.filter(trees, lambda t: draw(t) < offered)
    found = df.filter(row < int(_HASH_SPACE * any_tree)).withColumn("tree", F.explode(chosen))
    return found.withColumn("_w", rank(F.col("tree")))


def first_per_tree(ranked: DataFrame, id_col: str, n_trees: int, sample: int) -> DataFrame:
    """The first ``sample`` rows of each tree, numbered by ``_r``."""
    # trees are few bytes and much work: keep them apart
    lowest = F.row_number().over(Window.partitionBy("tree").orderBy("_w", id_col))
    return ranked.repartition(n_trees, "tree").withColumn("_r", lowest).filter(F.col("_r") <= sample)


def _grow(seed: int, sample: int):
    limit = max(1, ceil(log2(max(sample, 2))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.vstack(pdf["vector"].to_numpy())
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        number = 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            lo, hi = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) <= 1 or not len(varied):
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            f = int(rng.choice(varied))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = part[:, f] <= cut
            if left.all():  # the cut fell on the upper end
                cut = float(lo[f])
                left = part[:, f] <= cut
            nodes.append((tree, node, f, cut, number, number + 1, len(rows), depth))
            todo += [(number, rows[left], depth + 1), (number + 1, rows[~left], depth + 1)]
            number += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    return run


class _Forest:
    """Node arrays of all trees end to end, for vectorised descent."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree", sort=True)["node"].size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        offset = np.repeat(self.roots, sizes)
        leaf = nodes["feature"].to_numpy() < 0
        here = np.arange(len(nodes), dtype=np.int32)
        self.feature = np.where(leaf, 0, nodes["feature"]).astype(np.int32)
        self.threshold = np.where(leaf, np.inf, nodes["threshold"])
        self.left = np.where(leaf, here, nodes["left"] + offset).astype(np.int32)
        self.right = np.where(leaf, here, nodes["right"] + offset).astype(np.int32)
        self.length = np.where(leaf, nodes["depth"] + average_path(nodes["size"]), 0.0)
        self.levels = int(nodes["depth"].max())
        self.scale = float(average_path(sample)) * len(self.roots)

    def depth_score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """``−2^(−E[h]/c)`` of each row; a block of rows goes down all trees at once."""
        if not self.scale:
            return np.full(len(x), -0.5)
        # places as numpy's own index type and buffers used again: nothing is converted or allocated in a step
        child = np.stack([self.right, self.left], axis=1).ravel().astype(np.intp)
        feature, roots = self.feature.astype(np.intp), self.roots.astype(np.intp)
        total = np.empty(len(x))
        for start in range(0, len(x), block):
            part = np.ascontiguousarray(x[start:start + block])
            values, row = part.ravel(), (np.arange(len(part)) * x.shape[1])[:, None]
            at = np.repeat(roots[None, :], len(part), axis=0)
            other, value, threshold = np.empty_like(at), np.empty(at.shape), np.empty(at.shape)
            for _ in range(self.levels):
                feature.take(at, out=other, mode="clip")
                other += row
                values.take(other, out=value, mode="clip")
                self.threshold.take(at, out=threshold, mode="clip")
                at *= 2
                at += value <= threshold
                child.take(at, out=other, mode="clip")
                at, other = other, at
            total[start:start + block] = self.length.take(at, mode="clip").sum(axis=1)
        return -np.power(2.0, -total / self.scale)


@dataclass(frozen=True)
class ForestState:
    """Mergeable training state: rows (tree, _w, id, vector), at most trees * samples, and how many rows they stand for."""

    rows: DataFrame
    n: int


class IsolationForest(Detector):
    """Rows with the columns ``features`` (or one ``vector`` array) and a unique ``id_col``.

    The model table holds the nodes and, in a row with tree −1, the offset and the
    sample size.
    """

    model_name = "isolation_forest"

    def __init__(self, features: Sequence[str] | None = None, id_col: str = "id",
                 n_trees: int = DEFAULTS.n_trees, max_samples: int = DEFAULTS.max_samples,
                 contamination: float = DEFAULTS.contamination, seed: int = DEFAULTS.seed, min_rows: int = 10):
        self.features, self.id_col = list(features) if features else None, id_col
        self.n_trees, self.max_samples = n_trees, max_samples
        self.contamination, self.seed, self.min_rows = contamination, seed, min_rows
        self.model = None

    def _vector(self) -> Column:
        if self.features:
            return F.array(*[nan_to_num(F.col(f).cast("double")) for f in self.features])
        return nan_to_num_array(F.col("vector"))

    def train(self, df: DataFrame) -> DataFrame | None:
        """Grow the trees and set the offset so that ``contamination`` of the rows are anomalous.

        Fewer than ``min_rows`` rows train nothing.
        """
        rows = df.select(self.id_col, self._vector().alias("vector"))
        n = rows.count()
        if n < self.min_rows:
            return None
        sample = min(self.max_samples, n)
        ranked = rank_per_tree(rows, n, self.id_col, self.n_trees, sample, self.seed)
        nodes = self._grown(first_per_tree(ranked, self.id_col, self.n_trees, sample), sample)
        return self._with_offset(nodes, sample, rows)

    def sample_state(self, df: DataFrame) -> ForestState:
        """What training needs to know of ``df``: for each tree its first ``max_samples`` rows, and the number of rows."""
        rows = df.select(self.id_col, self._vector().alias("vector"))
        n = rows.count()
        ranked = rank_per_tree(rows, n, self.id_col, self.n_trees, self.max_samples, self.seed)
        kept = first_per_tree(ranked, self.id_col, self.n_trees, self.max_samples)
        return ForestState(materialize(kept.select("tree", "_w", self.id_col, "vector")), n)

    def merged(self, *states: ForestState) -> ForestState:
        """The state of all rows together: day after day, only the new day is read."""
        rows = states[0].rows
        for other in states[1:]:
            rows = rows.unionByName(other.rows)
        kept = first_per_tree(rows, self.id_col, self.n_trees, self.max_samples)
        return ForestState(materialize(kept.drop("_r")), sum(s.n for s in states))

    def train_from(self, state: ForestState, recent: DataFrame) -> DataFrame | None:
        """The trees of ``train`` on all rows behind ``state``; the offset comes from ``recent`` rows."""
        if state.n < self.min_rows:
            return None
        sample = min(self.max_samples, state.n)
        nodes = self._grown(first_per_tree(state.rows, self.id_col, self.n_trees, sample), sample)
        return self._with_offset(nodes, sample, recent.select(self.id_col, self._vector().alias("vector")))

    def _grown(self, drawn: DataFrame, sample: int) -> pd.DataFrame:
        grown = drawn.select("tree", "_r", "vector").groupBy("tree").applyInPandas(_grow(self.seed, sample), _NODE)
        # at most n_trees * (2 * sample - 1) nodes, whatever the table holds
        nodes = grown.toPandas()
        roots = nodes[nodes["node"] == 0]["size"]
        if len(roots) < self.n_trees or (roots < sample).any():  # row ids that repeat, or no luck at all
            raise ValueError(f"a tree has fewer than {sample} rows; is {self.id_col} unique?")
        return nodes

    def _with_offset(self, nodes: pd.DataFrame, sample: int, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        depth = spread(rows).select(self._depth(nodes, sample)(F.col("vector")).alias("value"))
        # the percentile reads its input several times; the scores are worked out once
        offset = exact_percentile(materialize(depth), 100.0 * self.contamination).first()["percentile"]
        head = pd.DataFrame([(-1, 0, -1, float(offset), -1, -1, sample, 0)], columns=list(nodes.columns))
        self.model = spark.createDataFrame(pd.concat([head, nodes], ignore_index=True), _NODE)
        return self.model

    @staticmethod
    def _depth(nodes: pd.DataFrame, sample: int):
        forest = _Forest(nodes, sample)

        @F.arrow_udf("double")
        def depth_score(vectors: pa.Array) -> pa.Array:
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            return pa.array(forest.depth_score(values.reshape(len(vectors), -1)) if len(vectors) else [], pa.float64())

        # marked so that a filter on the score does not run the trees a second time
        return depth_score.asNondeterministic()

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``raw_score`` (negative = anomalous), ``anomaly_score`` and ``is_anomaly``.

        The model is bounded by its tree and sample numbers and travels with the task.
        """
        model = self.model.toPandas()
        head = model[model["tree"] < 0].iloc[0]
        depth = self._depth(model[model["tree"] >= 0], int(head["size"]))
        raw = depth(self._vector()) - F.lit(float(head["threshold"]))
        return spread(df).withColumn("raw_score", raw).withColumns({
            "anomaly_score": clip01(0.5 - F.col("raw_score")),
            "is_anomaly": F.col("raw_score") < 0,
        })
