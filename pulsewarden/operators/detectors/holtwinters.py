"""Holt-Winters with additive trend and season, one model per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.scalars import nan_to_num
from pulsewarden.operators.detectors.base import Detector
from pulsewarden.operators.detectors.smoothing import Homogeneous, Smooth, back, padded, run
from pulsewarden.operators.ordering import POS, newest, numbered, ordered
from pulsewarden.session import drop, materialize, sized

KEYS = ("server_id", "name")
_MODEL = (
    "level double, trend double, season array<double>, n int, m int, resid_std double, sse double, "
    "alpha double, beta double, gamma double"
)


def season_of(n: int, seasonal_periods: int) -> int | None:
    """Length of the season for ``n`` points; None if there are too few for two."""
    m = seasonal_periods if n >= 2 * seasonal_periods else max(2, n // 2)
    return m if n >= 2 * m else None


ROUNDS, STEPS = 4, 5
#: Points of a series that is fitted whole, and numbers of a matrix that series are fitted in together.
BLOCK, IN_STEP = 1 << 16, 1 << 22
#: Points, and seasons, that a block of a longer series holds: what is handed on of a block (two
#: states at each point of the grid) is bounded by its points. Errors kept of blocks in step.
STRETCH, SEASONS, KEPT = 1 << 12, STEPS**3, 1 << 23


def grid(centre: np.ndarray, reach: float) -> np.ndarray:
    """Points around ``centre`` (…, 3)."""
    axis = np.linspace(-reach, reach, STEPS)
    return np.clip(centre + np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3), 0.0, 1.0)


def fit_group(series: list[np.ndarray], m: int) -> list[dict]:
    """The models of some series with seasons of ``m`` points, fitted in step.

    The smallest squared error over a coarse grid, refined around each series' best point.
    """
    y, lengths, by = padded(series)
    n = len(y)
    best, least, reach = np.full((n, 3), 0.5), np.full(n, np.inf), 0.49
    for _ in range(ROUNDS):
        params = grid(best[:, None], reach)
        sse = _sums(y, lengths, params, m).sse
        k = sse.argmin(1)
        own = sse[np.arange(n), k]
        better = own < least
        best[better], least[better] = params[np.arange(n), k][better], own[better]
        reach /= 3
    end = _sums(y, lengths, best[:, None], m)
    out: list[dict] = [{}] * n
    for i, place in enumerate(by):
        out[place] = _model(int(lengths[i]), m, best[i], end.level[i, 0], end.trend[i, 0], end.season[i, :, 0], end.sse[i, 0], end.errors[i, 0])
    return out


def _sums(y: np.ndarray, lengths: np.ndarray, params: np.ndarray, m: int) -> Smooth:
    state = Smooth.start(y[:, : 2 * m], m, params.shape[1])
    run(y, lengths, params, state, m)
    state.sse = np.nan_to_num(state.sse, nan=np.inf)
    return state


def _model(n: int, m: int, params: np.ndarray, level: float, trend: float, season: np.ndarray, sse: float, errors: float) -> dict:
    spread = sse / (n - m) - (errors / (n - m)) ** 2 if np.isfinite(sse) else np.inf
    return {"level": float(level), "trend": float(trend), "season": season.tolist(), "n": n, "m": m,
            "resid_std": float(np.sqrt(max(spread, 0.0))), "sse": float(sse),
            **dict(zip(("alpha", "beta", "gamma"), map(float, params)))}


def fit_series(y: np.ndarray, seasonal_periods: int) -> dict | None:
    """The model of a series in memory."""
    y = np.nan_to_num(np.asarray(y, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    m = season_of(len(y), seasonal_periods)
    return None if m is None else fit_group([y], m)[0]


def forecast_at(h: Column) -> Column:
    """Forecast ``h`` steps after the end of training, from the model's columns."""
    place = F.pmod(F.col("n") + h - 1, F.col("m")).cast("int")
    return F.col("level") + h * F.col("trend") + F.get("season", place)


def fit_at(y: np.ndarray, m: int, params: np.ndarray) -> dict:
    end = _sums(y[None], np.array([len(y)]), params[None, None], m)
    return _model(len(y), m, params, end.level[0, 0], end.trend[0, 0], end.season[0, :, 0], end.sse[0, 0], end.errors[0, 0])


def _series(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[dict, int, np.ndarray]]:
    """Key, season and points of each series of sorted rows: an id, ``k`` key columns, m, y."""
    now, key, parts = None, {}, []
    for batch in batches:
        ids, m = batch.column(0).to_numpy(), batch.column(k + 1).to_numpy()
        y = batch.column(k + 2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
        for i, j in zip(cuts, np.append(cuts[1:], len(ids))):
            if parts and ids[i] != now:
                yield key, season, np.concatenate(parts)
                parts = []
            if not parts:
                now, season = ids[i], int(m[i])
                key = dict(zip(batch.schema.names[1: k + 1], (batch.column(c)[int(i)].as_py() for c in range(1, k + 1))))
            parts.append(y[i:j])
    if parts:
        yield key, season, np.concatenate(parts)


def block_sums(y: np.ndarray, m: int, params: np.ndarray, first: bool) -> np.ndarray:
    """What ``Joined`` needs of a block, a column for each of ``params``: the state behind it, sums of
    (squared) errors and, for a block that isn't the first, how they change with the state before it."""
    return sums_in_step([y], m, params[None], first)[0]


def sums_in_step(blocks: list[np.ndarray], m: int, params: np.ndarray, first: bool) -> list[np.ndarray]:
    """``block_sums`` of many blocks, of any series, with ``params`` (block, p, 3): all step at once."""
    y, lengths, by = padded(blocks)
    params, (s, n), p = params[by], y.shape, params.shape[1]
    state, parts = (Smooth.start(y[:, : 2 * m], m, p) if first else Smooth.zero(s, m, p)), []
    if first:
        run(y, lengths, params, state, m)
    else:
        kept = np.zeros((n, s, p))
        run(y, lengths, params, state, 0, kept)
        parts = [back(kept, lengths, params, m)]
    sums = np.concatenate([state.vector(), state.sse[:, None], state.errors[:, None], *parts], axis=1)
    out: list[np.ndarray] = [sums[0]] * s
    for i, place in enumerate(by):
        out[place] = sums[i]
    return out


class Joined:
    """Blocks of a series, one after the other, for some parameters."""

    def __init__(self, params: np.ndarray, m: int):
        self.params, self.m = params, m
        self.maps: dict[int, Homogeneous] = {}

    def add(self, sums: np.ndarray, size: int, first: bool) -> None:
        d = self.m + 2
        z, sse, errors = sums[:d], sums[d], sums[d + 1]
        with np.errstate(over="ignore", invalid="ignore"):
            if first:
                self.x, self.sse, self.errors = z.copy(), sse.copy(), errors.copy()
            else:
                if size not in self.maps:  # all blocks but the last have one size
                    self.maps[size] = Homogeneous.points(self.params, self.m, size)
                h, g, x = self.maps[size], sums[d + 2:], self.x
                column = x.T[:, :, None]
                square = (column * (h.q @ column)).sum((1, 2))
                self.sse = self.sse + sse + 2 * (g * x).sum(0) + square
                self.errors = self.errors + errors + (h.r * x.T).sum(1)
                self.x = (h.a @ column)[:, :, 0].T + z
            self.sse = np.nan_to_num(self.sse, nan=np.inf)


class HoltWinters(Detector):
    """Trained per series on all its points, or on its newest ``history`` (a training buffer).

    Series of up to ``block`` points are fitted whole, many in step in one task. Longer ones
    are packed into smaller blocks, which are spread over the tasks and step side by side there.
    """

    model_name = "holt_winters"

    def __init__(self, seasonal_periods: int = DEFAULTS.seasonal_periods, history: int | None = None,
                 keys: Sequence[str] = KEYS, order: Sequence[str] = ("timestamp", "seq"), value: str = "value",
                 block: int = BLOCK):
        self.seasonal_periods, self.history, self.block = seasonal_periods, history, block
        self.keys, self.order, self.value = list(keys), list(order), value
        self.model = None

    def train(self, df: DataFrame) -> DataFrame:
        """Fit (α, β, γ) of each series by rounds of a grid, refined around the best point."""
        return self._fit(df, None)

    def train_at(self, df: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
        """The model with given smoothing parameters: one pass."""
        return self._fit(df, (float(alpha), float(beta), float(gamma)))

    def _fit(self, df: DataFrame, fixed: tuple[float, float, float] | None) -> DataFrame:
        keys, order, types = self.keys, self.order, dict(df.dtypes)
        rows = df.select(*keys, *order, nan_to_num(F.col(self.value)).alias("_y"))
        if self.history is not None:
            rows = newest(rows, self.history, keys, order, keep_apart=True)
        rows = materialize(rows)
        lengths = sized(self._lengths(rows))
        ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
        long = lengths.filter(F.col("n") > self.block)
        few = lengths.filter(F.col("n") <= self.block)
        models = self._whole(rows, few, fixed, ddl)
        if not long.isEmpty():
            models = models.unionByName(self._by_blocks(rows, long, fixed, ddl))
        self.model = materialize(models)
        drop(rows, lengths)
        return self.model

    def _lengths(self, rows: DataFrame) -> DataFrame:
        """Points and season (n, m) of the series that have two seasons."""
        periods = F.lit(self.seasonal_periods)
        m = F.when(F.col("n") >= 2 * periods, periods).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
        n = rows.groupBy(*self.keys).agg(F.count("*").cast("int").alias("n"))
        return n.withColumn("m", m.cast("int")).filter("n >= 2 * m")

    def _whole(self, rows: DataFrame, lengths: DataFrame, fixed: tuple | None, ddl: str) -> DataFrame:
        """Series of up to a block: one shuffle, then a task fits its series in step, all rounds."""
        keys, order = self.keys, self.order
        series, points = lengths.agg(F.count("*"), F.sum("n")).first()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        # work per byte is high: tasks by points, not by bytes
        tasks = max(1, min(series, max(cores, (points or 0) >> 20)))
        todo = rows.join(lengths, keys).withColumn("_id", F.xxhash64(*keys)).repartition(tasks, *keys).sortWithinPartitions("_id", *keys, *order)
        ddl = f"{ddl}, {_MODEL}"
        schema = to_arrow_schema(T.StructType.fromDDL(ddl))
        k = len(keys)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: dict[int, list[tuple[dict, np.ndarray]]] = {}

            def done(m: int) -> pa.RecordBatch:
                own = waiting.pop(m)
                if fixed is None:
                    found = fit_group([y for _, y in own], m)
                else:
                    found = [fit_at(y, m, np.array(fixed)) for _, y in own]
                return pa.RecordBatch.from_pylist([{**key, **model} for (key, _), model in zip(own, found)], schema=schema)

            for key, m, y in _series(batches, k):
                own = waiting.setdefault(m, [])
                own.append((key, y))
                widest = max(len(x) for _, x in own)
                if len(own) * max(widest, m * STEPS**3) >= IN_STEP or sum(map(len, waiting.values())) >= IN_STEP >> 12:
                    yield done(m if len(own) > 1 else max(waiting, key=lambda x: len(waiting[x])))
            for m in list(waiting):
                yield done(m)

        return todo.select("_id", *keys, "m", "_y").mapInArrow(fit, ddl)

    def _by_blocks(self, rows: DataFrame, lengths: DataFrame, fixed: tuple | None, ddl: str) -> DataFrame:
        """Long series: packed into blocks once, each round a pass over the blocks and a join of what they give."""
        keys = self.keys
        places = ordered(rows.join(lengths, keys), keys, self.order)
        first = sized(places.groupBy(*keys).agg(F.min(POS).alias("_first")))
        place = F.col(POS) - F.col("_first")
        # blocks are whole seasons, and two at least
        wanted = F.least(F.lit(self.block), F.greatest(F.lit(STRETCH), F.col("m") * SEASONS))
        size = F.col("m") * F.greatest(F.lit(2), F.ceil(wanted / F.col("m")))
        blocks = places.join(first, keys).withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / size))
        packed = blocks.groupBy(*keys, "n", "m", "_block").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_place", "_y"))), lambda r: r["_y"]).alias("y"))
        # work per byte is high: files by points, not by bytes
        points = lengths.agg(F.sum("n")).first()[0]
        files = max(4 * rows.sparkSession.sparkContext.defaultParallelism, points >> 20)
        packed = materialize(packed.repartition(files, *keys, "_block"))
        names = ("alpha", "beta", "gamma")
        start = fixed or (0.5, 0.5, 0.5)
        best = lengths.select(*keys, *[F.lit(x).alias(c) for c, x in zip(names, start)], F.lit(float("inf")).alias("sse"))
        reach = 0.49
        for _ in range(ROUNDS if fixed is None else 0):
            best = sized(best)
            tried = self._pass(packed, best, reach, f"{ddl}, alpha double, beta double, gamma double, sse double")
            choice = best.unionByName(tried).groupBy(*keys).agg(F.min_by(
                F.struct(*names, "sse"), F.struct("sse", *names)).alias("_b"))
            best = choice.select(*keys, "_b.*")
            reach /= 3
        out = materialize(self._pass(packed, sized(best), None, f"{ddl}, {_MODEL}"))
        drop(packed)
        return out

    def _pass(self, packed: DataFrame, best: DataFrame, reach: float | None, ddl: str) -> DataFrame:
        """The best of every part of the grid around ``best``, or (without ``reach``) the model at ``best`` itself."""
        keys = self.keys
        parts = STEPS if reach else 1
        todo = packed.join(best, keys)
        columns = [*keys, "_block", "n", "m", "alpha", "beta", "gamma"]

        def params_of(row: dict) -> np.ndarray:
            centre = np.array([row["alpha"], row["beta"], row["gamma"]])
            return grid(centre, reach) if reach else centre[None]

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told, y = batch.select(columns).to_pylist(), batch.column("y")
                alike: dict[tuple, list[int]] = {}
                for i, row in enumerate(told):
                    alike.setdefault((row["m"], row["_block"] == 0), []).append(i)
                sizes = pc.list_value_length(y).to_numpy()
                for (m, first), own in alike.items():
                    # as many in step as their errors and states allow
                    each = (1 if first else int(sizes[own].max())) + 3 * (m + 2)
                    width = max(1, KEPT // (each * (STEPS**3 if reach else 1)))
                    for k in range(0, len(own), width):
                        now = own[k: k + width]
                        found = sums_in_step([y[i].values.to_numpy() for i in now], m, np.stack([params_of(told[i]) for i in now]), first)
                        at = pa.array(np.repeat(now, parts))
                        part = np.tile(np.arange(parts, dtype=np.int32), len(now))
                        sums = [x.tobytes() for one in found for x in np.array_split(one, parts, axis=1)]
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(c).take(at) for c in columns], pa.array(part), pa.array(sizes[np.repeat(now, parts)]), pa.array(sums, pa.binary())],
                            [*columns, "_part", "size", "sums"])

        types = {**dict(packed.dtypes), **dict(best.dtypes)}
        reduced = todo.select(*columns, "y").mapInArrow(
            reduce, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", _part int, size int, sums binary")
        schema = to_arrow_schema(T.StructType.fromDDL(ddl))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joined, row = None, None
            for batch in batches:
                for row, size, sums in zip(batch.select([*columns, "_part"]).to_pylist(), batch.column("size").to_pylist(), batch.column("sums").to_pylist()):
                    if joined is None:
                        joined = Joined(np.array_split(params_of(row), parts)[row["_part"]], row["m"])
                    joined.add(np.frombuffer(sums).reshape(-1, len(joined.params)), size, row["_block"] == 0)
            if joined is None:
                return
            k = int(joined.sse.argmin())
            x = joined.x[:, k]
            found = _model(row["n"], row["m"], joined.params[k], x[0], x[1], x[2:], joined.sse[k], joined.errors[k])
            yield pa.RecordBatch.from_pylist([{c: found.get(c, row.get(c)) for c in schema.names}], schema=schema)

        shuffled = reduced.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "_block")
        return shuffled.groupBy(*keys, "_part").applyInArrow(join, ddl)

    def train_univariate(self, df: DataFrame, server: str, metric: str) -> DataFrame:
        """Fit a single series; the filter reaches the scan."""
        return self.train(df.filter((F.col("server_id") == server) & (F.col("name") == metric)))

    def score(self, df: DataFrame, steps: str | None = None) -> DataFrame:
        """Compare points with the forecast: one step after training, or ``steps`` (a column)."""
        h = F.col(steps) if steps else F.lit(1)
        model = self.model.select(*self.keys, "level", "trend", "season", "n", "m", "resid_std")
        joined = df.join(model, self.keys).withColumn("forecast", forecast_at(h))
        return z_score(joined, self.value).drop("level", "trend", "season", "n", "m")

    def number_steps(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Steps since the end of training for the points that follow it, for ``score``."""
        return numbered(df, name, self.keys, self.order)

    def forecast(self, steps: int = DEFAULTS.horizon_steps) -> DataFrame:
        """``forecast array<double>`` per series."""
        horizon = F.transform(F.sequence(F.lit(1), F.lit(steps)), forecast_at)
        return self.model.select(*self.keys, horizon.alias("forecast"))


def z_score(df: DataFrame, value: str = "value") -> DataFrame:
    """Residual against ``forecast`` in units of ``resid_std``: score z/4, anomalous above .7."""
    out = df.withColumn("residual", F.abs(F.col(value) - F.col("forecast")))
    out = out.withColumn("z_score", F.when(F.col("resid_std") > 0, F.col("residual") / F.col("resid_std")))
    # least() skips nulls, so an undefined z must be caught before it
    score = F.when(F.col("z_score").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("z_score") / 4.0))
    return out.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > 0.7)
