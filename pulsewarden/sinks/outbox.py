"""Tables of a batch that become visible together, and once.

A batch stages each of its tables under its run and number, replacing what an earlier try
left there, and is then committed by one marker in the log. Readers go through the log, so
the tables of a batch that died half way don't exist for them, and a batch that is run again
neither loses nor repeats a row. A run is one life of a checkpoint; its batches are committed
in order of their numbers, so the log needs to keep a run's last number only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_RUN, _BATCH = "_run", "_batch"


def run_id(spark: SparkSession, otherwise: str) -> str:
    """Of the stream whose batch is being handled: the id that its checkpoint holds."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or otherwise


@dataclass(frozen=True)
class Outbox:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []

    def committed(self) -> dict[str, int]:
        """The last committed batch of each run."""
        last: dict[str, int] = {}
        for name in self._names(f"{self.path}/log"):
            run, _, number = name.rpartition("-")
            if run and number.isdigit():
                last[run] = max(int(number), last.get(run, -1))
        return last

    def is_committed(self, run: str, batch: int) -> bool:
        return batch <= self.committed().get(run, -1)

    def stage(self, run: str, batch: int, tables: Mapping[str, DataFrame]) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(self._folder(name, run, batch))

    def commit(self, run: str, batch: int) -> None:
        """Make the staged tables of a batch visible; then forget the run's older markers."""
        fs, marker = self._fs(f"{self.path}/log/{run}-{batch}")
        fs.create(marker, True).close()
        for name in self._names(f"{self.path}/log"):
            of, _, number = name.rpartition("-")
            if of == run and number.isdigit() and int(number) < batch:
                fs.delete(self._fs(f"{self.path}/log/{name}")[1], False)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The committed rows of a table, without the columns of the log."""
        last = self.committed()
        own = self.spark.createDataFrame([], schema)
        if not last or name not in self._names(self.path):
            return own
        rows = self.spark.read.schema(StructType([*own.schema.fields, *_LOG.fields])).parquet(f"{self.path}/{name}")
        # runs are few, one for each checkpoint there ever was
        seen = F.lit(False)
        for run, batch in last.items():
            seen = seen | ((F.col(_RUN) == run) & (F.col(_BATCH) <= batch))
        return rows.filter(seen).drop(_RUN, _BATCH)

    def latest(self, name: str, run: str, schema: StructType | str) -> DataFrame | None:
        """A table as the last committed batch of a run left it."""
        batch = self.committed().get(run)
        if batch is None or f"{_BATCH}={batch}" not in self._names(f"{self.path}/{name}/{_RUN}={run}"):
            return None
        return self.spark.read.schema(self.spark.createDataFrame([], schema).schema).parquet(self._folder(name, run, batch))

    def forget(self, name: str, run: str, batch: int) -> None:
        """Delete a table of a batch that nothing reads any more."""
        fs, target = self._fs(self._folder(name, run, batch))
        fs.delete(target, True)

    def _folder(self, name: str, run: str, batch: int) -> str:
        return f"{self.path}/{name}/{_RUN}={run}/{_BATCH}={batch}"


_LOG = StructType().add(_RUN, "string").add(_BATCH, "long")
