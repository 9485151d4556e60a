"""Result tables a stream keeps up to date, safe against replayed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rowsheaf.plans.files import delete_tree, exists, hadoop_path

BATCH, SNAPSHOT = "batch_id", "snapshot"


class VersionedTable:
    """Parquet folder with one ``batch_id=`` sub-folder per micro-batch.

    A batch is written with overwrite of its own folder, so replaying it changes nothing. With
    ``keys`` the batches hold changed rows and the newest row of each key counts; without, each batch
    is the whole result and the newest batch counts. After ``keep`` batches they are compacted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, keep: int = 100):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, keep

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")
        if len(self.batches()) > self.keep:
            self.compact()

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the ``kind=`` folders whose write was finished; the others are written again."""
        if not exists(self.spark, self.path):
            return []
        fs, root = hadoop_path(self.spark, self.path)
        names = [s.getPath().getName().partition("=") for s in fs.listStatus(root)]
        numbers = [int(number) for found, _, number in names if found == kind]
        return sorted(n for n in numbers if exists(self.spark, f"{self.path}/{kind}={n}/_SUCCESS"))

    def batches(self) -> list[int]:
        """Batches that count: finished, and not yet part of a snapshot."""
        whole = self._complete(SNAPSHOT)
        return [n for n in self._complete(BATCH) if not whole or n > whole[-1]]

    def before(self, batch_id: int) -> DataFrame | None:
        """The whole result before ``batch_id``, also while that batch is repeated; None if it is the first."""
        earlier = [n for n in self.batches() if n < batch_id]
        return self.spark.read.parquet(f"{self.path}/{BATCH}={earlier[-1]}") if earlier else None

    def read(self) -> DataFrame:
        if self.keys is None:
            batches = self.batches()
            if not batches:
                raise FileNotFoundError(f"no batch in {self.path}")
            return self.spark.read.parquet(f"{self.path}/{BATCH}={batches[-1]}")
        log = self._log()
        version = F.regexp_extract(F.col("_metadata.file_path"), f"(?:{BATCH}|{SNAPSHOT})=([0-9]+)/[^/]*$", 1)
        values = [c for c in log.columns if c not in self.keys]
        newest = log.withColumn("_version", version.cast("long")).groupBy(*self.keys)
        newest = newest.agg(F.max_by(F.struct(*values), "_version").alias("_v"))
        return newest.select(*self.keys, *[F.col(f"_v.{v}").alias(v) for v in values])

    def _log(self) -> DataFrame:
        """The rows of the snapshot and of the batches since."""
        batches, whole = self.batches(), self._complete(SNAPSHOT)[-1:]
        if not batches and not whole:
            raise FileNotFoundError(f"no batch in {self.path}")
        folders = [(n, SNAPSHOT) for n in whole] + [(n, BATCH) for n in batches]
        schema = self.spark.read.parquet(f"{self.path}/{folders[-1][1]}={folders[-1][0]}").schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}={n}" for n, kind in folders])

    def _whole(self) -> DataFrame:
        """What a snapshot holds."""
        return self.read()

    def compact(self) -> None:
        """Fold the batches into a snapshot (or keep only the newest whole result), then drop them.

        Nothing is dropped before what replaces it is complete, so an interrupted run can be repeated.
        """
        batches = self.batches()
        if not batches:
            return
        last = batches[-1]
        if self.keys is not None:
            self._whole().write.mode("overwrite").parquet(f"{self.path}/{SNAPSHOT}={last}")
            outdated = [(BATCH, n) for n in self._complete(BATCH) if n <= last]
            outdated += [(SNAPSHOT, n) for n in self._complete(SNAPSHOT) if n < last]
        else:
            outdated = [(BATCH, n) for n in batches[:-2]]  # a batch that is repeated needs the one before
        for kind, n in outdated:
            delete_tree(self.spark, f"{self.path}/{kind}={n}")

    def follow(
        self, stream: DataFrame, checkpoint: str, mode: str, every: str | None = None
    ) -> StreamingQuery:
        """Start writing ``stream`` here: every ``every`` (``"30 seconds"``), or all there is and stop."""
        return start(stream.writeStream.outputMode(mode).foreachBatch(self.write), checkpoint, every)


class SummedTable(VersionedTable):
    """A table of numbers by key to which every batch adds, or from which it takes: the sum of all batches counts.

    A stream that writes here has no state of its own, so a key may come back however late. ``fold`` changes keys
    when batches become a snapshot, such as old instants to their days; the numbers of equal keys are added up.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], n: str = "n", keep: int = 100, fold=None):
        super().__init__(spark, path, keys, keep)
        self.n, self.fold = n, fold

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum(self.n).alias(self.n)).where(F.col(self.n) != 0)

    def read(self) -> DataFrame:
        return self._summed(self._log())

    def _whole(self) -> DataFrame:
        return self._summed(self.fold(self._log())) if self.fold else self.read()


def start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
