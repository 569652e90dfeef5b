"""Streaming intake of landed check-in documents, and refresh of the results they touch."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roamlog.functions import scalars as S
from roamlog.operators.common import top_k
from roamlog.operators.maintain import ROW_KEYS, new_rows
from roamlog.schema import CHECKIN_DOC_DDL, CHECKIN_FIELDS
from roamlog.sources.documents import flatten_checkins
from roamlog.session import delete_paths, stage_apart
from roamlog.sources.snapshots import names_in
from roamlog.streaming.runs import AT, UserResults, UserRuns


USER = "user_id"


def stream_checkins(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stored-layout rows with their user from JSON files landing in ``folder``.

    No row is late: repeats and old documents go to the keyed merge with the stored table, so the
    stream holds no state and needs no watermark.
    """
    reader = spark.readStream.schema(f"user_id string, {CHECKIN_DOC_DDL}")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.json(folder)
    owner = F.coalesce(F.col(USER), F.col("user.id"), F.lit(""))
    return flatten_checkins(docs.withColumn(USER, owner), keep=[USER])


@dataclass(frozen=True)
class LogStore(UserRuns):
    """Check-in table as runs of users (:mod:`roamlog.streaming.runs`), with a log of the users each batch touched.

    ``keys`` tell the rows of a user apart; with ``checkin_id`` among them, two check-ins at one venue in one second stay two.
    """

    keys: tuple[str, ...] = tuple(ROW_KEYS)

    def _schema(self) -> str:
        return ", ".join(f"{c} string" for c in [USER, *CHECKIN_FIELDS])

    def _plain(self, spark: SparkSession, files: list[str]) -> DataFrame:
        rows = self.read_files(spark, files, self._schema())
        return spark.createDataFrame([], self._schema()) if rows is None else rows

    def read(self, spark: SparkSession) -> DataFrame:
        return self._plain(spark, self._names(self.files(spark)))

    def read_users(self, touched: DataFrame) -> DataFrame:
        """All rows of the users ``touched``, read from their files only."""
        rows = self._plain(touched.sparkSession, self.files_of(touched))
        return rows.join(touched.select(USER).distinct(), USER, "left_semi")

    def merge(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Append rows whose key is not stored; returns the users of the batch.

        Of rows with one key in a batch the largest is taken, so the result does not depend on the
        order of arrival within it. Only files that hold one of its users at a time within the
        batch are compared. Running a batch twice adds nothing, but names the same users, so a
        refresh that was lost to a failure is done again.
        """
        spark = batch.sparkSession
        cols = [USER, *CHECKIN_FIELDS]
        keys = [USER, *self.keys]
        one = top_k(batch.select(*cols), keys, [F.desc(c) for c in cols if c not in keys], 1)
        path, rows = stage_apart(one.withColumn(AT, F.coalesce(S.to_long(F.col("date")), F.lit(0))), "batch")
        spans = rows.groupBy(USER).agg(F.min(AT).alias("lo_at"), F.max(AT).alias("hi_at"))
        changed = f"{self.path}/changes/{batch_id:012d}"
        spans.select(USER).write.mode("overwrite").parquet(changed)
        fresh_path, fresh = stage_apart(new_rows(rows, self._plain(spark, self.files_of(spans)), list(self.keys), by=[USER]), "fresh")
        self.append(fresh)
        delete_paths(spark, [path, fresh_path])
        return spark.read.schema(f"{USER} string").parquet(changed)

    def changed_since(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Users of all batches after ``batch_id``, for a refresh that runs apart from the intake."""
        later = [n for n in names_in(spark, f"{self.path}/changes") if n.isdigit() and int(n) > batch_id]
        if not later:
            return spark.createDataFrame([], f"{USER} string")
        return spark.read.schema(f"{USER} string").parquet(*[f"{self.path}/changes/{n}" for n in later]).distinct()

    def forget_changes(self, spark: SparkSession, batch_id: int) -> None:
        """Drop the log of batches up to ``batch_id`` once every refresh has seen them."""
        delete_paths(spark, [f"{self.path}/changes/{n}" for n in names_in(spark, f"{self.path}/changes") if n.isdigit() and int(n) <= batch_id])


Refresh = Callable[[DataFrame, DataFrame], None]


def run(stream: DataFrame, store: LogStore, checkpoint: str, refresh: Refresh | None = None,
        **trigger: object) -> StreamingQuery:
    """Merge each micro-batch into the store, then refresh the users it touched.

    ``refresh`` gets the stored rows of these users and the users. Offsets move only after the
    batch function returns, so a failure repeats the batch; the merge is keyed and repeating it is
    harmless. An empty batch refreshes nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        touched = store.merge(batch, batch_id)
        if refresh is not None and not touched.isEmpty():
            refresh(store.read_users(touched), touched)

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def refresher(compute: Callable[[DataFrame], DataFrame], results: UserResults) -> Refresh:
    """Recompute a per-user result for the touched users and replace it for these users alone.

    ``compute`` gets the stored rows of the users and must keep the user column.
    """
    def refresh(rows: DataFrame, touched: DataFrame) -> None:
        path, found = stage_apart(compute(rows), "refreshed")
        results.replace(found, touched)
        delete_paths(rows.sparkSession, [path])

    return refresh
