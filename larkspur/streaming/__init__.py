"""Streaming forms: newly landed candidates merged into a stored snapshot, and task progress with retractions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators import audit, rows
from larkspur.operators.ingredients import parsed
from larkspur.scratch import SPREAD, read_text, replace_text, small, stored

#: Parts of a snapshot above which a merge also folds them into one.
PARTS = 16


def landed_files(spark: SparkSession, schema: str, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they land."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)


# ---------------------------------------------------------------- X1


def _manifest(spark: SparkSession, root: str) -> dict:
    said = read_text(spark, f"{root}/manifest.json")
    return json.loads(said) if said else {"batch": -1, "parts": []}


def candidates_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The candidates that merges up to the last swap of the manifest have stored: of each row_id the row of its last batch. None before the first."""
    return _latest(spark, _manifest(spark, root)["parts"])


def _latest(spark: SparkSession, parts: list[dict]) -> DataFrame | None:
    if not parts:
        return None
    if len(parts) == 1:
        return spark.read.parquet(parts[0]["path"])
    both = None
    for k, part in enumerate(parts):
        df = spark.read.parquet(part["path"]).withColumn("__part", F.lit(k))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    last = both.groupBy("row_id").agg(F.max("__part").alias("__part"))  # narrow: only ids are shuffled for it
    return both.join(last, ["row_id", "__part"]).drop("__part")


def merge_candidates(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, parts: int = PARTS) -> bool:
    """Merges a batch of candidates into the snapshot under root, once: a batch that the snapshot has is left out (False).

    Of rows of one row_id in the batch the last by updated_at counts (then by all values); rows without a row_id are left
    out. The batch is written as a part of its own and then named by a new manifest, which replaces the old one in one
    step. So a merge that is killed before leaves the old snapshot, and its part is never read; a merge costs as much as
    its batch. Above `parts` parts they are folded into one. Only rows whose row_id the batch holds again are gathered by
    it; for that its ids are read before its rows, so costly columns should be stored or not depend on ids.
    """
    held = _manifest(spark, root)
    if batch_id <= held["batch"]:
        return False
    path = f"{root}/part-{batch_id}-{uuid.uuid4().hex}"
    keep = [F.col(f"`{c}`") for c in batch.columns]
    newest = F.struct(F.col("updated_at") if "updated_at" in batch.columns else F.lit(None).cast("timestamp"), F.to_json(F.struct(*keep)))
    given = batch.filter("row_id is not null")
    again = small(stored(given.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_id"), "stream-again"))
    chosen = given.join(again, "row_id", "left_semi").groupBy("row_id").agg(F.max_by(F.struct(*keep), newest).alias("row")).select("row.*")
    given.join(again, "row_id", "left_anti").select(*keep).unionByName(chosen).write.parquet(path)
    now = [*held["parts"], {"batch": batch_id, "path": path}]
    if len(now) > parts:
        whole = f"{root}/whole-{batch_id}-{uuid.uuid4().hex}"
        _latest(spark, now).write.parquet(whole)
        now = [{"batch": batch_id, "path": whole}]
    replace_text(spark, f"{root}/manifest.json", json.dumps({"batch": batch_id, "parts": now}))
    return True


def stream_candidates(landed: DataFrame, into: str | Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of landed rows is parsed, audited (without the duplicate rule, which needs all rows) and merged into the snapshot under the folder `into`.

    Replayed batches change nothing (see merge_candidates), so the snapshot holds each row as its last batch left it.
    Where candidates are kept elsewhere, `into` is a function that gets each batch and its number, once or more.
    """
    spark = landed.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(SPREAD * spark.sparkContext.defaultParallelism)  # landed files may be few, and are read by row group
        done = stored(parsed(rows.aligned(dealt)), "stream-parsed", compact=True)
        audited = audit.audited(done, with_duplicates=False)
        if callable(into):
            into(audited, batch_id)
        else:
            merge_candidates(spark, into, audited, batch_id)

    return landed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- X2

CHANGES = "task_id string, status string, delta int"
#: Lanes that rows are dealt to by hash. A call of Python takes a millisecond or more, so a batch makes one a lane and not one a row; checkpoints depend on the number.
LANES = 1 << 13


def status_changes(events: DataFrame) -> DataFrame:
    """The changes in the count of each task's rows by status: (task_id, status, delta), as a stream in append mode.

    events: task_id, row_id, status, said_at (timestamp), seq (long). State holds each row's last status and the
    place (time, seq) of that, and is kept by lane, a share of all rows by hash. A row's first status adds one; a later one
    with another status takes one from the old count and adds one to the new. Events before the place of the state are late: they change nothing, as the row's last status
    is known already; repeated ones likewise. Nulls: events without task_id or row_id are left out, a null status
    counts as QUEUED, a null time as the earliest.
    """
    clean = events.filter("task_id is not null and row_id is not null").select(
        F.col("task_id").cast("string").alias("task_id"), F.col("row_id").cast("string").alias("row_id"), F.coalesce("status", F.lit("QUEUED")).alias("status"),
        F.coalesce(F.unix_micros("said_at"), F.lit(0)).alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for pdf in batches:
            for task, row, *new in zip(*(pdf[c].tolist() for c in ("task_id", "row_id", "at", "seq", "status")), strict=True):
                if (task, row) not in best or new > best[task, row]:
                    best[task, row] = new
        held = {(task, row): said for task, row, *said in zip(*state.get, strict=True)} if state.exists else {}
        changes = []
        for (task, row), new in best.items():
            old = held.get((task, row))
            if old is None or new[:2] > old[:2]:
                held[task, row] = new
                if old is None or old[2] != new[2]:
                    changes += [(task, s[2], d) for s, d in ((old, -1), (new, 1)) if s]
        state.update(tuple(list(c) for c in zip(*((*k, *said) for k, said in held.items()), strict=True)))
        if changes:
            yield pd.DataFrame(changes, columns=["task_id", "status", "delta"])

    lane = F.pmod(F.xxhash64("task_id", "row_id"), F.lit(LANES)).alias("lane")
    return clean.withColumn("lane", lane).groupBy("lane").applyInPandasWithState(step, CHANGES, "tasks array<string>, rows array<string>, ats array<long>, seqs array<long>, statuses array<string>", "append", GroupStateTimeout.NoTimeout)


def stream_task_progress(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes status_changes of landed events to path, each change once."""
    return status_changes(events).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_of_changes(changes: DataFrame) -> DataFrame:
    """H9 from the changes so far: per task the rows by last status, how many are done, and whether it is completed."""
    done = ["OK", "PENDING", "NEEDS_SOURCE", "SKIPPED", "ERROR"]
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("delta"))), F.lit(0)).cast("long")
    per = changes.groupBy("task_id").agg(F.sum("delta").cast("long").alias("total"), *[count(F.col("status") == s).alias(s.lower()) for s in done], count(F.col("status").isin(done)).alias("done"))
    return per.withColumn("task_status", F.when(F.col("done") == F.col("total"), "COMPLETED").otherwise("RUNNING"))
