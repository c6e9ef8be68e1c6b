"""Queries that run streams over landed parts of the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur import streaming
from larkspur.plans.base import registered
from larkspur.plans.registry import AUDIT, PARSE, candidates
from larkspur.plans.views import view
from larkspur.scratch import scratch_path

#: Status events of a task's rows by user. Several belong to one row; parts land out of order.
_EVENTS = """
SELECT cast(user_id % 20 AS string) AS task_id, cast(user_id AS string) || '-' || cast(event_id % 3 AS string) AS row_id, ts AS said_at, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'PENDING' WHEN 'purchase' THEN 'NEEDS_SOURCE' WHEN 'signup' THEN 'SKIPPED' ELSE 'QUEUED' END AS status
FROM events
"""
_done = ["OK", "PENDING", "NEEDS_SOURCE", "SKIPPED", "ERROR"]
_counts = ", ".join(f"count_if(status = '{s}') AS {s.lower()}" for s in _done)


def landed_parts(parts: list[DataFrame], path: str, follow: Callable[[], StreamingQuery]) -> None:
    """Writes each part into the landing place, as many files as its rows are spread over, and lets the stream take it up before the next one lands: a part is one batch, however large it is."""
    for part in parts:
        part.write.mode("append").parquet(path)
        follow().awaitTermination()


@registered("stream_task_progress", f"""WITH e AS ({_EVENTS}), last AS (SELECT task_id, row_id, arg_max(status, (said_at, seq)) AS status FROM e GROUP BY task_id, row_id),
g AS (SELECT task_id, count(*) AS total, {_counts}, count_if(status IN ({', '.join(repr(s) for s in _done)})) AS done FROM last GROUP BY task_id)
SELECT *, CASE WHEN done = total THEN 'COMPLETED' ELSE 'RUNNING' END AS task_status FROM g""")
def stream_task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in three parts, of which later ones hold earlier events and the second repeats rows of the first."""
    events = view(spark, sf_dir, _EVENTS)
    landing, out, check = scratch_path(spark, "landed-events"), scratch_path(spark, "status-changes"), scratch_path(spark, "checkpoint")
    third = F.col("seq") % 3
    kinds = "task_id string, row_id string, said_at timestamp, seq long, status string"
    parts = [events.filter(third == 1), events.filter((third == 0) | (F.col("seq") % 15 == 1)), events.filter(third == 2)]
    landed_parts(parts, landing, lambda: streaming.stream_task_progress(streaming.landed_files(spark, kinds, landing), out, check))
    return streaming.progress_of_changes(spark.read.schema(streaming.CHANGES).parquet(out))


_alone = AUDIT.replace("row_id IN (SELECT row_id FROM clash)", "false")


@registered("stream_candidates", PARSE + _alone + """SELECT row_id, import_id, parse_status, inci_list, audit_status, audit_score, source_match_status, blockers + reviews AS n_findings FROM audit""")
def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates land in two parts; rows of the first that the second holds again had another text, and are replaced."""
    rows = candidates(spark, sf_dir)
    landing, root, check = scratch_path(spark, "landed-candidates"), scratch_path(spark, "candidates"), scratch_path(spark, "checkpoint")
    again = F.col("row_index") % 10 == 0
    early = rows.filter((F.col("row_index") % 2 == 0)).withColumn("raw_ingredient_text", F.when(again, "Aqua, Glycerin").otherwise(F.col("raw_ingredient_text")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    landed_parts([early, rows.filter((F.col("row_index") % 2 == 1) | again)], landing, lambda: streaming.stream_candidates(streaming.landed_files(spark, kinds, landing), root, check))
    found = streaming.candidates_snapshot(spark, root)
    return found.select("row_id", "import_id", "parse_status", "inci_list", "audit_status", "audit_score", "source_match_status", F.size("findings").cast("long").alias("n_findings"))
