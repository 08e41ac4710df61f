"""Job states from log lines, in batch and as a stream.

A job is queued until its first line and running until an exit line; then it is done if it exited well and named its result, or
else an error. Progress is the largest hint so far, from 1; a job that is done has 100, one that exited well without a
result 99. The state is folded by maxima of the line number, so a line that is delivered again or late changes nothing
that it shouldn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text

STATE = "job_id long, status string, progress long, message string, run_dir string, result_path string, lines long, last_seq long"
#: The progress of a job that runs, and of one that exited well without a result; messages; and the keys of lines that
#: name a job's folder and result.
FIRST_PROGRESS, NO_RESULT_PROGRESS = 1, 99
RUNNING, NO_RESULT = "running", "finished but missing out_repaired.pdf"
FOLDER_KEY, RESULT_KEY = "run_dir", "pdf"


def event_lines(events: DataFrame) -> DataFrame:
    """Events as log lines (job_id, seq, line): kinds of events stand for stages, results and exits."""
    kind = F.col("event_type")
    line = F.when(kind == "view", "run render_pages_png.py").when(kind == "click", "$ python /srv/build_plan.py --out x").when(kind == "signup", "$ python /srv/describe_images.py")
    result = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("pdf: /out/"), F.col("event_id").cast("string"), F.lit(".pdf"))).otherwise("exit: 0")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.when(kind == "purchase", result).otherwise("exit: 1").alias("line"))


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (job_id, seq, line) from files of JSON lines that appear in a folder."""
    return spark.readStream.schema("job_id long, seq long, line string").json(path)


def read(lines: DataFrame) -> DataFrame:
    """What lines (job_id, seq, line) say: hint, message, code, run_dir and result, null where a line doesn't."""
    line = F.col("line")
    hint = text.progress_hint(line)
    named = [text.present(text.keyed_value(line, k)) for k in (FOLDER_KEY, RESULT_KEY)]
    return lines.select("job_id", "seq", hint["progress"].alias("hint"), hint["message"].alias("message"), text.keyed_value(line, "exit").alias("code"), named[0].alias("run_dir"), named[1].alias("result_path"))


def _outcome(code: Column, hint: Column, message: Column, result: Column) -> list[Column]:
    """status, progress and message of the last exit's code (null: none yet), the largest hint, the last message and the result."""
    well = code == "0"
    missing = well & result.isNull()
    status = F.when(code.isNull(), "running").when(well & ~missing, "done").otherwise("error")
    progress = F.when(missing, NO_RESULT_PROGRESS).when(well, 100).otherwise(F.greatest(F.lit(FIRST_PROGRESS), F.coalesce(hint, F.lit(FIRST_PROGRESS))))
    said = F.when(missing, NO_RESULT).when(well, "done").when(code.isNotNull(), "error").otherwise(F.coalesce(message, F.lit(RUNNING)))
    return [status.alias("status"), progress.cast("long").alias("progress"), said.alias("message")]


def final_states(lines: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """job_id, status, progress, message, run_dir, result_path, lines and last_seq of each job. lines: job_id, seq, line; jobs (job_id): all
    there are, so that those without lines are queued."""

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    state = read(lines).groupBy("job_id").agg(F.max("hint").alias("hint"), *(last(c) for c in ("message", "code", "run_dir", "result_path")), F.count(F.lit(1)).alias("lines"), F.max("seq").alias("last_seq"))
    known = state.select("job_id", *_outcome(F.col("code"), F.col("hint"), F.col("message"), F.col("result_path")), "run_dir", "result_path", "lines", "last_seq")
    if jobs is None:
        return known
    queued = {"status": F.lit("queued"), "progress": F.lit(0).cast("long"), "message": F.lit("queued"), "lines": F.lit(0).cast("long")}
    joined = jobs.select("job_id").distinct().join(known, "job_id", "left")
    return joined.select(*(F.coalesce(c, queued[c]).alias(c) if c in queued else c for c in known.columns))


def state_stream(lines: DataFrame) -> DataFrame:
    """The states of a stream of lines, one row per job that a batch touched. The lines' numbers decide, not their arrival."""
    names = ["message", "code", "run_dir", "result_path"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        hint, count, top, *held = state.get if state.exists else (FIRST_PROGRESS, 0, -1, *("", -1) * len(names))
        for b in batches:
            count += len(b)
            top = max(top, int(b["seq"].max()))
            hints = b["hint"].dropna()
            hint = max(hint, int(hints.max())) if len(hints) else hint
            for k, name in enumerate(names):
                said = b.dropna(subset=[name])
                if len(said):
                    at = said["seq"].idxmax()
                    if int(said.loc[at, "seq"]) > held[2 * k + 1]:
                        held[2 * k : 2 * k + 2] = [said.loc[at, name], int(said.loc[at, "seq"])]
        state.update((hint, count, top, *held))
        message, code, run_dir, result = (held[2 * k] if held[2 * k + 1] >= 0 else None for k in range(len(names)))
        missing = code == "0" and result is None
        status = "running" if code is None else "done" if code == "0" and not missing else "error"
        progress = NO_RESULT_PROGRESS if missing else 100 if status == "done" else hint
        said = NO_RESULT if missing else status if code is not None else message or RUNNING
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "message": [said], "run_dir": [run_dir], "result_path": [result], "lines": [count], "last_seq": [top]})

    held = ", ".join(["hint long, lines long, last_seq long", *(f"{n} string, {n}_seq long" for n in names)])
    return read(lines).groupBy("job_id").applyInPandasWithState(step, STATE, held, "update", "NoTimeout")


def upsert_latest(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of an append-only history of states."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tail(lines: DataFrame, count: int) -> DataFrame:
    """The last lines of each job; all of them if count isn't positive."""
    if count <= 0:
        return lines
    w = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    return lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")


def allowed(status: Column) -> Column:
    """Whether a job's result may be fetched."""
    return status.isin("done", "error")


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a log's table; what is there stays."""
    rows.write.mode("append").parquet(path)


def keep_states(states: DataFrame, history: str, checkpoint: str):
    """Start the query that appends each batch of a stream of states, with the batch's number, to a history; ``upsert_latest`` of that
    history by the batch is the current state. A batch that runs again is written in place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def newest(files: DataFrame, job: str = "job_id") -> DataFrame:
    """job and path of the newest of each job's files (job, path, modificationTime); the last path of equally new ones."""
    return files.groupBy(job).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def result_folders(jobs: DataFrame, files: DataFrame, name: str = "html_outcome") -> DataFrame:
    """job_id and folder of each job (job_id, run_dir, result_path, job_dir): the first that has an index among the one in its run's folder,
    the one beside its result, the one in its own folder, and the newest anywhere below; null if none has. files: the indexes that
    there are (job_id, path, modificationTime)."""
    there = files.select("job_id", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "path", "modificationTime")

    def below(c: Column) -> Column:
        return F.concat(F.regexp_replace(text.present(text.strip(c)), "/+$", ""), F.lit(f"/{name}"))

    beside = F.regexp_replace("result_path", r"/[^/]*$", "")
    wanted = jobs.select("job_id", F.posexplode(F.array(below(F.col("run_dir")), below(beside), below(F.col("job_dir")))).alias("rank", "folder")).where("folder is not null")
    first = wanted.join(there.select("job_id", "folder").distinct(), ["job_id", "folder"]).groupBy("job_id").agg(F.min_by("folder", "rank").alias("a"))
    last = newest(there.select("job_id", F.col("folder").alias("path"), "modificationTime")).withColumnRenamed("path", "b")
    return jobs.select("job_id").join(first, "job_id", "left").join(last, "job_id", "left").select("job_id", F.coalesce("a", "b").alias("folder"))
