"""Conversion tasks: responses, states, batches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, response codes and the published limits of the conversion service.
DONE, FAILED = "done", "failed"
RUNNING = ("pending", "running", "converting")
#: The states of each kind of task: which one is done, which has failed, which go on.
VOCABULARIES = {
    "precise": (DONE, FAILED, RUNNING),
    "light": (DONE, FAILED, ("waiting-file", "uploading", "pending", "running")),
    "local": ("completed", FAILED, ("pending", "processing")),
}
AUTH_CODES = ("401", "A0202", "A0211")
MAX_FILES = 200
#: Megabytes and pages of a file, by tier.
LIMITS = {"precise": (200, 200), "light": (10, 20)}
ENVELOPE = "code string, msg string, trace_id string, data string"
TASK = "task_id string, state string, full_zip_url string, err_msg string, data_id string, extract_progress struct<extracted_pages:int,total_pages:int>"
SESSION_HOURS = 24


def is_terminal(state: Column, vocabulary: str = "precise") -> Column:
    done, failed, _ = VOCABULARIES[vocabulary]
    return state.isin(done, failed)


def is_failed(state: Column, vocabulary: str = "precise") -> Column:
    return state == VOCABULARIES[vocabulary][1]


def is_running(state: Column, vocabulary: str = "precise") -> Column:
    return state.isin(*VOCABULARIES[vocabulary][2])


def judge_states(tasks: DataFrame) -> DataFrame:
    """tasks (vocabulary, state) with terminal, failed and running by the vocabulary's own states; null for an unknown vocabulary."""

    def by(test) -> Column:
        flag = F.lit(None).cast("boolean")
        for v in VOCABULARIES:
            flag = F.when(F.col("vocabulary") == v, test(F.col("state"), v)).otherwise(flag)
        return flag

    return tasks.withColumns({"terminal": by(is_terminal), "failed": by(is_failed), "running": by(is_running)})


def classify_response(http_status: Column, body: Column) -> Column:
    """ok, auth, rate_limited, http_error, bad_json or api_error."""
    envelope = F.from_json(body, ENVELOPE)
    code = envelope["code"]
    sound = F.coalesce(F.is_valid_json(body), F.lit(False)) if hasattr(F, "is_valid_json") else F.coalesce(F.json_object_keys(body).isNotNull(), F.lit(False))
    return (
        F.when(http_status == 429, "rate_limited").when(~sound, "bad_json").when(code.isNull() & (http_status >= 400), "http_error")
        .when(code == "0", "ok").when(code.isin(*AUTH_CODES), "auth").otherwise("api_error")
    )


def validate_batches(files: DataFrame, tier: str = "precise") -> DataFrame:
    """(batch_id, n_files, violations) of files (batch_id, mb, pages) by the tier's limits: only the number of files refuses a batch."""
    mb, pages = LIMITS[tier]
    counted = files.groupBy("batch_id").agg(F.count("path").alias("n_files"), F.count_if(F.col("mb") > mb).alias("heavy"), F.count_if(F.col("pages") > pages).alias("long"))
    broken = F.array_compact(F.array(
        F.when(F.col("n_files") == 0, "empty"), F.when(F.col("n_files") > MAX_FILES, "too many files"),
        F.when(F.col("heavy") > 0, "file over size"), F.when(F.col("long") > 0, "file over pages"),
    ))
    return counted.select("batch_id", "n_files", F.array_join(broken, "; ").alias("violations"), ((F.col("n_files") > 0) & (F.col("n_files") <= MAX_FILES)).alias("accepted"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each task, by time and then state."""
    last = events.groupBy("task_id").agg(F.max(F.struct("ts", "state", "batch_id")).alias("e"))
    return last.select("task_id", "e.batch_id", "e.state", "e.ts")


def rolled_state(total: Column, done: Column, bad: Column, going: Column) -> Column:
    """A batch's state by its counts. No tasks: unknown. All done: done. Any failed and none running: failed. Else running."""
    return F.when(total == 0, "unknown").when(done == total, DONE).when((bad > 0) & (going == 0), FAILED).otherwise("running")


def batch_states(batches: DataFrame, latest: DataFrame) -> DataFrame:
    """(batch_id, state, done, total) for each batch; see rolled_state."""
    known = batches.join(latest, "batch_id", "left").groupBy("batch_id").agg(
        F.count("task_id").alias("total"), F.count_if(F.col("state") == DONE).alias("done"),
        F.count_if(F.col("state") == FAILED).alias("bad"), F.count_if(is_running(F.col("state"))).alias("going"),
    )
    return known.select("batch_id", rolled_state(*map(F.col, ("total", "done", "bad", "going"))).alias("state"), "done", "total")


def result_keys(tasks: DataFrame) -> DataFrame:
    """(task_id, result_key, url): the data id, else the task's; failed tasks and those without a file have no result."""
    good = (F.col("state") == DONE) & F.col("full_zip_url").isNotNull() & (F.col("full_zip_url") != "")
    return tasks.select("task_id", F.coalesce(F.nullif("data_id", F.lit("")), "task_id").alias("result_key"), F.when(good, F.col("full_zip_url")).alias("url"))


def parse_status_log(bodies: DataFrame) -> DataFrame:
    """Typed task rows of responses (body): a task itself, or the tasks listed under either result key of a batch."""
    data = F.col("e.data")
    one = F.from_json(data, TASK)
    lists = F.from_json(data, f"batch_id string, extract_result array<struct<{_fields(TASK)}>>, results array<struct<{_fields(TASK)}>>")
    rows = bodies.select(F.from_json("body", ENVELOPE).alias("e")).where("e.data IS NOT NULL").select(one.alias("one"), lists.alias("many"))
    several = F.coalesce("many.extract_result", "many.results")
    tasks = rows.select(F.col("many.batch_id").alias("batch_id"), F.explode(F.coalesce(several, F.array("one"))).alias("t")).select("batch_id", "t.*")
    return tasks.where("task_id IS NOT NULL OR state IS NOT NULL").withColumn("extracted_pages", F.col("extract_progress.extracted_pages")).withColumn("total_pages", F.col("extract_progress.total_pages")).drop("extract_progress")


def _fields(ddl: str) -> str:
    """A DDL list of plain and struct columns as the fields of a struct type."""
    return ",".join(f"{n}:{t}" for n, t in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def latest_uploads(uploads: DataFrame) -> DataFrame:
    """The newest path of each session, by time and then path."""
    return uploads.groupBy("session_id").agg(F.max(F.struct("ts", "path")).alias("u")).select("session_id", "u.path", "u.ts")


def expired_sessions(uploads: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """(session_id, last_ts) of sessions whose last upload is older than the time to live."""
    last = uploads.groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    return last.where(F.col("last_ts") < now - F.make_dt_interval(hours=F.lit(hours)))
