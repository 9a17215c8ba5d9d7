"""The job log: queries over jobs, events folded into their state, recovery at the start, and the rules of what may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.folds import folded

STAGES = ("ingesting", "queued", "extracting", "cleaning", "synthesizing", "assembling", "ready", "delivering", "done", "failed", "cancelled")
ENDED = ("done", "failed", "cancelled")
RUNNING = ("extracting", "cleaning", "synthesizing", "assembling", "delivering")
CONVERTING = ("extracting", "cleaning", "synthesizing", "assembling")
PAGE, RETRY_SECONDS = 7, 120
#: Which stage may follow which.
NEXT = {"ingesting": ("queued",), "queued": ("extracting",), "extracting": ("cleaning",), "cleaning": ("synthesizing",), "synthesizing": ("assembling",), "assembling": ("ready",), "ready": ("delivering",), "delivering": ("done", "ready"), "done": (), "failed": ("queued",), "cancelled": ("queued",)}
ACTIONS = {"cancel": ("queued", *CONVERTING), "retry": ("failed", "cancelled"), "publish": ("ready",), "restore": ("done",)}


def latest_by_hash(jobs: DataFrame, active_only: bool) -> DataFrame:
    """content_hash and its last job, of all or of those that have not ended."""
    known = jobs.where(~F.col("stage").isin(*ENDED)) if active_only else jobs
    return known.groupBy("content_hash").agg(F.max("id").alias("id"), F.max_by("stage", "id").alias("stage"))


def next_queued(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("stage") == "queued").orderBy("id").limit(1)


def active_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("stage").isin(*RUNNING)).orderBy("id").limit(1)


def page(jobs: DataFrame, stage: str | None = None, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of jobs, newest first."""
    chosen = jobs.where(F.col("stage") == stage) if stage else jobs
    return chosen.orderBy(F.col("id").desc()).offset(max(0, (number - 1) * size)).limit(max(1, size))


def counts(jobs: DataFrame) -> DataFrame:
    """stage, n, pages: the jobs of each stage and the pages that show them."""
    return jobs.groupBy("stage").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.count("*") / PAGE)).cast("long").alias("pages"))


def by_stages(jobs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    return jobs.where(F.col("stage").isin(*stages))


def ready_undelivered(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("stage") == "ready") & ~F.col("delivered") & (F.col("output_paths") != ""))


def resolve_target(jobs: DataFrame, action: str, explicit: int | None = None) -> DataFrame:
    """The job that an action means: the one named, else the one that runs (to cancel), else the oldest or newest that fits."""
    if explicit is not None:
        return jobs.where(F.col("id") == explicit)
    fits = jobs.where(F.col("stage").isin(*ACTIONS[action]) & (F.lit(action not in ("publish", "restore")) | (F.col("output_paths") != "")))
    running = F.when(F.col("stage").isin(*RUNNING), 0).otherwise(1) if action == "cancel" else F.lit(False)
    return fits.orderBy(running, F.col("id").desc() if action == "retry" else F.col("id").asc()).limit(1)


def allowed_actions(jobs: DataFrame) -> DataFrame:
    """jobs and actions: what may be done with each, as a sorted array."""
    outputs = F.col("output_paths") != ""
    each = [F.when(F.col("stage").isin(*stages) & (outputs if a in ("publish", "restore") else F.lit(True)), F.lit(a)) for a, stages in ACTIONS.items()]
    return jobs.withColumn("actions", F.sort_array(F.filter(F.array(*each), lambda a: a.isNotNull())))


def transition(current: Column, wanted: Column) -> Column:
    """The stage after an event that asks for one: it moves only where NEXT allows, or to failed and cancelled unless it has ended."""
    allowed = F.lit(False)
    for stage, following in NEXT.items():
        allowed = allowed | (current == stage) & wanted.isin(*following) if following else allowed
    ends = wanted.isin("failed", "cancelled") & ~current.isin(*ENDED)
    return F.when(allowed | ends, wanted).otherwise(current)


def fold_events(events: DataFrame, key: str = "id") -> DataFrame:
    """The state of each job after its events in order of seq.

    events: id, seq, kind (stage, progress, meta, outputs, error, delivered, delivery_error), value. Stage events are compare-and-set: one
    that is not allowed from the current stage changes nothing. Progress is clamped to 0..1; delivery clears its error.
    """
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "value"))).alias("_all"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("ingesting").alias("stage"), F.lit(0.0).alias("progress"), none.alias("title"), F.lit("").alias("output_paths"), none.alias("error"), F.lit(False).alias("delivered"), none.alias("delivery_error"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        is_ = lambda k: e["kind"] == k
        to = F.when(is_("stage"), transition(s["stage"], e["value"])).otherwise(s["stage"])
        moved = is_("stage") & (to == e["value"]) & (to != s["stage"])
        done = e["value"].try_cast("double")
        return F.struct(
            to.alias("stage"),
            F.when(moved & (to == "ready"), F.lit(1.0)).when(is_("progress"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(done, F.lit(0.0))))).otherwise(s["progress"]).alias("progress"),
            F.when(is_("meta"), e["value"]).otherwise(s["title"]).alias("title"),
            F.when(is_("outputs"), e["value"]).otherwise(s["output_paths"]).alias("output_paths"),
            F.when(moved & (to == "ready"), none).when(is_("error"), e["value"]).otherwise(s["error"]).alias("error"),
            F.when(is_("delivered"), e["value"] == "true").otherwise(s["delivered"]).alias("delivered"),
            F.when(is_("delivered") & (e["value"] == "true"), none).when(is_("delivery_error"), e["value"]).otherwise(s["delivery_error"]).alias("delivery_error"),
            (s["refused"] + F.when(is_("stage") & ~moved, 1).otherwise(0)).alias("refused"),
        )

    return ordered.select(key, F.aggregate("_all", start, step).alias("_s")).select(key, "_s.*")


def requeue(jobs: DataFrame) -> DataFrame:
    """jobs and requeued: failed and cancelled ones go back to the queue, unless another job of their content is active."""
    active = jobs.where(~F.col("stage").isin(*ENDED)).select("content_hash").distinct().withColumn("_busy", F.lit(True))
    free = F.col("stage").isin("failed", "cancelled") & F.col("_busy").isNull()
    return jobs.join(active, "content_hash", "left").withColumn("requeued", free).withColumn("stage", F.when(free, F.lit("queued")).otherwise(F.col("stage"))).drop("_busy")


def reconcile(jobs: DataFrame) -> DataFrame:
    """jobs as a start finds them: work that was cut off begins again. staged: whether the taken-in file is whole."""
    stage = F.col("stage")
    new = F.when(stage == "ingesting", F.when(F.col("staged"), "queued").otherwise("failed")).when(stage == "delivering", "ready").when(stage.isin(*CONVERTING), "queued").otherwise(stage)
    back = stage == "delivering"
    return jobs.withColumn("_new", new).withColumn("changed", F.col("_new") != stage).withColumn("progress", F.when(back, F.lit(1.0)).otherwise(F.col("progress"))).withColumn("delivered", F.when(back, F.lit(False)).otherwise(F.col("delivered"))).withColumn("stage", F.col("_new")).drop("_new")


def retry_due(jobs: DataFrame, now: Column) -> DataFrame:
    """The ready job to deliver next: of those not tried for RETRY_SECONDS, the one tried longest ago."""
    last = F.coalesce(F.col("last_attempt").cast("double"), F.lit(-1e9))
    return ready_undelivered(jobs).where(now - last >= RETRY_SECONDS).withColumn("_last", last).orderBy("_last", "id").limit(1).drop("_last")


def orphans(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Staging folders that no job refers to, and always _incoming."""
    used = jobs.select(F.regexp_extract("source_path", r"([^/]+)/[^/]*$", 1).alias("name")).distinct()
    return folders.where(F.col("name") != "_incoming").join(used, "name", "left_anti").union(folders.where(F.col("name") == "_incoming"))


def stable_polls(polls: DataFrame) -> DataFrame:
    """The polls at which a file's size and time are those of the poll before; the batch form of the streaming debounce."""
    w = Window.partitionBy("path").orderBy("poll_no")
    same = F.lag(F.struct("size", "mtime")).over(w) == F.struct("size", "mtime")
    return polls.where("size > 0").withColumn("_same", same & (F.lag("poll_no").over(w) == F.col("poll_no") - 1)).where("_same").drop("_same")


def throttled(events: DataFrame, key: str, seconds: int = 60, most: int = 1_000_000) -> DataFrame:
    """key, ts, suppressed: the events that a log line is written for, each at least `seconds` after the one before, and how many it stands for.

    Events without a time are left out.
    """

    def step(state: tuple, ts: float) -> tuple:
        last, held = state
        if last is None or ts - last >= seconds:
            return (ts, 0), (ts, held)
        return (last, min(held + 1, most)), None

    timed = events.where("ts is not null").select(key, F.col("ts").cast("double").alias("ts"))
    return folded(timed, key, ["ts"], ["ts"], "ts double, suppressed long", (None, 0), step)


def confirmed(requests: DataFrame, confirms: DataFrame, seconds: int = 120) -> DataFrame:
    """Requests confirmed by their own user within the time, each by the first confirmation only."""
    c = confirms.select(F.col("token"), F.col("user_id"), F.col("ts").alias("confirmed_at"))
    hits = requests.join(c, ["token", "user_id"]).where((F.col("confirmed_at") >= F.col("ts")) & (F.col("confirmed_at") - F.col("ts") <= seconds))
    return hits.groupBy("token", "user_id", "ts").agg(F.min("confirmed_at").alias("confirmed_at"))


def progress(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chunks and progress: the share of a key's chunks that are done up to each."""
    done = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return chunks.withColumn("progress", F.least(F.lit(1.0), done / F.count("*").over(Window.partitionBy(key))))
