"""Content identity: fingerprints, duplicates, plan digests, resumable work, receipts; quality ledgers and archive limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_ENDS = ("done", "failed", "cancelled")
# Limits of what is taken in, and of archives.
MOST_BYTES = 200 << 20
BLOCKED = (".pdf", ".doc", ".docx", ".zip", ".mobi", ".djvu", ".jpg", ".png", ".mp3", ".m4b", ".exe")
MEMBERS, MEMBER_BYTES, TOTAL_BYTES, RATIO, MEMBER_FROM, TOTAL_FROM = 100_000, 512 << 20, 1 << 30, 200, 16 << 20, 256 << 20
STORED, DEFLATED = 0, 8
#: Rows of one key that a task takes, and the keys that may have more.
HOT_ROWS, MOST_HOT = 100_000, 1024
LOUD, VOICED_PART, FRAMES_PART = 64, 50, 12


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def first_of_each(items: DataFrame, key: str, order: str) -> DataFrame:
    """items, and duplicate_of: the first in order with the same key (null for itself, and where the key is null).

    One summed row for each key is joined back. The rows of a key that very many share (an empty text, say) are dealt over
    several tasks, HOT_ROWS or so to each; these keys are the MOST_HOT most frequent ones at most, so they can be broadcast.
    """
    first = items.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    hot = first.where((F.col("_n") > HOT_ROWS) & F.col(key).isNotNull()).orderBy(F.desc("_n")).limit(MOST_HOT)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_salts")))
    first = first.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", "_n")
    dealt = items.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(order), F.when(F.col(key).isNull(), MOST_HOT).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int"))
    found = dealt.join(first, [key, "_salt"], "left")
    return found.withColumn("duplicate_of", F.when(F.col(order) > F.col("_first"), F.col("_first"))).select(*items.columns, "duplicate_of")


def rejected_duplicates(new: DataFrame, jobs: DataFrame, any_stage: bool) -> DataFrame:
    """Rows of new (content_hash) that a job already has: an active one, or one in any stage."""
    known = jobs if any_stage else jobs.where(~F.col("stage").isin(*ACTIVE_ENDS))
    return new.join(known.select("content_hash").distinct(), "content_hash", "left_semi")


def plan_digest(plan: DataFrame) -> DataFrame:
    """doc_id, digest: SHA-256 of a plan's canonical JSON (keys in order, no spaces)."""
    row = F.struct(F.col("chapter_index"), F.col("chapter_title"), F.col("index"), F.col("text"))
    ordered = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", row.alias("row")))).alias("all"))
    return ordered.select("doc_id", F.sha2(F.to_json(F.col("all.row"), {"ignoreNullFields": "false"}), 256).alias("digest"))


def work_list(plan: DataFrame, cached: DataFrame) -> DataFrame:
    """The chunks to compute: those without a valid artefact of the same plan digest."""
    return plan.join(cached.where("valid"), ["doc_id", "digest", "index"], "left_anti")


def verified_receipts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """receipt_id, ok: every listed file is there with its size and hash, in its place, and no other is."""
    e = expected.select("receipt_id", "pos", F.struct("name", "size", "sha256").alias("e"))
    f = found.select("receipt_id", "pos", F.struct("name", "size", "sha256").alias("f"))
    return e.join(f, ["receipt_id", "pos"], "full_outer").groupBy("receipt_id").agg(F.bool_and(F.col("e").eqNullSafe(F.col("f"))).alias("ok"))


def pcm_valid(samples: Column, rate: Column, channels: Column, width: Column, speech: bool = True) -> Column:
    """Mono, 16 bits, and for speech long and loud enough."""
    form = (channels == 1) & (width == 2) & (F.size(samples) > 0)
    if not speech:
        return form
    voiced = F.size(F.filter(samples, lambda s: F.abs(s) >= LOUD))
    return form & (F.size(samples) >= rate / FRAMES_PART) & (voiced >= rate / VOICED_PART)


def silence_runs(outcomes: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """key, n, failed, longest: outcomes of each key, the failed ones and their longest run without a success."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = outcomes.withColumn("_run", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "_run").agg(F.count("*").alias("_n"), F.sum((~F.col(ok)).cast("long")).alias("_failed"))
    return runs.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_failed").alias("failed"), F.max("_failed").alias("longest"))


def silence_aborts(runs: DataFrame) -> DataFrame:
    """Whether so many chunks failed that the work should stop: all, 3 in a row, or more than max(3, a tenth)."""
    stop = (F.col("failed") == F.col("n")) & (F.col("n") > 0) | (F.col("longest") >= 3) | (F.col("failed") > F.greatest(F.lit(3), F.ceil(F.col("n") / 10)))
    return runs.withColumn("abort", stop)


def archive_verdicts(members: DataFrame) -> DataFrame:
    """archive, reason: the first rule that an archive breaks in the order of its members; null if none.

    members: archive, pos, file_size, compress_size, compress_type.
    """
    w = Window.partitionBy("archive").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = members.withColumn("_total", F.sum("file_size").over(w)).withColumn("_packed", F.sum("compress_size").over(w))
    ratio = lambda a, b: a > RATIO * F.greatest(b, F.lit(1))
    rule = (
        F.when(~F.col("compress_type").isin(STORED, DEFLATED), "compression")
        .when(F.col("file_size") > MEMBER_BYTES, "member size")
        .when((F.col("file_size") > MEMBER_FROM) & ratio(F.col("file_size"), F.col("compress_size")), "member ratio")
        .when(F.col("_total") > TOTAL_BYTES, "total size")
    )
    agg = running.withColumn("_rule", rule).groupBy("archive").agg(F.count("*").alias("n"), F.sum("file_size").alias("size"), F.sum("compress_size").alias("packed"), F.min_by("_rule", F.when(F.col("_rule").isNotNull(), F.col("pos"))).alias("first"))
    whole = F.when(F.col("n") > MEMBERS, F.lit("members")).otherwise(F.coalesce("first", F.when((F.col("size") > TOTAL_FROM) & ratio(F.col("size"), F.col("packed")), F.lit("total ratio"))))
    return agg.select("archive", "n", whole.alias("reason"))


def taken_in(files: DataFrame) -> DataFrame:
    """files with a status: why one is not taken in, by the first rule that it breaks.

    files: path, length; where known is_link and is_regular (of the path, unresolved), mtime, and length_after and
    mtime_after as they were when the copy was done. A null in one of these breaks no rule; a null length is empty.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    said = lambda c: F.coalesce(c, F.lit(False))
    changed = [F.col(c) != F.col(f"{c}_after") for c in ("length", "mtime") if {c, f"{c}_after"} <= set(files.columns)]
    rules = [
        (name.startswith(".") | name.endswith(".part"), "skipped"),
        (F.regexp_extract(name, r"\.[^.]*$", 0).isin(*BLOCKED), "format"),
        *([(F.col("is_link"), "link")] if "is_link" in files.columns else []),
        *([(~F.col("is_regular"), "not a file")] if "is_regular" in files.columns else []),
        (F.coalesce("length", F.lit(0)) <= 0, "empty"),
        (F.col("length") > MOST_BYTES, "too large"),
        *((c, "changed") for c in changed),
    ]
    status = F.lit("ok")
    for broken, why in reversed(rules):
        status = F.when(said(broken), why).otherwise(status)
    return files.withColumn("status", status)


def member_path_safe(path: Column) -> Column:
    """Whether an archive path stays inside the archive."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda acc, p: F.struct(F.when(p == "..", acc["d"] - 1).otherwise(acc["d"] + 1).alias("d"), (acc["ok"] & ((p != "..") | (acc["d"] > 0))).alias("ok")))
    return depth["ok"] & (F.size(parts) > 0) & ~path.rlike(r"^(/|\\|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)") & ~path.contains("\x00")
