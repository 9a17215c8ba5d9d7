"""Chapter times, titles and parts of a sequence of timed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.letters import meta_escaped
from narrata.operators.folds import folded

HEADROOM, LEAST_SECONDS = 0.97, 0.5


def duration(frames: Column, rate: Column, tempo: float = 1.0) -> Column:
    return frames / rate / tempo


def milliseconds(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 0).cast("long")


def chapter_spans(infos: DataFrame) -> DataFrame:
    """doc_id, index, chapter_index, duration -> doc_id, span, chapter_index, start_ms, end_ms.

    A span is a run of chunks of one chapter; it lasts 1 ms at least.
    """
    order = Window.partitionBy("doc_id").orderBy("index")
    timed = infos.withColumn("ms", milliseconds(F.col("duration"))).withColumn("end", F.sum("ms").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    timed = timed.withColumn("new", (~F.col("chapter_index").eqNullSafe(F.lag("chapter_index").over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    spans = timed.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).groupBy("doc_id", "span")
    out = spans.agg(F.min("chapter_index").alias("chapter_index"), F.min(F.col("end") - F.col("ms")).alias("start_ms"), F.max("end").alias("end_ms"))
    return out.select("doc_id", "span", "chapter_index", "start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"))


def chapter_titles(plan: DataFrame) -> DataFrame:
    """doc_id, chapter_index, title: that of a chapter's first chunk, else its number in order of appearance."""
    first = plan.groupBy("doc_id", "chapter_index").agg(F.min("index").alias("at"), F.min_by("chapter_title", "index").alias("own"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return first.select("doc_id", "chapter_index", F.coalesce(F.nullif("own", F.lit("")), F.concat(F.lit("Глава "), number.cast("string"))).alias("title"))


def has_structure(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_id").agg((F.count_distinct("chapter_index") > 1).alias("has_structure"))


def parts(infos: DataFrame, bits_per_second: int, mib: int) -> DataFrame:
    """doc_id, index, duration -> and part: chunks packed in order, each part within the size; a null duration takes no room."""
    most, rate = mib * 1024 * 1024 * HEADROOM, bits_per_second / 8

    def step(state: tuple, index: int, duration: float | None) -> tuple:
        part, size = state
        own = (duration or 0.0) * rate
        part, size = (part + 1, own) if size > 0 and size + own > most else (part, size + own)
        return (part, size), (index, part)

    timed = infos.select("doc_id", F.col("index").cast("long").alias("index"), F.col("duration").cast("double").alias("duration"))
    return folded(timed, "doc_id", ["index"], ["index", "duration"], "index long, part int", (1, 0.0), step)


def part_title(title: Column, part: Column, of: Column) -> Column:
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("Аудиокнига"))
    return F.when(of > 1, F.concat(title, F.lit(" (часть "), part.cast("string"), F.lit(")"))).otherwise(title)


def chapter_file(spans: DataFrame, books: DataFrame) -> DataFrame:
    """doc_id, text: the chapter file of each document. spans: with title; books: doc_id, title, author."""
    e = meta_escaped
    line = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), e(F.col("title")))
    lines = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span", line.alias("line")))).alias("all"))
    head = F.concat_ws("\n", F.lit(";FFMETADATA1"), F.concat(F.lit("title="), e(F.coalesce("title", F.lit("Аудиокнига")))), F.concat(F.lit("artist="), e(F.col("author"))), F.concat(F.lit("album_artist="), e(F.col("author"))), F.concat(F.lit("album="), e(F.coalesce("title", F.lit("Аудиокнига")))), F.lit("genre=Audiobook"), F.lit("media_type=2"))
    return books.join(lines, "doc_id", "left").select("doc_id", F.concat(F.concat_ws("\n", head, F.array_join(F.col("all.line"), "\n")), F.lit("\n")).alias("text"))
