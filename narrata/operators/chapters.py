"""Chapters: headings in plain text, first lines as titles, and chapter rows from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import rx
from narrata.functions.speech import clean_text

LEAST_HEADINGS, LONGEST_TITLE = 2, 80
# What a heading is made of.
ORDINAL = "(?:(?:двадцать|тридцать|сорок|пятьдесят|шестьдесят|семьдесят|восемьдесят|девяносто|сто)[ \\t]+)?(?:перв|втор|трет|четв[её]рт|пят|шест|седьм|восьм|девят|десят|одиннадцат|двенадцат|тринадцат|четырнадцат|пятнадцат|шестнадцат|семнадцат|восемнадцат|девятнадцат|двадцат|тридцат|сороков|пятидесят|шестидесят|семидесят|восьмидесят|девяност|сот|последн|заключительн)[а-яё]*"
TAIL = r'(?:[ \t]*[.:—–-]?[ \t]*[А-ЯЁA-Z«"(\d][^\n]{0,80})?[ \t]*[.:]?'
HEADING = rf"(?mdU)^[ \t]*((?iu:глава|часть)[ \t]+(?:[\dIVXLCDMМ]+(?:-[а-яё]{{1,2}})?\b|(?iu:{ORDINAL})){TAIL}|(?iu:пролог|эпилог|вступление|предисловие|послесловие)(?:[ \t]*[.:—–-][ \t]*[^\n]{{0,80}})?|(?iu:chapter)[ \t]+\d+\b{TAIL})[ \t]*$"


def split_chapters(x: Column) -> Column:
    """array<struct<title, text>>: the parts of a plain text under its headings; one untitled part if there are fewer than two.

    What precedes the first heading has no title; a part without a body is dropped, but the heading of a part ("часть") is
    carried into the next title.
    """
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bodies = F.transform(F.split(x, HEADING, -1), lambda b: rx.strip(b))
    titles = F.transform(F.regexp_extract_all(x, F.lit(HEADING), F.lit(1)), lambda h: rx.strip(h))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), rx.strip(x).alias("text")))
    none = F.expr("cast(array() as array<struct<title:string,text:string>>)")
    pairs = F.zip_with(titles, F.slice(bodies, F.lit(2), F.size(titles)), lambda t, b: F.struct(t.alias("title"), b.alias("text")))

    def step(acc: Column, p: Column) -> Column:
        carried = F.when(p["title"].rlike(r"^(?iuU)часть\b"), p["title"]).otherwise(acc["part"])
        title = F.when(acc["part"].isNotNull(), F.concat(F.regexp_replace(acc["part"], "[.:]+$", ""), F.lit(". "), p["title"])).otherwise(p["title"])
        kept = F.struct(F.concat(acc["out"], F.array(F.struct(title.alias("title"), p["text"].alias("text")))).alias("out"), F.lit(None).cast("string").alias("part"))
        return F.when(p["text"] == "", F.struct(acc["out"].alias("out"), carried.alias("part"))).otherwise(kept)

    first = F.element_at(bodies, 1)
    start = F.struct(F.when(first != "", F.array(F.struct(F.lit(None).cast("string").alias("title"), first.alias("text")))).otherwise(none).alias("out"), F.lit(None).cast("string").alias("part"))
    found = F.aggregate(pairs, start, step)["out"]
    return F.when((F.size(titles) >= LEAST_HEADINGS) & (F.size(found) > 0), found).otherwise(whole)


def chapter_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, chapter_index, title, text."""
    return docs.select("doc_id", F.posexplode(split_chapters(F.col("text"))).alias("chapter_index", "c")).select("doc_id", "chapter_index", "c.title", "c.text")


def clean_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters cleaned for a voice; blank ones go."""
    out = chapters.withColumn("text", clean_text(F.col("text"))).withColumn("title", rx.strip(F.col("title")))
    return out.where(rx.strip(F.col("text")) != "")


def with_spoken_titles(chapters: DataFrame) -> DataFrame:
    """A chapter's title, cleaned, spoken before its body; the title itself stays as it is."""
    said = clean_text(F.col("title"))
    return chapters.withColumn("_said", said).withColumn("text", F.when(F.coalesce(F.col("_said"), F.lit("")) != "", F.concat("_said", F.lit(".\n"), "text")).otherwise(F.col("text"))).drop("_said")


def first_line_title(x: Column) -> Column:
    """struct<title, body>: the first line with text, if short, is the title, and leaves the body unless it is all of it."""
    lines = F.filter(F.transform(F.split(x, "\n", -1), lambda l: rx.strip(l)), lambda l: l != "")
    first = F.get(lines, F.lit(0))
    rest = rx.strip(F.substring(rx.strip(x), F.length(first) + 1, F.length(x)))
    short = F.length(first) <= LONGEST_TITLE
    return F.struct(F.when(short, first).alias("title"), F.when(short & (rest != ""), rest).otherwise(rx.strip(x)).alias("body"))
