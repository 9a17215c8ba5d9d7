"""Sentence split and the packing of sentences into size-bounded chunks, as folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import rx

MARK = "\ue000"
# Abbreviations whose period ends no sentence unless a letter follows, and the boundary's characters.
PROTECTED = ("др", "пр", "т", "е", "к", "н", "г", "д", "стр", "с", "в", "р", "руб", "коп")
BOUNDARY = r"""([.!?…]+[»"'”)\]]*)\s+(?=[«"'“(\[—–-]?[А-ЯЁA-Z0-9])"""
CHUNK, FLOOR, SPARE = 800, 200, 200
#: How often a piece that a voice refuses may be halved.
HALVINGS = 3


def protected(x: Column) -> Column:
    """Periods of initials and of known abbreviations become MARK."""
    x = first = F.regexp_replace(x, r"(?<![А-ЯЁA-Z])([А-ЯЁA-Z])\.", "$1" + MARK)
    for a in PROTECTED:
        x = F.regexp_replace(x, rf"(?iuU)\b{a}\.(?!\s+[А-ЯЁA-Z])", a + MARK)
    return F.when(first.rlike(r"\p{IsCyrillic}\."), x).otherwise(first)


def sentences(x: Column) -> Column:
    """array<string>: trimmed sentences; one without a final mark gets a period."""
    pieces = F.split(F.regexp_replace(protected(x), rx.U + BOUNDARY, "$1\n"), "\n", -1)
    pieces = F.filter(F.transform(pieces, lambda p: rx.strip(F.replace(p, F.lit(MARK), F.lit(".")))), lambda p: p != "")
    return F.transform(pieces, lambda p: F.when(p.rlike(r"[\p{L}\p{N}]\z"), F.concat(p, F.lit("."))).otherwise(p))


def hard_max(chunk: int) -> int:
    return max(chunk, FLOOR) + SPARE


def hard_split(x: Column, most: int) -> Column:
    """array<string>: a text of over `most` characters by words; a word of over `most` in slices."""
    none = F.expr("cast(array() as array<string>)")
    slices = lambda w: F.when(F.length(w) <= most, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / most).cast("int")), lambda i: F.substring(w, i * most + 1, F.lit(most))))
    units = F.flatten(F.transform(F.split(x, " ", -1), lambda w: F.transform(slices(w), lambda s: F.struct(s.alias("s"), (F.length(w) > most).alias("whole")))))
    start = F.struct(none.alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("any"))

    def step(acc: Column, u: Column) -> Column:
        done = F.when(acc["any"], F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        alone = F.struct(F.concat(done, F.array(u["s"])).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("any"))
        full = acc["any"] & (acc["n"] + F.length(u["s"]) + 1 > most)
        fresh = F.struct(done.alias("out"), u["s"].alias("cur"), (F.length(u["s"]) + 1).alias("n"), F.lit(True).alias("any"))
        longer = F.struct(acc["out"].alias("out"), F.when(acc["any"], F.concat(acc["cur"], F.lit(" "), u["s"])).otherwise(u["s"]).alias("cur"), (acc["n"] + F.length(u["s"]) + 1).alias("n"), F.lit(True).alias("any"))
        return F.when(u["whole"], alone).when(full, fresh).otherwise(longer)

    end = lambda acc: F.when(acc["any"], F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
    return F.when(F.length(x) <= most, F.array(x)).otherwise(F.aggregate(units, start, step, end))


def packed(pieces: Column, chunk: int = CHUNK) -> Column:
    """array<string>: pieces joined by a space as long as the sum of their lengths, each plus 1, stays within `chunk`."""
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("out"), none.alias("buf"), F.lit(0).alias("n"))
    flush = lambda acc: F.concat(acc["out"], F.array(F.array_join(acc["buf"], " ")))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(p) + 1 > chunk)
        return F.when(full, F.struct(flush(acc).alias("out"), F.array(p).alias("buf"), (F.length(p) + 1).alias("n"))).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["buf"], F.array(p)).alias("buf"), (acc["n"] + F.length(p) + 1).alias("n")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["n"] > 0, flush(acc)).otherwise(acc["out"]))


def pieces(text: Column, chunk: int = CHUNK) -> Column:
    return F.flatten(F.transform(sentences(text), lambda s: hard_split(s, hard_max(chunk))))


def build_plan(chapters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chapter_index, title, text -> doc_id, index, chapter_index, chapter_title, text.

    Chapters are packed apart; the title stands on a chapter's first chunk; index runs over the document.
    """
    from pyspark.sql import Window

    chunks = chapters.withColumn("_pieces", pieces(F.col("text"), chunk)).withColumn("_chunks", packed(F.col("_pieces"), chunk))
    rows = chunks.select("doc_id", "chapter_index", "title", F.posexplode("_chunks").alias("_pos", "chunk"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_index", "_pos")) - 1
    return rows.select("doc_id", index.alias("index"), "chapter_index", F.when(F.col("_pos") == 0, F.col("title")).alias("chapter_title"), F.col("chunk").alias("text"))


def halves(x: Column) -> Column:
    """array of two strings: x cut nearest its middle at a sentence, else a clause, else a space, with something to say on both sides; or null."""
    out = F.lit(None).cast("array<string>")
    for p in (r"\s+", r"[,;:–]\s+", r"[.!?…]+\s+"):
        gaps, hits = F.split(x, rx.U + p, -1), F.regexp_extract_all(x, F.lit(rx.U + p), F.lit(0))
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        ends = F.aggregate(both, F.expr("cast(array() as array<int>)"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.when(F.size(acc) > 0, F.element_at(acc, -1)), F.lit(0)))))
        cut = lambda c: F.array(rx.strip(F.substring(x, F.lit(1), c)), rx.strip(F.substring(x, c + 1, F.length(x))))
        speakable = F.filter(ends, lambda c: (c < F.length(x)) & F.forall(cut(c), has_speakable))
        best = F.array_min(F.transform(speakable, lambda c: F.struct(F.abs(c - F.length(x) / 2).alias("d"), c.alias("c"))))["c"]
        out = F.when(best.isNotNull(), cut(best)).otherwise(out)
    return out


def halved(x: Column, too_long: Callable[[Column], Column], depth: int = HALVINGS) -> Column:
    """array<string>: x, each piece that is too long halved, and again up to depth times; what can't be cut stays whole."""
    parts = F.array(x)
    for _ in range(depth):
        parts = F.flatten(F.transform(parts, lambda p: F.when(too_long(p), F.coalesce(halves(p), F.array(p))).otherwise(F.array(p))))
    return parts


def has_speakable(x: Column) -> Column:
    return x.rlike(r"[\p{L}\p{N}]")


def prosody(x: Column) -> Column:
    """Separators as the pauses that a voice can speak."""
    x = F.regexp_replace(x, "[\u2010-\u2015\u2043\u207b\u2212\ufe58\ufe63\uff0d]", ", ")
    x = F.regexp_replace(F.replace(x, F.lit("…"), F.lit(". ")), r"[*]+", " ")
    x = rx.sub(rx.sub(x, r"\s+", " "), r"(?:,\s*){2,}", ", ")
    x = rx.sub(rx.sub(x, r"\s+([,.!?:;])", "$1"), r"\A[\s,.:;!?]+", "")
    return rx.strip(x)


def within_symbols(x: Column, symbols: str, dash: str = "–") -> Column:
    """Only a voice's symbols (letters of either case) stay; other dashes become its own, the rest spaces."""
    kept = "".join(sorted(set(symbols) | set(symbols.upper()) | set(symbols.lower())))
    x = F.regexp_replace(x, "[" + "".join(c for c in "\u2014\u2015\u2012\u2212\ufe58\ufe63\uff0d" if c not in kept) + "]", dash)
    x = F.regexp_replace(x, "[^" + "".join(rf"\x{{{ord(c):x}}}" for c in kept + dash) + "]", " ")
    x = rx.sub(rx.sub(x, r"\s+", " "), r"\s+([,.!?:;])", "$1")
    x = rx.sub(rx.sub(x, r"([,.!?:;])(?:\s*[,.!?:;])+", "$1"), r"\A[\s,.:;!?–-]+", "")
    return rx.strip(x)
