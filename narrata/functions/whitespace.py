"""Line, quote and artefact rules of prose clean-up; each is one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import rx

# Particles that keep their hyphen over a line break, and the heads that "то", "ка", "таки" need.
ALWAYS_TAILS = ("нибудь", "либо")
TAILS = ("то", "ка", "таки")
HEADS = ("что", "кто", "где", "куда", "когда", "как", "какой", "какая", "какое", "какие", "чей", "чья", "чьё", "почему", "зачем", "откуда", "отчего", "сколько", "всё", "все", "давай", "дай", "ну", "скажи", "смотри")
LIGATURES = (("⁈", "?!"), ("⁉", "!?"), ("‼", "!!"), ("⁇", "??"))
QUOTES = ("“”„‟‘’‚‛", "«»«»''''")
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
HOMOGLYPHS = ("aceopxykACEHKMOPTXBY", "асеорхукАСЕНКМОРТХВУ")
#: A private-use character; stands for a hyphen or period that later rules must not touch.
MARK = "\ue000"


def newlines(x: Column) -> Column:
    """One kind of line break, no soft hyphens, plain spaces for the three kinds of no-break space."""
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(x, "\u00a0\u202f\u2007\u00ad", "   ")


def trailing_blanks(x: Column) -> Column:
    return F.regexp_replace(x, r"[ \t]+\n", "\n")


def joined_hyphens(x: Column) -> Column:
    """Words broken at a line end are put together; compounds keep their hyphen."""
    head, tail = r"(\b\w*[а-яёА-ЯЁ])-[ \t]*\n\s*", r"([а-яёa-z]\w*)"
    fold = "(?iu:"
    kept = (
        rf"(\b\w*[а-яёА-ЯЁ])-[ \t]*\n\s*({fold}{'|'.join(ALWAYS_TAILS)}))(?!\w)",
        rf"\b({fold}кое))-[ \t]*\n\s*([а-яёa-z]\w*)",
        rf"\b({fold}{'|'.join(HEADS)}))-[ \t]*\n\s*({fold}{'|'.join(TAILS)}))(?!\w)",
    )
    joined = x
    for p in kept:
        joined = F.regexp_replace(joined, rx.U + p, f"$1{MARK}$2")
    joined = F.replace(F.regexp_replace(joined, rx.U + head + tail, "$1$2"), F.lit(MARK), F.lit("-"))
    return F.when(x.rlike(r"[а-яёА-ЯЁ]-[ \t]*\n"), joined).otherwise(x)


def whitespace_normalized(x: Column) -> Column:
    return trailing_blanks(joined_hyphens(newlines(x)))


def ligatures(x: Column) -> Column:
    for a, b in LIGATURES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def without_folios(x: Column) -> Column:
    """Lines that hold only a page number between dashes go."""
    return F.array_join(F.filter(F.split(x, "\n", -1), lambda l: ~l.rlike(rx.U + r"\A\s*[-—–]\s*\d{1,4}\s*[-—–]\s*\z")), "\n")


def without_notes(x: Column) -> Column:
    return rx.sub(x, r"[\[{]\s*\d{1,3}\s*[\]}]", "")


def superscripts(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, f"([{SUPERSCRIPTS[0]}]+)", " $1"), *SUPERSCRIPTS)


def blank_runs(x: Column) -> Column:
    return rx.sub(x, r"\n\s*\n(\s*\n)+", "\n\n")


def without_artifacts(x: Column) -> Column:
    return blank_runs(superscripts(without_notes(without_folios(x))))


def quotes(x: Column) -> Column:
    return F.replace(F.translate(x, *QUOTES), F.lit("''"), F.lit('"'))


def reflowed(x: Column) -> Column:
    """Hard-wrapped lines run on; a line stays where the one before ends a sentence or it opens with a dash."""
    x = rx.sub(rx.strip(x), r"[^\S\n]*\n[^\S\n]*", "\n")
    x = F.regexp_replace(x, r"\n{2,}", "\n\n")
    return rx.sub(x, r'(?<![.!?…»"”)\n])\n(?!\n|[—–-][^\S\n])', " ")


def homoglyphs(x: Column) -> Column:
    """Latin look-alikes in words that also have Cyrillic letters."""
    mixed = rx.sub_with(x, r"\b(?=\w*[А-Яа-яЁё])(?=\w*[A-Za-z])\w+\b", lambda w: F.translate(w, *HOMOGLYPHS))
    return F.when(x.rlike("[А-Яа-яЁё]"), mixed).otherwise(x)


def plus_spoken(x: Column) -> Column:
    return F.regexp_replace(x, r"[ \t]*\+[ \t]*", " плюс ")


def tidy(x: Column) -> Column:
    return rx.strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
