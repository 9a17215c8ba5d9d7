"""Letters: Roman numerals, Latin written in Cyrillic, names of files and shares, text scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import rx

# Letter groups, in the order in which they are tried, and single letters.
DIGRAPHS = (("sch", "ш"), ("sh", "ш"), ("ch", "ч"), ("ph", "ф"), ("th", "т"), ("zh", "ж"), ("kh", "х"), ("qu", "кв"), ("ck", "к"), ("ya", "я"), ("yu", "ю"), ("yo", "йо"), ("ja", "я"), ("ju", "ю"))
DOUBLE = (("x", "кс"), ("j", "дж"))
SINGLE = ("abcdefghiklmnopqrstuvwyz", "абкдефгхиклмнопкрстуввиз")
ROMAN = {"M": 1000, "CM": 900, "D": 500, "CD": 400, "C": 100, "XC": 90, "L": 50, "XL": 40, "X": 10, "IX": 9, "V": 5, "IV": 4, "I": 1}
ROMAN_TOKEN, ROMAN_VALID = r"\b[IVXLCDM]{1,15}\b", r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
CENTURY = {"век": "й", "века": "го", "веке": "м", "веку": "му", "веком": "ым", "веков": "х", "веках": "х"}
FREQUENT, FOREIGN = "оеаинтсрвлкмд", "ђѓјљњћќџѕЂЃЈЉЊЋЌЏЅ"


def transliterated(x: Column) -> Column:
    """Latin letters in Cyrillic; groups first. Replacing groups one after the other equals a scan from left to right."""
    low = lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    x = low(x)
    for a, b in (*DIGRAPHS, *DOUBLE):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.translate(x, *SINGLE)


def roman_value(x: Column) -> Column:
    """Of a valid numeral: what the two-letter signs and the single ones left beside them add up to."""
    total, rest = F.lit(0), x
    for sign in sorted(ROMAN, key=len, reverse=True):
        bare = F.replace(rest, F.lit(sign), F.lit(""))
        total = total + (F.length(rest) - F.length(bare)) / len(sign) * ROMAN[sign]
        rest = bare
    return total.cast("int")


def roman_to_arabic(x: Column) -> Column:
    """Strict numerals become digits (single letters only I, V, X), with an ordinal's ending before a word for century."""

    def spoken(hit: Column) -> Column:
        token = F.regexp_extract(hit, "^[IVXLCDM]+", 0)
        tail = F.substring(hit, F.length(token) + 1, F.length(hit))
        ending = F.lit("")
        for word, suffix in CENTURY.items():
            ending = F.when(F.lower(rx.strip(tail)) == word, F.lit("-" + suffix)).otherwise(ending)
        valid = token.rlike(ROMAN_VALID) & ((F.length(token) > 1) | token.isin("I", "V", "X"))
        return F.when(valid, F.concat(roman_value(token).cast("string"), ending, tail)).otherwise(hit)

    return rx.sub_with(x, ROMAN_TOKEN + rf"(?:\s+(?iu:{'|'.join(CENTURY)})\b)?", spoken)


def metadata_text(x: Column) -> Column:
    return F.nullif(rx.strip(rx.sub(x, rf"[{rx.WHITE}]+", " ")), F.lit(""))


def cut_bytes(x: Column, n: int) -> Column:
    """The longest beginning of x within n bytes of UTF-8, not inside a character."""
    raw = F.encode(x, "UTF-8")
    cut = F.substring(raw, 1, n)
    tries = [F.try_validate_utf8(F.substring(raw, 1, n - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(raw) <= n, x).otherwise(F.coalesce(*tries, cut.cast("string")))


def safe_filename(x: Column, fallback: str = "audiobook", most: int = 120) -> Column:
    """A name that every file system takes. The input is taken to be in NFC (sources.text.normalized puts it so)."""
    x = F.regexp_replace(rx.strip(F.coalesce(x, F.lit(""))), r'[\\/:*?"<>|\x00-\x1f]', " ")
    x = F.regexp_replace(rx.strip(rx.sub(x, r"\s+", " ")), r"\.+", ".")
    x = F.coalesce(F.nullif(F.regexp_replace(x, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(fallback))
    x = F.when(F.octet_length(x) > most, F.regexp_replace(cut_bytes(x, most), "[. ]+$", "")).otherwise(x)
    x = F.when(F.upper(x).isin("CON", "PRN", "AUX", "NUL"), F.concat(F.lit("_"), x)).otherwise(x)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def fitted_filename(x: Column, most: int = 200) -> Column:
    """A file name within so many bytes that keeps its suffix, if that has 16 at most."""
    suffix = F.regexp_extract(x, r"(?s)[^.](\.[^./.]+)$", 1)
    suffix = F.when(F.octet_length(suffix) <= 16, suffix).otherwise(F.lit(""))
    stem = F.substring(x, F.lit(1), F.length(x) - F.length(suffix))
    chars = F.transform(F.split(stem, ""), lambda c: F.octet_length(c))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"))
    fits = F.aggregate(chars, start, lambda acc, n: F.when((acc["bytes"] + n <= most - F.octet_length(suffix)) & (acc["bytes"] >= 0), F.struct((acc["n"] + 1).alias("n"), (acc["bytes"] + n).alias("bytes"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(-(1 << 30)).alias("bytes"))))["n"]
    kept = F.regexp_replace(F.substring(stem, F.lit(1), fits), "[ .]+$", "")
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.coalesce(F.nullif(kept, F.lit("")), F.lit("upload")), suffix))


def clipped(x: Column, most: int = 4096) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def escaped_excerpt(x: Column, most: int) -> Column:
    """HTML-escaped beginning of x within `most` characters, never cut inside a reference; "..." tells that more follows."""
    units = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.when(c == "&", F.lit("&amp;")).when(c == "<", F.lit("&lt;")).when(c == ">", F.lit("&gt;")).when(c == '"', F.lit("&quot;")).when(c == "'", F.lit("&#x27;")).otherwise(c))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    step = lambda acc, u: F.when(acc["full"] | (F.length(acc["out"]) + F.length(u) > most), F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(acc["out"], u).alias("out"), F.lit(False).alias("full")))
    return F.aggregate(units, start, step, lambda acc: F.when(acc["full"], F.concat(acc["out"], F.lit("..."))).otherwise(acc["out"]))


def meta_escaped(x: Column) -> Column:
    """A value of the chapter file: four characters escaped, lines put together."""
    return rx.strip(F.regexp_replace(F.regexp_replace(x, r"([\\=;#])", r"\\$1"), r"\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " "))


def bitrate(x: Column) -> Column:
    """Bits per second of "64k", "1.5m" or "64000"; null if it is none of these or not positive."""
    s = F.lower(rx.strip(x))
    value = lambda of, by: F.floor(of.cast("double") * by).cast("long")
    plain = r"^\d+(\.\d+)?"
    out = F.when(s.rlike(plain + "k$"), value(F.regexp_extract(s, r"^([\d.]+)", 1), 1000)).when(s.rlike(plain + "m$"), value(F.regexp_extract(s, r"^([\d.]+)", 1), 1_000_000)).when(s.rlike(r"^\d+$"), s.cast("long"))
    return F.when(out > 0, out)


def cyrillic_ratio(x: Column) -> Column:
    letters = rx.count_of(x, r"\p{L}")
    return F.when(letters > 0, rx.count_of(x, r"\x{400}-\x{4FF}") / letters).otherwise(F.lit(0.0))


def text_score(x: Column) -> Column:
    """How much a decoded text looks like prose; the weights are fixed values."""
    n, cyrillic = F.length(x), rx.count_of(x, r"\x{400}-\x{4FF}")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words = F.regexp_extract_all(x, F.lit("[А-яЁё]{2,}"), F.lit(0))
    inverted = F.size(F.filter(words, lambda w: w.rlike("^[а-яё][А-ЯЁ]+$")))
    printable = rx.count_of(x, r"\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t")
    visible = F.greatest(F.length(rx.sub(x, r"\s", "")), F.lit(1))
    frequent = share(rx.count_of(x, FREQUENT + FREQUENT.upper()), cyrillic)
    score = cyrillic_ratio(x) * 0.5 + frequent + printable / n * 0.3 - rx.count_of(x, r"\x{FFFD}") / n * 3 - share(rx.count_of(x, FOREIGN), cyrillic) * 5 - rx.count_of(x, r"\x{2500}-\x{259F}") / visible * 3 - share(inverted, F.size(words)) * 3
    return F.when(n == 0, F.lit(-9.0)).otherwise(score)
