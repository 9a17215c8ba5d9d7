"""Bytes to text: encodings, plain text, Markdown, HTML and RTF, and the choice between formats."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from narrata.functions import rx
from narrata.functions.letters import text_score

# Code pages in the order in which ties are decided, the sample that is scored, and the formats' endings.
CHARSETS = ("windows-1251", "koi8-r", "ibm866", "iso-8859-5")
SAMPLE, SNIFF, PRINTABLE, LEAST_CHARS = 262_144, 8192, 0.85, 30
TEXT, MARKUP = (".txt", ".text", ".log"), {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".xhtml": "html", ".rtf": "rtf", ".fb2": "fb2", ".epub": "epub"}
BLOCKS = frozenset("address article blockquote dd div dl dt h1 h2 h3 h4 h5 h6 header li main ol p pre section table td th tr ul".split())


def decoded(content: Column) -> Column:
    """Text of bytes: by its mark, as UTF-8 if it is valid, else by the code page whose text looks most like prose.

    Needs spark.sql.legacy.javaCharsets for the code pages (narrata.session sets it).
    """
    options = F.array(*(F.struct(text_score(F.substring(F.decode(content, c), 1, SAMPLE)).alias("score"), F.lit(-i).alias("rank"), F.decode(content, c).alias("text")) for i, c in enumerate(CHARSETS)))
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(F.octet_length(content) == 0, F.lit(""))
        .when(head == "EFBBBF", F.decode(F.substring(content, 4, 2**31 - 1), "UTF-8"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.array_max(options)["text"])
    )


class _Reader(HTMLParser):
    """Text of HTML: blocks on lines of their own, inline tags without a trace, notes' references left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.spaced: list[bool] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag == self.skip[0]:
                self.skip.append(tag)
            return
        marks = f"{a.get('epub:type', '')} {a.get('role', '')} {a.get('class', '')}".lower()
        if tag in ("script", "style", "head") or tag in ("sup", "sub", "a") and ("noteref" in marks or tag != "a" and re.search("footnote|endnote|fnref", marks)):
            self.skip.append(tag)
        elif tag == "a" and self.spaced and re.match(r"#(?:fn|note|footnote|endnote)(?:\d|[-_])", a.get("href", "").lower()):
            self.spaced[-1] = True
        elif tag in ("sup", "sub"):
            self.out.append(" \0")
            self.spaced.append(False)
        elif tag == "br" or tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        if tag in ("sup", "sub") and self.spaced:
            at = max(i for i, s in enumerate(self.out) if s == " \0")
            if self.spaced.pop():
                del self.out[at:]
            else:
                self.out[at] = " "
                self.out.append(" ")
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(page: str) -> str:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return html.unescape("".join(reader.out).replace("\0", ""))


def markdown_text(source: str) -> str:
    """Markdown without its marks: what its rendering to HTML would show."""
    lines, fenced = [], False
    for line in source.split("\n"):
        if re.match(r" {0,3}(```|~~~)", line):
            fenced = not fenced
            continue
        if not fenced:
            if re.match(r" {0,3}([-*_])( *\1){2,} *$|\s*\[[^\]]+\]:\s", line) or re.match(r" {0,3}(=+|-+) *$", line):
                continue
            line = re.sub(r"^ {0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d{1,9}[.)]\s+)+", "", line)
            line = re.sub(r"\s#+\s*$", "", line)
            line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)|!?\[([^\]]*)\]\[[^\]]*\]", lambda m: m[1] or m[2] or "", line)
            line = re.sub(r"(\*\*|__|\*|_|`+|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
            line = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", line)
        lines.append(line)
    return html_text("\n".join(lines))


RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
RTF_SKIPPED = frozenset(b"fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object themedata datastore listtable listoverridetable generator".split())
RTF_BREAKS = {b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•", b"cell": "\t", b"row": "\n"}


def rtf_text(raw: bytes) -> str:
    """Text of RTF in the code page that its head names (windows-1251 if none)."""
    page = re.search(rb"\\ansicpg(\d+)", raw[:4096])
    charset = f"cp{int(page[1])}" if page else "cp1251"
    try:
        b"".decode(charset)
    except LookupError:
        charset = "cp1251"
    out, held, groups, skip = [], b"", [], False

    def flush():
        nonlocal held
        if held:
            out.append(held.decode(charset, "replace"))
            held = b""

    for m in RTF.finditer(raw):
        if m[6]:
            flush()
            if m[6] == b"{":
                groups.append(skip)
            elif groups:
                skip = groups.pop()
        elif m[3] and m[3] in RTF_SKIPPED or m[5] == b"*":
            skip = True
        elif skip:
            continue
        elif m[1]:
            held += bytes([int(m[1], 16)])
        elif m[7]:
            held += m[7]
        else:
            flush()
            if m[2]:
                out.append(chr(int(m[2]) % 65536))
            elif m[3]:
                out.append(RTF_BREAKS.get(m[3], ""))
            elif m[5] in (b"\\", b"{", b"}"):
                out.append(m[5].decode())
            elif m[5] == b"~":
                out.append("\u00a0")
    flush()
    return "".join(out)


def _mapped(f):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    return run


strip_html, strip_markdown, strip_rtf = _mapped(html_text), _mapped(markdown_text), _mapped(rtf_text)
normalized = _mapped(lambda s: unicodedata.normalize("NFC", s))


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", "content")


def extracted(files: DataFrame) -> DataFrame:
    """path, content -> path, text, status: text by format; a file of another suffix is text if most of its start is printable.

    FB2 and EPUB have readers of their own (sources.books).
    """
    kind = F.col("_suffix")
    start = decoded(F.substring("content", 1, SNIFF))
    printable = rx.count_of(start, r"\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t") / F.greatest(F.length(start), F.lit(1)) >= PRINTABLE
    f = files.withColumn("_suffix", suffix(F.col("path"))).withColumn("_text", decoded(F.col("content")))
    formats = {k: [s for s, v in MARKUP.items() if v == k] for k in set(MARKUP.values())}
    plain = f.where(~kind.isin(*MARKUP)).withColumn("text", F.when(kind.isin(*TEXT) | printable, F.col("_text")))
    parts = [plain, f.where(kind.isin(*formats["html"])).withColumn("text", strip_html("_text")), f.where(kind.isin(*formats["markdown"])).withColumn("text", strip_markdown("_text")), f.where(kind.isin(*formats["rtf"])).withColumn("text", strip_rtf("content"))]
    out = parts[0].select("path", "content", "text")
    for p in parts[1:]:
        out = out.unionByName(p.select("path", "content", "text"))
    n = F.length(rx.strip(F.col("text")))
    status = F.when(F.octet_length("content") == 0, "empty").when(F.col("text").isNull(), "unknown format").when(n < 1, "no text").when(n < LEAST_CHARS, "too little").otherwise("ok")
    return out.select("path", "text", status.alias("status"))


def caption_fields(caption: Column) -> Column:
    """map<string,string>: "Автор: …" and the like, one a line, keys in any case, values of 200 characters at most, the last wins."""
    keys = {"автор": "author", "название": "title", "серия": "series", "номер": "series_index"}
    row = lambda l: F.struct(rx.strip(F.lower(F.regexp_extract(l, r"(?s)^([^:]*):", 1))).alias("k"), F.substring(rx.strip(F.regexp_extract(l, r"(?s)^[^:]*:(.*)$", 1)), 1, 200).alias("v"))
    names = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv))
    rows = F.filter(F.transform(F.split(F.coalesce(caption, F.lit("")), r"\r\n|\r|\n"), row), lambda r: r["k"].isin(*keys) & (r["v"] != ""))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(F.element_at(names, r["k"]), r["v"])))
