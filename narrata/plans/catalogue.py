"""The engine's queries over the test tables, each beside the SQL that states its result.

Russian rules need Russian text, which the tables lack: such queries build it from table columns (carriers), the same way
in Spark and in SQL.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from narrata.functions import letters, rx, speech, whitespace
from narrata.functions import numbers_ru as ru
from narrata.operators import chapters, identity, jobs, sentences, timeline
from narrata.session import tuned
from narrata.sources import books, sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a file that can't be split into as many parts as there are cores is dealt out, others stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None, heavy: bool = False):
    """Registers a function of (spark, table) where table(name) reads a table. heavy: more work on a row than it takes to move it."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tuned(spark)
            read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(spark, (lambda name: spread(read(name))) if heavy else read)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def one(name: str, table: str, key: str, column: Callable, sql: str, more: str = "") -> None:
    """A query of one expression: key, and out."""
    query(f"WITH t AS (SELECT * FROM {table}) SELECT {key}, {sql} AS out FROM t{more}")(_named(name, lambda spark, t: t(table).select(key, column().alias("out"))))


def _named(name: str, f):
    f.__name__ = name
    return f


# --- segmentation -----------------------------------------------------------------------------------------------------

WS = r"[\s\x1c-\x1f]"
INITIALS = r"regexp_replace(regexp_replace(text, '(^|[^А-ЯЁA-Z])([А-ЯЁA-Z])\.', '\1\2' || chr(57344), 'g'), '(^|[^А-ЯЁA-Z])([А-ЯЁA-Z])\.', '\1\2' || chr(57344), 'g')"
SPLIT = rf"""string_split(regexp_replace({INITIALS}, '([.!?…]+[»"''”)\]]*)\s+([«"''“(\[—–-]?[А-ЯЁA-Z0-9])', '\1' || chr(10) || '\2', 'g'), chr(10))"""
SENTENCES = rf"""list_transform(list_filter(list_transform({SPLIT}, lambda p: regexp_replace(replace(p, chr(57344), '.'), '^\s+|\s+$', '', 'g')), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '[\p{{L}}\p{{N}}]$') THEN p || '.' ELSE p END)"""


@query(rf"""WITH s AS (SELECT source, unnest({SENTENCES}) AS s FROM documents)
SELECT source, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, max(length(s)) AS longest FROM s GROUP BY source""", heavy=True)
def sentence_counts(spark, t):
    s = t("documents").select("source", F.explode(sentences.sentences(F.col("text"))).alias("s"))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).cast("long").alias("longest"))


def hard_sql(x: str, most: int) -> str:
    """The hard split of a text as SQL: a list of texts."""
    step = f"""CASE WHEN length(w.cur) > {most} THEN {{'out': list_concat(list_concat(a.out, CASE WHEN a.held THEN [a.cur] ELSE [] END), list_transform(range(0, length(w.cur), {most}), lambda i: substr(w.cur, i::INT + 1, {most}))), 'cur': '', 'n': 0::BIGINT, 'held': false}}
  WHEN a.held AND a.n + length(w.cur) + 1 > {most} THEN {{'out': list_append(a.out, a.cur), 'cur': w.cur, 'n': length(w.cur) + 1, 'held': true}}
  ELSE {{'out': a.out, 'cur': CASE WHEN a.held THEN a.cur || ' ' || w.cur ELSE w.cur END, 'n': a.n + length(w.cur) + 1, 'held': true}} END"""
    words = f"list_transform(string_split({x}, ' '), lambda w: {{'out': []::VARCHAR[], 'cur': w, 'n': 0::BIGINT, 'held': true}})"
    fold = f"list_reduce({words}, lambda a, w: {step}, {{'out': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT, 'held': false}})"
    return f"CASE WHEN length({x}) <= {most} THEN [{x}] ELSE list_transform([{fold}], lambda f: CASE WHEN f.held THEN list_append(f.out, f.cur) ELSE f.out END)[1] END"


PIECES = "flatten(list_transform(ps, lambda p: " + hard_sql("p", 1000) + "))"
#: ls, a list of pieces, as a list of chunks.
PACK = """list_transform([list_reduce(list_transform(ls, lambda p: {'out': []::VARCHAR[], 'buf': [p], 'n': 0::BIGINT}), lambda a, p: CASE WHEN a.n > 0 AND a.n + length(p.buf[1]) + 1 > 800
  THEN {'out': list_append(a.out, array_to_string(a.buf, ' ')), 'buf': p.buf, 'n': length(p.buf[1]) + 1} ELSE {'out': a.out, 'buf': list_concat(a.buf, p.buf), 'n': a.n + length(p.buf[1]) + 1} END, {'out': []::VARCHAR[], 'buf': []::VARCHAR[], 'n': 0::BIGINT})],
  lambda f: CASE WHEN f.n > 0 THEN list_append(f.out, array_to_string(f.buf, ' ')) ELSE f.out END)[1]"""


@query(rf"""WITH s AS (SELECT source, {SENTENCES} AS ps FROM documents), p AS (SELECT source, {PIECES} AS ls FROM s), c AS (SELECT source, unnest({PACK}) AS c FROM p)
SELECT source, count(*) AS chunks, max(length(c)) AS longest FROM c GROUP BY source""", heavy=True)
def chunk_plan_sizes(spark, t):
    """The chunks of every text: sentences of any length, split hard where they are longer than a chunk may be."""
    chunks = t("documents").select("source", F.explode(sentences.packed(sentences.pieces(F.col("text")))).alias("c"))
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.max(F.length("c")).cast("long").alias("longest"))


@query(rf"""WITH b AS (SELECT doc_id, regexp_replace(text || ' ' || repeat('word ', 300) || repeat('y', 2500) || '.', '^\s+|\s+$', '', 'g') AS text FROM documents),
k AS (SELECT doc_id, 0 AS chapter_index, 'Глава 1' AS title, text FROM b UNION ALL SELECT doc_id, 1, 'Часть вторая. Глава 2', 'Конец ' || doc_id || ' и всё' FROM b),
s AS (SELECT doc_id, chapter_index, title, {SENTENCES} AS ps FROM k), p AS (SELECT *, {PIECES} AS ls FROM s), c AS (SELECT doc_id, chapter_index, title, {PACK} AS cs FROM p),
u AS (SELECT doc_id, chapter_index, title, unnest(cs) AS text, generate_subscripts(cs, 1) AS pos FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, pos) - 1 AS INT) AS index, CAST(chapter_index AS INT) AS chapter_index, CASE WHEN pos = 1 THEN title END AS chapter_title, text FROM u""", heavy=True)
def chunk_plan(spark, t):
    """The whole plan of every document, as a book of two chapters: the text, with a sentence and a word that are too long, and an end."""
    book = F.concat(F.lit("Глава 1\n"), "text", F.lit(" "), F.repeat(F.lit("word "), F.lit(300)), F.repeat(F.lit("y"), F.lit(2500)), F.lit(".\nЧасть вторая\nГлава 2\nКонец "), F.col("doc_id").cast("string"), F.lit(" и всё"))
    return sentences.build_plan(chapters.chapter_rows(t("documents").select("doc_id", book.alias("text"))))


@query(f"SELECT doc_id, CAST(len({hard_sql('text', 200)}) AS BIGINT) AS pieces FROM (SELECT doc_id, text || ' ' || repeat('z', 450) || ' end' AS text FROM documents)", heavy=True)
def chunk_hard_split(spark, t):
    """Every text, with a word that is too long, in pieces of at most 200 characters."""
    return t("documents").select("doc_id", F.size(sentences.hard_split(F.concat("text", F.lit(" "), F.repeat(F.lit("z"), F.lit(450)), F.lit(" end")), 200)).cast("long").alias("pieces"))


# --- clean-up rules ---------------------------------------------------------------------------------------------------

one("whitespace_normalize", "documents", "doc_id", lambda: whitespace.trailing_blanks(whitespace.newlines(F.concat("text", F.lit("  \r\nx y\rz­ \n")))), r"regexp_replace(replace(replace(replace(replace(text || '  ' || chr(13) || chr(10) || 'x' || chr(160) || 'y' || chr(13) || 'z' || chr(173) || ' ' || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(173), ''), '[ \t]+\n', chr(10), 'g')")
one("tidy_spaces", "documents", "doc_id", lambda: whitespace.tidy(F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".   ")), F.lit("\n\n\n\nend "))), r"regexp_replace(regexp_replace(regexp_replace('  ' || replace(text, '. ', '.   ') || repeat(chr(10), 4) || 'end ', '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
one("reflow_lines", "documents", "doc_id", lambda: whitespace.reflowed(F.replace("text", F.lit(" a"), F.lit("\na"))), r"""array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(replace(text, ' a', chr(10) || 'a'), '\n\s*\n'), lambda p: list_filter(list_transform(string_split(p, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')), lambda p: len(p) > 0),
  lambda p: list_reduce(p, lambda a, l: a || CASE WHEN regexp_matches(l, '^[—–-]\s') OR regexp_matches(a, '[.!?…»"”)]$') THEN chr(10) ELSE ' ' END || l)), chr(10) || chr(10))""")
one("quote_normalize", "documents", "doc_id", lambda: whitespace.quotes(F.concat(F.lit("“"), "text", F.lit("” „x‟ ‘’ it’s"))), "replace(translate('“' || text || '” „x‟ ‘’ it’s', '“”„‟‘’‚‛', '«»«»'''''''''), '''''', '\"')")
one("punctuation_ligatures", "documents", "doc_id", lambda: whitespace.ligatures(F.concat("text", F.lit("⁈ ⁉ ‼ ⁇"))), "replace(replace(replace(replace(text || '⁈ ⁉ ‼ ⁇', '⁈', '?!'), '⁉', '!?'), '‼', '!!'), '⁇', '??')")
one("plus_spoken", "documents", "doc_id", lambda: whitespace.plus_spoken(F.col("text")), r"regexp_replace(text, '[ \t]*\+[ \t]*', ' плюс ', 'g')")
one("transliterate_latin", "documents", "doc_id", lambda: letters.transliterated(F.col("text")), "translate(" + "replace(" * 16 + "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" + "".join(f", '{a}', '{b}')" for a, b in (*letters.DIGRAPHS, *letters.DOUBLE)) + f", '{letters.SINGLE[0]}', '{letters.SINGLE[1]}')")
one("strip_footnote_markers", "orders", "o_orderkey", lambda: whitespace.without_notes(F.concat(F.lit("Слово["), (F.col("o_orderkey") % 1500).cast("string"), F.lit("] и { 12 } конец"))), r"regexp_replace('Слово[' || (o_orderkey % 1500) || '] и { 12 } конец', '[\[{]\s*\d{1,3}\s*[\]}]', '', 'g')")
one("superscript_digits", "orders", "o_orderkey", lambda: whitespace.superscripts(F.concat(F.lit("м"), F.translate((F.col("o_orderkey") % 1000).cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"))), "'м ' || (o_orderkey % 1000)")
FOLIO = "'a' || chr(10) || ' - ' || (o_orderkey % 20000) || ' — ' || chr(10) || 'b' || chr(10) || (o_orderkey % 7)"
one("drop_folio_lines", "orders", "o_orderkey", lambda: whitespace.without_folios(F.concat(F.lit("a\n - "), (F.col("o_orderkey") % 20000).cast("string"), F.lit(" — \nb\n"), (F.col("o_orderkey") % 7).cast("string"))), rf"array_to_string(list_filter(string_split({FOLIO}, chr(10)), lambda l: NOT regexp_matches(l, '^\s*[-—–]\s*\d{{1,4}}\s*[-—–]\s*$')), chr(10))")
one("collapse_blank_lines", "documents", "doc_id", lambda: whitespace.blank_runs(F.replace("text", F.lit("\n"), F.lit("\n \n\n"))), r"regexp_replace(replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)), '\n\s*\n(\s*\n)+', chr(10) || chr(10), 'g')")
TAILS = ["нибудь", "то", "во", "либо", "ка", "ни"]
HEADS = ["кто", "сло", "кое", "мес", "скажи"]
pick = lambda words, n, by: F.element_at(F.array(*map(F.lit, words)), (F.col(n) / by % len(words)).cast("int") + 1)
picked = lambda words, n, by: f"[{', '.join(repr(w) for w in words)}][CAST(floor({n} / {by}) AS BIGINT) % {len(words)} + 1]"
one("join_hyphens", "orders", "o_orderkey", lambda: whitespace.joined_hyphens(F.concat(F.lit("и "), pick(HEADS, "o_orderkey", 1), F.lit("-\n "), pick(TAILS, "o_orderkey", 7), F.lit(" там"))), f"'и ' || {picked(HEADS, 'o_orderkey', 1)} || CASE WHEN {picked(TAILS, 'o_orderkey', 7)} IN ('нибудь', 'либо') OR {picked(HEADS, 'o_orderkey', 1)} = 'кое' OR {picked(TAILS, 'o_orderkey', 7)} IN ('то', 'ка') AND {picked(HEADS, 'o_orderkey', 1)} IN ('кто', 'скажи') THEN '-' ELSE '' END || {picked(TAILS, 'o_orderkey', 7)} || ' там'")
MIXED = ["pека", "cад", "дом", "pock", "Mосква", "x1ц"]
FIXED = ["река", "сад", "дом", "pock", "Москва", "х1ц"]
one("homoglyph_repair", "orders", "o_orderkey", lambda: whitespace.homoglyphs(F.concat(pick(MIXED, "o_orderkey", 1), F.lit(" и "), pick(MIXED, "o_orderkey", 7))), f"{picked(FIXED, 'o_orderkey', 1)} || ' и ' || {picked(FIXED, 'o_orderkey', 7)}")
one("prosody_sanitize", "documents", "doc_id", lambda: sentences.prosody(F.col("text")), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[‐‑‒–—―⁃−]', ', ', 'g'), '…', '. '), '[*]+', ' ', 'g'), '\s+', ' ', 'g'), '(?:,\s*){2,}', ', ', 'g'), '\s+([,.!?:;])', '\1', 'g'), '^[\s,.:;!?]+', ''), '^\s+|\s+$', '', 'g')")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz,.!?:; "
one("symbol_filter", "documents", "doc_id", lambda: sentences.within_symbols(F.col("text"), SYMBOLS), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[—―‒−]', '–', 'g'), '[^a-zA-Z,.!?:; –]', ' ', 'g'), '\s+', ' ', 'g'), '\s+([,.!?:;])', '\1', 'g'), '([,.!?:;])(?:\s*[,.!?:;])+', '\1', 'g'), '^[\s,.:;!?–-]+', ''), '^\s+|\s+$', '', 'g')")
one("speakable_filter", "documents", "doc_id", lambda: sentences.has_speakable(F.regexp_replace(F.col("text"), "[a-zA-Z]", "")), r"regexp_matches(regexp_replace(text, '[a-zA-Z]', '', 'g'), '[\p{L}\p{N}]')")
one("metadata_text", "documents", "doc_id", lambda: letters.metadata_text(F.col("text")), r"nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')")
one("first_line_title", "documents", "doc_id", lambda: F.concat_ws("|", F.coalesce(chapters.first_line_title(F.col("text"))["title"], F.lit("-")), F.length(chapters.first_line_title(F.col("text"))["body"]).cast("string")), r"""CASE WHEN length(regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], '\s+$', '')) <= 80 THEN regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], '\s+$', '') ELSE '-' END || '|' ||
  CASE WHEN length(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1]) <= 80 AND instr(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) > 0
  THEN length(regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), length(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1]) + 1), '^\s+|\s+$', '', 'g')) ELSE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) END""")
one("letter_ratio_score", "documents", "doc_id", lambda: F.round(letters.cyrillic_ratio(F.concat("text", F.lit("Привет"))), 6), r"round(CAST(length(regexp_replace(text || 'Привет', '[^\p{Cyrillic}]', '', 'g')) AS DOUBLE) / length(regexp_replace(text || 'Привет', '[^\p{L}]', '', 'g')), 6)")
one("content_fingerprint", "documents", "doc_id", lambda: identity.fingerprint(F.encode("text", "UTF-8")), "sha256(text)")
one("clip_text", "documents", "doc_id", lambda: letters.clipped(F.col("text"), 1000), "CASE WHEN length(text) > 1000 THEN substr(text, 1, 999) || '…' ELSE text END")
one("escape_meta", "documents", "doc_id", lambda: letters.meta_escaped(F.concat("text", F.lit("\r\n= a;b#c\\ "))), r"regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || '= a;b#c\ ', '([\\=;#])', '\\\1', 'g'), '\r\n|[\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g')")
one("html_to_text", "pages", "page_id", lambda: rx.strip(rx.sub(text.strip_html("html"), r"\s+", " ")), r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
  '(?i)</?(address|article|blockquote|dd|div|dl|dt|h1|h2|h3|h4|h5|h6|header|li|main|ol|p|pre|section|table|td|th|tr|ul|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))""")
one("safe_filename", "part", "p_partkey", lambda: letters.safe_filename(F.concat(F.lit(" ."), "p_name", F.lit("/: ..x"), "p_type", F.lit("? "))), r"""rtrim(substr(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(' .' || p_name || '/: ..x' || p_type || '? ', '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), '\.+', '.', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 120), '. ')""")
one("library_path", "part", "p_partkey", lambda: sinks.library_path(F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Цикл")), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit("s.fb2"), F.sha2("p_name", 256), F.col("p_partkey")), "CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'Неизвестный автор' END || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'Цикл/' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || ' - ' ELSE '' END || p_name || ' [' || substr(sha256(p_name), 1, 12) || '-' || p_partkey || ']'")
one("output_name", "part", "p_partkey", lambda: sinks.output_name(F.concat("p_name", F.lit(" .")), (F.col("p_size") % 12 + 1).cast("int"), F.col("p_size") % 3), "p_name || CASE WHEN p_size % 3 > 1 THEN '_part_' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') ELSE '' END || '.m4b'")
one("bitrate_parse", "part", "p_partkey", lambda: F.coalesce(letters.bitrate(F.element_at(F.array(F.concat(F.col("p_size").cast("string"), F.lit("k")), F.concat(F.col("p_size").cast("string"), F.lit(".5M ")), (F.col("p_size") * 1000).cast("string"), F.lit("fast")), (F.col("p_partkey") % 4).cast("int") + 1)), F.lit(-1)), "CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000000 + 500000 WHEN 2 THEN p_size * 1000 ELSE -1 END::BIGINT")
one("package_file", "part", "p_partkey", lambda: sinks.package_file(F.col("p_name"), F.lit("A & B"), F.col("p_brand"), F.col("p_size").cast("string"), F.lit("x.txt"), "Silero xenia"), """'<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<opf:package xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf" version="2.0"><opf:metadata><dc:title>' || p_name || '</dc:title><dc:creator>A &amp; B</dc:creator><dc:language>ru</dc:language><dc:creator opf:role="nrt">Silero xenia</dc:creator><opf:meta name="calibre:series" content="' || p_brand || '" /><opf:meta name="calibre:series_index" content="' || p_size || '" /></opf:metadata></opf:package>'""")
one("caption_fields", "part", "p_partkey", lambda: F.concat_ws("|", *(F.coalesce(F.element_at(text.caption_fields(F.concat(F.lit(" автор : x\nАвтор: "), "p_brand", F.lit("\nНазвание:"), "p_name", F.lit("\nЖанр: y\nСерия: "))), k), F.lit("-")) for k in ("author", "title", "series"))), "p_brand || '|' || p_name || '|-'")
one("member_path_safe", "part", "p_partkey", lambda: identity.member_path_safe(pick(["../x.jpg", "a/../b.png", "/etc/x", "http://h/x", "a\\..\\..\\x", "c/d.xhtml"], "p_partkey", 1)), "[false, true, false, false, false, true][p_partkey % 6 + 1]")

one("base_name", "part", "p_partkey", lambda: sinks.base_name(F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), F.when(F.col("p_partkey") % 2 > 0, F.col("p_brand")).otherwise(F.lit("")), F.concat(F.lit("a/b."), F.col("p_partkey").cast("string"), F.lit(".fb2"))), "CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN p_brand || ' - ' || p_name WHEN p_partkey % 3 > 0 THEN p_name ELSE 'b.' || p_partkey END")
one("fitted_filename", "part", "p_partkey", lambda: letters.fitted_filename(F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_partkey") % 2 == 0, F.lit(".fb2")).otherwise(F.lit(".a_very_long_suffix"))), 36), """CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN length(p_name || ' ' || p_type) <= 32 THEN p_name || ' ' || p_type ELSE rtrim(substr(p_name || ' ' || p_type, 1, 32), ' .') END || '.fb2'
  WHEN length(p_name || ' ' || p_type) <= 17 THEN p_name || ' ' || p_type || '.a_very_long_suffix' ELSE rtrim(substr(p_name || ' ' || p_type || '.a_very_long_suffix', 1, 36), ' .') END""")
ESCAPED = "list_transform(string_split(p_name || ' & <' || p_type || '>', ''), lambda c: CASE c WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' WHEN '>' THEN '&gt;' ELSE c END)"
one("escaped_excerpt", "part", "p_partkey", lambda: letters.escaped_excerpt(F.concat("p_name", F.lit(" & <"), "p_type", F.lit(">")), 30), f"""list_transform([list_reduce(list_transform({ESCAPED}, lambda u: {{'o': u, 'f': false}}), lambda a, u: CASE WHEN a.f OR length(a.o) + length(u.o) > 30 THEN {{'o': a.o, 'f': true}} ELSE {{'o': a.o || u.o, 'f': false}} END, {{'o': '', 'f': false}})], lambda a: a.o || CASE WHEN a.f THEN '...' ELSE '' END)[1]""")
one("short_title", "documents", "doc_id", lambda: letters.clipped(letters.metadata_text(F.col("text")), 300), r"CASE WHEN length(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')) > 300 THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 299) || '…' ELSE nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') END")
one("chunk_duration", "lineitem", "l_orderkey", lambda: F.round(timeline.duration(F.floor(F.col("l_extendedprice")), F.lit(24000), 1.25), 9), "round(floor(l_extendedprice) / 24000 / 1.25, 9)")
CYRILLIC = "length(regexp_replace(x, '[^\\x{400}-\\x{4FF}]', '', 'g'))"
one("text_score", "orders", "o_orderkey", lambda: F.round(letters.text_score(F.concat(F.element_at(F.array(F.lit("Привет, мир "), F.lit("пРИВЕТ ђ "), F.lit("plain text "), F.lit("▒▓\ufffd ")), (F.col("o_orderkey") % 4).cast("int") + 1), F.col("o_orderkey").cast("string"))), 6), f"""list_transform([['Привет, мир ', 'пРИВЕТ ђ ', 'plain text ', '▒▓�' || ' '][o_orderkey % 4 + 1] || o_orderkey], lambda x: round({CYRILLIC}::DOUBLE / greatest(length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')), 1) * 0.5
  + length(regexp_replace(x, '[^{letters.FREQUENT}{letters.FREQUENT.upper()}]', '', 'g'))::DOUBLE / greatest({CYRILLIC}, 1) + length(regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} \\n\\r\\t]', '', 'g'))::DOUBLE / length(x) * 0.3
  - length(regexp_replace(x, '[^�]', '', 'g'))::DOUBLE / length(x) * 3 - length(regexp_replace(x, '[^{letters.FOREIGN}]', '', 'g'))::DOUBLE / greatest({CYRILLIC}, 1) * 5 - length(regexp_replace(x, '[^▒▓]', '', 'g'))::DOUBLE / length(regexp_replace(x, '\\s', '', 'g')) * 3 - CASE WHEN o_orderkey % 4 = 1 THEN 3.0 ELSE 0 END, 6))[1]""")

# --- files ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey || ['.txt', '.md', '.html', '.rtf', '.dat', '.bin', '.TXT'][p_partkey % 7 + 1] AS path, CASE p_partkey % 7 WHEN 1 THEN p_name || ' ' || p_type || chr(10) || 'bold ' || p_brand || ' & <more> of it ' || repeat('z', 60) WHEN 5 THEN NULL WHEN 6 THEN '' ELSE p_name || ' & ' || p_type || ' ' || p_brand || repeat('z', 60) END AS out,
  CASE p_partkey % 7 WHEN 5 THEN 'unknown format' WHEN 6 THEN 'empty' ELSE 'ok' END AS status FROM part""", heavy=True)
def file_formats(spark, t):
    """Files of each format, made from columns, come back as the text that they were made from."""
    name, kind, brand, tail = F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit("z" * 60)
    plain = F.concat(name, F.lit(" & "), kind, F.lit(" "), brand, tail)
    markdown = F.concat(F.lit("# "), name, F.lit(" "), kind, F.lit("\n**bold** [`"), brand, F.lit("`](http://x) &amp; &lt;more\\> *of it* "), tail)
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), name, F.lit(" &amp; <b>"), kind, F.lit("</b> "), brand, tail, F.lit("</p><script>y</script>"))
    rtf = F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1251{\\fonttbl{\\f0 Arial;}}\\f0 "), name, F.lit(" \\'26 {\\b "), kind, F.lit("} "), brand, tail, F.lit("}"))
    which = F.col("p_partkey") % 7
    content = F.when(which == 1, F.encode(markdown, "UTF-8")).when(which == 2, F.encode(page, "UTF-8")).when(which == 3, F.encode(rtf, "UTF-8")).when(which == 4, F.encode(plain, "UTF-8")).when(which == 5, F.unhex(F.repeat(F.lit("000102FE"), F.lit(40)))).when(which == 6, F.unhex(F.lit(""))).otherwise(F.encode(plain, "UTF-8"))
    ending = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".html", ".rtf", ".dat", ".bin", ".TXT"])), which.cast("int") + 1)
    files = t("part").select(F.concat(F.col("p_partkey").cast("string"), ending).alias("path"), content.alias("content"))
    return text.extracted(files).select("path", rx.strip(F.col("text")).alias("out"), "status")


BOOK_SQL = "SELECT p_partkey || '{0}' AS path, p_name AS title, p_brand AS author, CASE WHEN p_partkey % 2 = 0 THEN 'Цикл ' || p_brand END AS series, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS series_index, CAST(c AS BIGINT) AS chapter, {1} AS chapter_title, CASE c WHEN 1 THEN p_type ELSE 'Конец ' || p_size END AS text, 'Q' || p_partkey AS cover, 'ok' AS status FROM part, (SELECT unnest([1, 2]) AS c)"


def book_rows(files: DataFrame) -> DataFrame:
    found = books.read_books(files).select("*", F.posexplode("chapters").alias("_pos", "c"))
    return found.select("path", "title", "author", "series", "series_index", (F.col("_pos") + 1).cast("long").alias("chapter"), F.col("c.title").alias("chapter_title"), F.col("c.text").alias("text"), F.col("cover").cast("string").alias("cover"), "status")


@query(BOOK_SQL.format(".fb2", "CASE c WHEN 1 THEN 'Часть первая. Глава 1' ELSE 'Глава 2' END"), heavy=True)
def fb2_books(spark, t):
    """FB2 files, made from columns, as chapters with metadata and cover."""
    e = sinks.escaped
    sequence = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<sequence name="'), e(F.concat(F.lit("Цикл "), "p_brand")), F.lit('" number="'), F.col("p_size").cast("string"), F.lit('"/>'))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><last-name>'), e(F.col("p_brand")), F.lit("</last-name></author><book-title>"), e(F.col("p_name")), F.lit("</book-title>"), sequence,
        F.lit('<coverpage><image l:href="#c.jpg"/></coverpage></title-info></description><body><section><title><p>Часть первая.</p></title><section><title><p>Глава 1</p></title><p>'), e(F.col("p_type")), F.lit("</p></section><section><title><p>Глава 2</p></title><p>"), F.lit("Конец "), F.col("p_size").cast("string"),
        F.lit('</p></section></section></body><binary id="c.jpg">'), F.base64(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).cast("binary")), F.lit("</binary></FictionBook>"),
    )
    return book_rows(t("part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".fb2")).alias("path"), F.encode(xml, "UTF-8").alias("content")))


@F.pandas_udf(BinaryType())
def _zipped(names: pd.Series, contents: pd.Series) -> pd.Series:
    def one_file(members, parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in zip(members, parts, strict=True):
                z.writestr(name, data)
        return out.getvalue()

    return pd.Series([one_file(n, c) for n, c in zip(names, contents, strict=True)])


@query(BOOK_SQL.format(".epub", "'Глава ' || c"), heavy=True)
def epub_books(spark, t):
    """EPUB files, made from columns, as chapters with metadata and cover; what the spine skips or lists as navigation is no chapter."""
    e = sinks.escaped
    series = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<meta name="calibre:series" content="'), e(F.concat(F.lit("Цикл "), "p_brand")), F.lit('"/><meta name="calibre:series_index" content="'), F.col("p_size").cast("string"), F.lit('"/>'))).otherwise(F.lit(""))
    package = F.concat(F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>'), e(F.col("p_name")), F.lit("</dc:title><dc:creator>"), e(F.col("p_brand")), F.lit("</dc:creator>"), series, F.lit(
        '</metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" properties="nav" media-type="application/xhtml+xml"/>'
        '<item id="c" href="i/c.png" properties="cover-image" media-type="image/png"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="n" linear="no"/><itemref idref="b"/></spine></package>'))  # fmt: skip
    page = lambda n, x: F.concat(F.lit(f"<html><body><h1>Глава {n}</h1><p>"), e(x), F.lit("</p></body></html>"))
    members = {"META-INF/container.xml": F.lit('<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'), "OPS/p.opf": package, "OPS/a.xhtml": page(1, F.col("p_type")), "OPS/t/b.xhtml": page(2, F.concat(F.lit("Конец "), F.col("p_size").cast("string"))), "OPS/n.xhtml": F.lit("<html><body>nav</body></html>"), "OPS/i/c.png": F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))}
    content = _zipped(F.array(*map(F.lit, members)), F.array(*members.values()))
    return book_rows(t("part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".epub")).alias("path"), content.alias("content")))


# --- numbers ----------------------------------------------------------------------------------------------------------


def numbers(name: str, table: str, key: str, n: str, column: Callable, sql: Callable) -> None:
    """A query over a whole number: key, n, out; sql gets the name of n and has the word lists in scope."""
    q = f"WITH {ru.WORDS_SQL}, t AS (SELECT {key}, CAST({n} AS BIGINT) AS n FROM {table}) SELECT {key}, n, {sql('n')} AS out FROM t, w"
    query(q)(_named(name, lambda spark, t: t(table).select(key, F.expr(f"cast({n} as bigint)").alias("n")).withColumn("out", column(F.col("n")))))


numbers("cardinal_words", "orders", "o_orderkey", "o_orderkey * 7919 % 1000000007", ru.cardinal, lambda n: ru.cardinal(n, ru.Sql))
numbers("ordinal_words", "orders", "o_orderkey", "o_orderkey * 37 % 12001", ru.ordinal, lambda n: ru.ordinal(n, ru.Sql))
ENDINGS = ("го", "му", "м", "ая", "ые")


@query(f"WITH {ru.WORDS_SQL}, t AS (SELECT p_partkey, {ru.ordinal('CAST(p_partkey % 2100 AS BIGINT)', ru.Sql)} AS said FROM part, w) SELECT p_partkey, {' || chr(124) || '.join(ru.inflected('said', s, ru.Sql) for s in ENDINGS)} AS out FROM t")
def ordinal_cases(spark, t):
    said = t("part").select("p_partkey", (F.col("p_partkey") % 2100).alias("n")).withColumn("said", ru.ordinal(F.col("n")))
    return said.select("p_partkey", F.concat_ws("|", *(ru.inflected(F.col("said"), e) for e in ENDINGS)).alias("out"))


numbers("centimetre_form", "lineitem", "l_orderkey", "l_linenumber * 1000 + l_quantity", lambda n: ru.unit_form(n, "сантиметр", "сантиметра", "сантиметров"), lambda n: ru.unit_form(n, "сантиметр", "сантиметра", "сантиметров", ru.Sql))
numbers("gram_unit_form", "lineitem", "l_orderkey", "l_linenumber * 1000 + l_quantity", lambda n: ru.unit_form(n, "грамм", "грамма", "граммов"), lambda n: ru.unit_form(n, "грамм", "грамма", "граммов", ru.Sql))
numbers("percent_unit_form", "lineitem", "l_orderkey", "l_linenumber * 1000 + round(l_discount * 100)", lambda n: ru.unit_form(n, "процент", "процента", "процентов"), lambda n: ru.unit_form(n, "процент", "процента", "процентов", ru.Sql))
numbers("year_phrase", "orders", "o_orderkey", "year(o_orderdate)", lambda n: F.concat(F.lit("в "), ru.inflected(ru.ordinal(n), "м"), F.lit(" году")), lambda n: f"'в ' || {ru.inflected(ru.ordinal(n, ru.Sql), 'м', ru.Sql)} || ' году'")

YEAR_TEXT = {0: ("В {y} г. он", "В {m} году он"), 1: ("{y} г. Москва", "{o} год. Москва"), 2: ("к {y} году", "к {mu} году"), 3: ("с {y} по 1999 г.", "с {go} по тысяча девятьсот девяносто девятый год."), 4: ("{y} год и", "{o} год и")}


def year_sql() -> str:
    o = ru.ordinal("y", ru.Sql)
    forms = {"{m}": ru.inflected(o, "м", ru.Sql), "{mu}": ru.inflected(o, "му", ru.Sql), "{go}": ru.inflected(o, "го", ru.Sql), "{o}": o}
    cases = []
    for k, (_, out) in YEAR_TEXT.items():
        slot = next(f for f in forms if f in out)
        a, b = out.split(slot)
        cases.append(f"WHEN {k} THEN '{a}' || {forms[slot]} || '{b}'")
    return f"WITH {ru.WORDS_SQL}, t AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 {' '.join(cases)} END AS out FROM t, w"


@query(year_sql(), heavy=True)
def year_rules(spark, t):
    y = F.year("o_orderdate").cast("string")
    texts = F.array(*(F.concat(*(y if p == "{y}" else F.lit(p) for p in (a.partition("{y}")))) for a, _ in YEAR_TEXT.values()))
    return t("orders").select("o_orderkey", speech.spoken_text(F.element_at(texts, (F.col("o_orderkey") % 5).cast("int") + 1)).alias("out"))


@query(f"WITH {ru.WORDS_SQL}, t AS (SELECT o_orderkey, CAST(day(o_orderdate) AS BIGINT) AS d, month(o_orderdate) AS mon, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders) SELECT o_orderkey, {ru.inflected(ru.ordinal('d', ru.Sql), 'го', ru.Sql)} || ' ' || [{', '.join(repr(m) for m in ru.MONTHS)}][mon] || ' ' || {ru.inflected(ru.ordinal('y', ru.Sql), 'го', ru.Sql)} || ' года' AS out FROM t, w", heavy=True)
def date_words(spark, t):
    return t("orders").select("o_orderkey", speech.spoken_text(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("out"))


@query(f"WITH {ru.WORDS_SQL}, t AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS a, CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 100 AS b FROM customer) SELECT c_custkey, {ru.cardinal('a', ru.Sql)} || ' целых ' || {ru.cardinal('b', ru.Sql)} || ' сотых' AS out FROM t, w", heavy=True)
def decimal_words(spark, t):
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    said = F.concat(F.floor(F.abs("c_acctbal")).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return t("customer").select("c_custkey", speech.spoken_text(said).alias("out"))


@query(f"WITH {ru.WORDS_SQL}, t AS (SELECT o_orderkey, CAST(o_orderkey % 900 + 1 AS BIGINT) AS a, CAST(o_custkey % 1000 AS BIGINT) AS b, CAST((o_orderkey % 900 + 1) * 1000 + o_custkey % 1000 AS BIGINT) AS n FROM orders) SELECT o_orderkey, {ru.cardinal('n', ru.Sql)} AS out FROM t, w", heavy=True)
def thousands_merge(spark, t):
    said = F.concat((F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" "), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    return t("orders").select("o_orderkey", speech.spoken_text(said).alias("out"))


ROMAN_SQL = "(['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1])"


@query("WITH t AS (SELECT p_partkey, p_partkey % 998 + 2 AS n, p_partkey % 21 + 1 AS c FROM part) SELECT p_partkey, 'Глава ' || CASE WHEN n IN (50, 100, 500) THEN ['L', 'C', 'D'][CASE n WHEN 50 THEN 1 WHEN 100 THEN 2 ELSE 3 END] ELSE CAST(n AS VARCHAR) END || '. Начало ' || c || '-го века' AS out FROM t")
def roman_to_arabic(spark, t):
    digits = lambda one_, five, ten, n: F.element_at(F.array(*map(F.lit, ["", one_, one_ * 2, one_ * 3, one_ + five, five, five + one_, five + one_ * 2, five + one_ * 3, one_ + ten])), n.cast("int") + 1)
    roman = lambda n: F.concat(digits("C", "D", "M", F.floor(n / 100) % 10), digits("X", "L", "C", F.floor(n / 10) % 10), digits("I", "V", "X", n % 10))
    said = F.concat(F.lit("Глава "), roman(F.col("p_partkey") % 998 + 2), F.lit(". Начало "), roman(F.col("p_partkey") % 21 + 1), F.lit(" века"))
    return t("part").select("p_partkey", letters.roman_to_arabic(said).alias("out"))


ABBREVIATED = [("и т. д. Он", "и так далее. Он"), ("и т. п. он", "и тому подобное он"), ("т. е. он", "то есть он"), ("см. с. 5", "смотри страница пять"), ("театр им. Пушкина", "театр имени Пушкина"), ("г. Москва, ул. Мира, д. 5, кв. 7", "город Москва, улица Мира, дом пять, квартира семь"), ("в гл. 2", "в глава два"), ("в 300 г. до н. э. и", "в трёхсотом году до нашей эры и"), ("№5 и №№ 6", "номер пять и номера шесть"), ("напр. рис. 3", "например рисунок три")]
ABBREVIATED += [("пер. Труда, обл. 2", "переулок Труда, область два"), ("и т. д он", "и так далее он"), ("т. к. он", "так как он"), ("т. н. сад", "так называемый сад"), ("и др. он", "и другие он"), ("и пр. он", "и прочее он"), ("ср. там", "сравни там"), ("стр. там", "страница там"), ("табл. там", "таблица там"), ("к1905 г., да", "к1905 год, да"), ("1905—1910 гг. шли", "одна тысяча девятьсот пять—одна тысяча девятьсот десять годы шли"), ("просп. Мира", "проспект Мира")]
#: Units, and what is written with digits but is no number of its own, on cases with literal results.
COUNTED = [("5 см. и", "пять сантиметров. и"), ("1 см, 2,5 см.", "один см, два целых пять десятых сантиметра."), ("3 г муки", "три грамма муки"), ("21 г. сахара", "двадцать один грамм сахара"), ("11 г соли", "одиннадцать граммов соли"), ("2,5 % за", "два целых пять десятых процента за"), ("101%", "сто один процент"), ("90-е годы", "девяностые годы"), ("1000-е год", "тысячные год"), ("5-го числа", "пятого числа"), ("3-й", "третий"), ("103-м", "сто третьем"), ("2000-ая", "двухтысячная"), ("40-ых", "сороковых"), ("1 000 000", "один миллион"), ("1943 150", "одна тысяча девятьсот сорок три сто пятьдесят"), ("31.02.2001", "тридцать один.два.две тысячи один"), ("1,23456", "один запятая двадцать три тысячи четыреста пятьдесят шесть"), ("29.02.2024", "двадцать девятого февраля две тысячи двадцать четвёртого года")]
#: Numerals with literal results.
SPELLED = [(0, "ноль"), (1, "один"), (2, "два"), (11, "одиннадцать"), (14, "четырнадцать"), (21, "двадцать один"), (40, "сорок"), (90, "девяносто"), (100, "сто"), (212, "двести двенадцать"), (999, "девятьсот девяносто девять"), (1000, "одна тысяча"), (2002, "две тысячи два"), (5011, "пять тысяч одиннадцать"), (21000, "двадцать одна тысяча"), (1000000, "один миллион"), (2000005, "два миллиона пять"), (1000000000, "один миллиард"), (3000000000000, "три триллиона")]


@query("SELECT o_orderkey, [" + ", ".join("'" + b.replace("'", "''") + "'" for _, b in ABBREVIATED) + f"][o_orderkey % {len(ABBREVIATED)} + 1] AS out FROM orders", heavy=True)
def abbreviations(spark, t):
    said = F.element_at(F.array(*(F.lit(a) for a, _ in ABBREVIATED)), (F.col("o_orderkey") % len(ABBREVIATED)).cast("int") + 1)
    return t("orders").select("o_orderkey", speech.spoken_text(said).alias("out"))


@query("SELECT o_orderkey, [" + ", ".join(f"'{b}'" for _, b in COUNTED) + f"][o_orderkey % {len(COUNTED)} + 1] AS out FROM orders", heavy=True)
def counted_forms(spark, t):
    said = F.element_at(F.array(*(F.lit(a) for a, _ in COUNTED)), (F.col("o_orderkey") % len(COUNTED)).cast("int") + 1)
    return t("orders").select("o_orderkey", speech.spoken_text(said).alias("out"))


@query("SELECT o_orderkey, [" + ", ".join(f"'{b}'" for _, b in SPELLED) + f"][o_orderkey % {len(SPELLED)} + 1] AS by_table, [" + ", ".join(f"'{b}'" for _, b in SPELLED) + f"][o_orderkey % {len(SPELLED)} + 1] AS by_rule FROM orders", heavy=True)
def spelled_numbers(spark, t):
    """Both forms of the cardinal rule, the column and the spoken text, against literal words."""
    n = F.element_at(F.array(*(F.lit(a).cast("long") for a, _ in SPELLED)), (F.col("o_orderkey") % len(SPELLED)).cast("int") + 1)
    return t("orders").select("o_orderkey", n.alias("n")).select("o_orderkey", ru.cardinal(F.col("n")).alias("by_table"), speech.spoken_text(F.col("n").cast("string")).alias("by_rule"))


@query(f"""WITH {ru.WORDS_SQL}, t AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(o_orderkey % 90 + 1 AS BIGINT) AS n, CAST(o_custkey AS VARCHAR) AS c FROM orders)
SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS chapter_index, 'Глава ' || n AS title, 'Глава ' || {ru.cardinal('n', ru.Sql)} || '.' || chr(10) || 'Он «купил» в ' || {ru.inflected(ru.ordinal('y', ru.Sql), 'м', ru.Sql)} || ' году ' || {ru.cardinal('n', ru.Sql)} || ' ' || {ru.unit_form('n', 'процент', 'процента', 'процентов', ru.Sql)} || ' и так далее.' || chr(10) || '— Да, вот?!' || chr(10) || chr(10) || 'Конец плюс всё' AS text FROM t, w""", heavy=True)
def clean_document(spark, t):
    """Books cleaned whole: blank chapters go, spoken titles stand before the bodies, each kind of clean-up rule has something to do."""
    y, n = F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 90 + 1).cast("string")
    text_ = F.concat(F.lit("Он “купил”  в "), y, F.lit(" г. "), n, F.lit("%\r\nи т. д.\n- 12 -\n— Да,[3] вот⁈\n\n\n\nКонец + всё "))
    book = lambda i, title, x: F.struct(F.lit(i).cast("long").alias("i"), title.alias("title"), x.alias("text"))
    parts = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(book(0, F.lit("Пусто"), F.lit(" \n ")), book(1, F.concat(F.lit(" Глава "), n), text_))).alias("c"))
    rows = parts.select("doc_id", F.col("c.i").alias("chapter_index"), "c.title", "c.text")
    return chapters.with_spoken_titles(chapters.clean_chapters(rows)).select("doc_id", "chapter_index", "title", "text")


@query(heavy=True)
def clean_text_full(spark, t):
    """The whole clean-up over every document, with Russian carriers before the text."""
    said = F.concat(F.lit("В 1905 г. он купил 5 кг и т. д.\nГлава XIV. "), F.col("text"))
    return t("documents").select("doc_id", speech.clean_text(said).alias("out"))


# --- chapters and times -----------------------------------------------------------------------------------------------


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN [NULL, 'Часть первая. Глава 1', 'Глава 2'] WHEN o_orderkey % 4 = 1 THEN ['Chapter 1 Start', 'Эпилог'] WHEN o_orderkey % 4 = 2 THEN [NULL] ELSE ['Глава III', 'глава двадцать третья'] END[CAST(c AS INT)] AS title, CAST(c - 1 AS INT) AS chapter_index,
CASE WHEN o_orderkey % 4 = 0 THEN ['Начало', 'Текст ' || o_orderkey, 'Ещё'] WHEN o_orderkey % 4 = 1 THEN ['a ' || o_orderkey, 'b'] WHEN o_orderkey % 4 = 2 THEN ['Глава семьи вошёл в дом ' || o_orderkey] ELSE ['x', 'y ' || o_orderkey] END[CAST(c AS INT)] AS text
FROM (SELECT o_orderkey, unnest(generate_series(1, [3, 2, 1, 2][o_orderkey % 4 + 1])) AS c FROM orders)""", heavy=True)
def chapter_split(spark, t):
    n = F.col("o_orderkey").cast("string")
    books = F.array(F.concat(F.lit("Начало\nЧасть первая\n\nГлава 1\nТекст "), n, F.lit("\nГлава 2\nЕщё\n")), F.concat(F.lit("Chapter 1 Start\r\na "), n, F.lit("\r\nЭпилог\r\nb")), F.concat(F.lit("Глава семьи вошёл в дом "), n), F.concat(F.lit("Глава III\nx\nглава двадцать третья\ny "), n))
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(books, (F.col("o_orderkey") % 4).cast("int") + 1).alias("text"))
    return chapters.chapter_rows(docs).withColumnRenamed("doc_id", "o_orderkey")


CHUNKS = "SELECT conv_id AS doc_id, turn AS index, CAST(turn // 3 AS BIGINT) AS chapter_index, length(text) / 15.0 AS duration, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 'T' || turn END AS chapter_title, text FROM conversations"


def chunks(t) -> DataFrame:
    turn = F.col("turn")
    title = F.when((turn % 3 == 0) & (turn % 2 == 0), F.concat(F.lit("T"), turn.cast("string")))
    return t("conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("index"), F.floor(turn / 3).cast("long").alias("chapter_index"), (F.length("text") / 15.0).alias("duration"), title.alias("chapter_title"), "text")


@query(f"""WITH c AS ({CHUNKS}), m AS (SELECT *, CAST(round_even(duration * 1000, 0) AS BIGINT) AS ms FROM c), e AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY doc_id ORDER BY index) AS BIGINT) AS stop,
  CAST(chapter_index IS DISTINCT FROM lag(chapter_index) OVER (PARTITION BY doc_id ORDER BY index) AS INT) AS new FROM m), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY index) - 1 AS BIGINT) AS span FROM e)
SELECT doc_id, span, min(chapter_index) AS chapter_index, min(stop - ms) AS start_ms, greatest(max(stop), min(stop - ms) + 1) AS end_ms FROM s GROUP BY doc_id, span""")
def chapter_spans(spark, t):
    return timeline.chapter_spans(chunks(t))


@query(f"""WITH c AS ({CHUNKS}), f AS (SELECT doc_id, chapter_index, min(index) AS since, arg_min(coalesce(chapter_title, ''), index) AS own FROM c GROUP BY ALL)
SELECT doc_id, chapter_index, CASE WHEN own <> '' THEN own ELSE 'Глава ' || row_number() OVER (PARTITION BY doc_id ORDER BY since) END AS title FROM f""")
def default_chapter_titles(spark, t):
    return timeline.chapter_titles(chunks(t))


@query(f"WITH c AS ({CHUNKS}) SELECT doc_id, count(DISTINCT chapter_index) > 1 AS has_structure FROM c GROUP BY doc_id")
def chapter_structure(spark, t):
    return timeline.has_structure(chunks(t))


@query(f"""WITH c AS ({CHUNKS}), l AS (SELECT doc_id, list({{'out': []::STRUCT(i BIGINT, p INTEGER)[], 'p': CAST(index AS INTEGER), 'size': CAST(duration * 8000.0 AS DOUBLE)}} ORDER BY index) AS xs FROM c GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(xs, lambda a, x: CASE WHEN a.size > 0 AND a.size + x.size > 1048576 * 0.97 THEN {{'out': list_append(a.out, {{'i': x.p::BIGINT, 'p': CAST(a.p + 1 AS INTEGER)}}), 'p': CAST(a.p + 1 AS INTEGER), 'size': x.size}} ELSE {{'out': list_append(a.out, {{'i': x.p::BIGINT, 'p': a.p}}), 'p': a.p, 'size': a.size + x.size}} END,
  {{'out': []::STRUCT(i BIGINT, p INTEGER)[], 'p': 1::INTEGER, 'size': 0.0::DOUBLE}}).out AS o FROM l), u AS (SELECT doc_id, unnest(o) AS o FROM f)
SELECT doc_id, o.i AS index, o.p AS part FROM u""")
def part_packing(spark, t):
    return timeline.parts(chunks(t), 64_000, 1)


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 1 THEN p_name || ' (часть ' || p_size || ')' ELSE p_name END AS out FROM part")
def part_titles(spark, t):
    return t("part").select("p_partkey", timeline.part_title(F.col("p_name"), F.col("p_size"), F.col("p_size") % 3).alias("out"))


@query(f"""WITH c AS ({CHUNKS}), m AS (SELECT *, CAST(round_even(duration * 1000, 0) AS BIGINT) AS ms FROM c), e AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY doc_id ORDER BY index) AS BIGINT) AS stop,
  CAST(chapter_index IS DISTINCT FROM lag(chapter_index) OVER (PARTITION BY doc_id ORDER BY index) AS INT) AS new FROM m), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY index) - 1 AS BIGINT) AS span FROM e),
p AS (SELECT doc_id, span, min(chapter_index) AS chapter_index, min(stop - ms) AS a, greatest(max(stop), min(stop - ms) + 1) AS b FROM s GROUP BY doc_id, span),
f AS (SELECT doc_id, chapter_index, min(index) AS since, arg_min(coalesce(chapter_title, ''), index) AS own FROM c GROUP BY ALL),
n AS (SELECT doc_id, chapter_index, CASE WHEN own <> '' THEN own ELSE 'Глава ' || row_number() OVER (PARTITION BY doc_id ORDER BY since) END AS title FROM f)
SELECT doc_id, ';FFMETADATA1' || chr(10) || 'title=A\\=B' || chr(10) || 'album=A\\=B' || chr(10) || 'genre=Audiobook' || chr(10) || 'media_type=2' || string_agg(chr(10) || chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || a || chr(10) || 'END=' || b || chr(10) || 'title=' || title, '' ORDER BY span) || chr(10) AS text
FROM p JOIN n USING (doc_id, chapter_index) GROUP BY doc_id""")
def chapter_files(spark, t):
    """The chapter file of every conversation as a book."""
    c = chunks(t)
    spans = timeline.chapter_spans(c).join(timeline.chapter_titles(c), ["doc_id", "chapter_index"])
    return timeline.chapter_file(spans, c.select("doc_id").distinct().select("doc_id", F.lit("A=B").alias("title"), F.lit(None).cast("string").alias("author")))


# --- identity, caches, receipts, archives -----------------------------------------------------------------------------


@query("WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN doc_id > first THEN first ELSE -1 END AS duplicate_of FROM documents JOIN f ON sha256(text) = h")
def terminal_duplicates(spark, t):
    docs = t("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    return identity.first_of_each(docs, "h", "doc_id").select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


JOBS_SQL = """SELECT o_orderkey AS id, 'book' || (o_custkey % 400) || '.fb2' AS source_name, '/in/' || (o_orderkey % 977) || '/book.fb2' AS source_path, sha256(CAST(o_custkey % 400 AS VARCHAR)) AS content_hash,
  ['ingesting', 'queued', 'extracting', 'cleaning', 'synthesizing', 'assembling', 'ready', 'delivering', 'done', 'failed', 'cancelled'][CAST(o_orderkey % 11 + 1 AS INT)] AS stage, (o_orderkey % 10) / 10.0::DOUBLE AS progress,
  CASE WHEN o_orderkey % 4 > 0 THEN 'out' || o_orderkey ELSE '' END AS output_paths, o_orderkey % 5 = 0 AS delivered, o_orderkey % 3 > 0 AS staged, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey * 13 % 1000 AS DOUBLE) END AS last_attempt FROM orders"""


def job_rows(t) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select(
        k.alias("id"), F.concat(F.lit("book"), (c % 400).cast("string"), F.lit(".fb2")).alias("source_name"), F.concat(F.lit("/in/"), (k % 977).cast("string"), F.lit("/book.fb2")).alias("source_path"),
        F.sha2((c % 400).cast("string"), 256).alias("content_hash"), F.element_at(F.array(*map(F.lit, jobs.STAGES)), (k % 11).cast("int") + 1).alias("stage"), ((k % 10) / 10.0).alias("progress"),
        F.when(k % 4 > 0, F.concat(F.lit("out"), k.cast("string"))).otherwise(F.lit("")).alias("output_paths"), (k % 5 == 0).alias("delivered"), (k % 3 > 0).alias("staged"), F.when(k % 6 > 0, (k * 13 % 1000).cast("double")).alias("last_attempt"),
    )


def job_query(sql: str):
    return query(f"WITH j AS ({JOBS_SQL}) {sql}")


@job_query("SELECT DISTINCT sha256(d.text) AS content_hash FROM documents d WHERE sha256(d.text) IN (SELECT sha256(b.text) FROM j JOIN documents b ON b.doc_id = j.id WHERE j.stage NOT IN ('done', 'failed', 'cancelled'))")
def active_duplicates(spark, t):
    """Texts that an open job has already; a job's book is the document of its id."""
    hashed = t("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    known = job_rows(t).drop("content_hash").join(hashed.withColumnRenamed("doc_id", "id"), "id")
    return identity.rejected_duplicates(hashed.select("content_hash").distinct(), known, any_stage=False)


@job_query("SELECT content_hash, max(id) AS id, arg_max(stage, id) AS stage FROM j GROUP BY content_hash")
def job_latest_by_hash(spark, t):
    return jobs.latest_by_hash(job_rows(t), active_only=False)


@job_query("SELECT content_hash, max(id) AS id, arg_max(stage, id) AS stage FROM j WHERE stage NOT IN ('done', 'failed', 'cancelled') GROUP BY content_hash")
def job_latest_active_by_hash(spark, t):
    return jobs.latest_by_hash(job_rows(t), active_only=True)


@job_query("SELECT id, stage FROM j WHERE stage = 'queued' ORDER BY id LIMIT 1")
def job_next_queued(spark, t):
    return jobs.next_queued(job_rows(t)).select("id", "stage")


@job_query("SELECT id, stage FROM j WHERE stage IN ('extracting', 'cleaning', 'synthesizing', 'assembling', 'delivering') ORDER BY id LIMIT 1")
def job_active(spark, t):
    return jobs.active_job(job_rows(t)).select("id", "stage")


@job_query("SELECT id, stage, source_name FROM j WHERE stage = 'failed' ORDER BY id DESC LIMIT 7 OFFSET 7")
def job_page(spark, t):
    return jobs.page(job_rows(t), "failed", 2).select("id", "stage", "source_name")


@job_query("SELECT stage, count(*) AS n, greatest(1, CAST(ceil(count(*) / 7.0) AS BIGINT)) AS pages FROM j GROUP BY stage")
def job_counts(spark, t):
    return jobs.counts(job_rows(t))


@job_query("SELECT id, stage FROM j WHERE stage IN ('queued', 'ready')")
def job_by_stages(spark, t):
    return jobs.by_stages(job_rows(t), ("queued", "ready")).select("id", "stage")


@job_query("SELECT id, output_paths FROM j WHERE stage = 'ready' AND NOT delivered AND output_paths <> ''")
def job_ready_undelivered(spark, t):
    return jobs.ready_undelivered(job_rows(t)).select("id", "output_paths")


@job_query("""SELECT * FROM (SELECT 'cancel' AS action, id FROM j WHERE stage IN ('queued', 'extracting', 'cleaning', 'synthesizing', 'assembling') ORDER BY stage = 'queued', id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'publish', id FROM j WHERE stage = 'ready' AND output_paths <> '' ORDER BY id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'restore', id FROM j WHERE stage = 'done' AND output_paths <> '' ORDER BY id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'retry', id FROM j WHERE stage IN ('failed', 'cancelled') ORDER BY id DESC LIMIT 1)""")
def job_resolve_target(spark, t):
    j = job_rows(t)
    out = [jobs.resolve_target(j, a).select(F.lit(a).alias("action"), "id") for a in sorted(jobs.ACTIONS)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@job_query("""SELECT id, array_to_string(list_filter([CASE WHEN stage IN ('queued', 'extracting', 'cleaning', 'synthesizing', 'assembling') THEN 'cancel' END, CASE WHEN stage = 'ready' AND output_paths <> '' THEN 'publish' END,
  CASE WHEN stage = 'done' AND output_paths <> '' THEN 'restore' END, CASE WHEN stage IN ('failed', 'cancelled') THEN 'retry' END], lambda a: a IS NOT NULL), ',') AS actions FROM j""")
def job_allowed_actions(spark, t):
    return jobs.allowed_actions(job_rows(t)).select("id", F.array_join("actions", ",").alias("actions"))


@job_query("SELECT id, CASE WHEN stage IN ('failed', 'cancelled') AND content_hash NOT IN (SELECT content_hash FROM j WHERE stage NOT IN ('done', 'failed', 'cancelled')) THEN 'queued' ELSE stage END AS stage FROM j")
def job_requeue(spark, t):
    return jobs.requeue(job_rows(t)).select("id", "stage")


@job_query("""SELECT id, CASE WHEN stage = 'ingesting' THEN CASE WHEN staged THEN 'queued' ELSE 'failed' END WHEN stage = 'delivering' THEN 'ready' WHEN stage IN ('extracting', 'cleaning', 'synthesizing', 'assembling') THEN 'queued' ELSE stage END AS stage,
  CASE WHEN stage = 'delivering' THEN 1.0::DOUBLE ELSE progress END AS progress, CASE WHEN stage = 'delivering' THEN false ELSE delivered END AS delivered, stage IN ('ingesting', 'delivering', 'extracting', 'cleaning', 'synthesizing', 'assembling') AS changed FROM j""")
def reconcile_startup(spark, t):
    return jobs.reconcile(job_rows(t)).select("id", "stage", "progress", "delivered", "changed")


@job_query("SELECT id FROM j WHERE stage = 'ready' AND NOT delivered AND output_paths <> '' AND 1000.0 - coalesce(last_attempt, -1e9) >= 120 ORDER BY coalesce(last_attempt, -1e9), id LIMIT 1")
def retry_due(spark, t):
    return jobs.retry_due(job_rows(t), F.lit(1000.0)).select("id")


@job_query("SELECT name FROM (SELECT CAST(p_partkey AS VARCHAR) AS name FROM part UNION ALL SELECT '_incoming') WHERE name = '_incoming' OR name NOT IN (SELECT regexp_extract(source_path, '([^/]+)/[^/]*$', 1) FROM j)")
def orphan_sweep(spark, t):
    folders = t("part").select(F.col("p_partkey").cast("string").alias("name")).union(spark.createDataFrame([("_incoming",)], "name string"))
    return jobs.orphans(folders, job_rows(t))


PLAN_ROWS = "SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS index, CAST(turn // 3 AS INT) AS chapter_index, CASE WHEN turn % 3 = 0 THEN role END AS chapter_title, regexp_replace(text, '[^ -~]|[\"\\\\]', '', 'g') AS text FROM conversations"


def plan_rows(t) -> DataFrame:
    turn = F.col("turn")
    return t("conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("index"), F.floor(turn / 3).cast("int").alias("chapter_index"), F.when(turn % 3 == 0, F.col("role")).alias("chapter_title"), F.regexp_replace("text", r'[^ -~]|["\\]', "").alias("text"))


@query(f"""WITH p AS ({PLAN_ROWS}) SELECT doc_id, sha256('[' || string_agg('{{"chapter_index":' || chapter_index || ',"chapter_title":' || coalesce('"' || chapter_title || '"', 'null') || ',"index":' || index || ',"text":"' || text || '"}}', ',' ORDER BY index) || ']') AS digest FROM p GROUP BY doc_id""")
def plan_digest(spark, t):
    return identity.plan_digest(plan_rows(t))


@query(f"WITH p AS ({PLAN_ROWS}) SELECT doc_id, index, chapter_index, chapter_title, text FROM p")
def plan_json_round_trip(spark, t):
    return sinks.plans_from_json(sinks.plans_as_json(plan_rows(t))).select("doc_id", "index", "chapter_index", "chapter_title", "text")


@query(f"WITH p AS ({PLAN_ROWS}) SELECT doc_id, index FROM p WHERE NOT (doc_id % 5 > 0 AND index % 3 > 0)")
def resume_worklist(spark, t):
    plan = plan_rows(t).select("doc_id", "index", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("digest"))
    cached = plan.select("doc_id", "index", F.when(F.col("doc_id") % 5 > 0, F.col("digest")).otherwise(F.lit("old")).alias("digest"), (F.col("index") % 3 > 0).alias("valid"))
    return identity.work_list(plan, cached).select("doc_id", "index")


@query("SELECT l_orderkey AS receipt_id, bool_and(l_orderkey % 7 > 0 AND NOT (l_orderkey % 11 = 0 AND l_linenumber = 1)) AS ok FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def receipt_verify(spark, t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    files = lines.select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_linenumber") * 10).alias("size"), F.lit("aa").alias("sha256"))
    found = files.where(~((F.col("receipt_id") % 11 == 0) & (F.col("pos") == 1))).withColumn("sha256", F.when(F.col("receipt_id") % 7 == 0, F.lit("bb")).otherwise(F.col("sha256")))
    return identity.verified_receipts(files, found)


MEMBERS = "SELECT l_orderkey AS archive, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(floor(l_extendedprice * 9000) AS BIGINT) AS file_size, CAST(floor(l_extendedprice * 9000 / (l_quantity * 8)) AS BIGINT) AS compress_size, CASE WHEN l_partkey % 50 = 0 THEN 12 ELSE 8 END AS compress_type FROM lineitem"


@query(f"""WITH m AS ({MEMBERS}), r AS (SELECT *, sum(file_size) OVER (PARTITION BY archive ORDER BY pos) AS total FROM m), x AS (SELECT *, CASE WHEN compress_type NOT IN (0, 8) THEN 'compression' WHEN file_size > 536870912 THEN 'member size'
  WHEN file_size > 16777216 AND file_size > 200 * greatest(compress_size, 1) THEN 'member ratio' WHEN total > 1073741824 THEN 'total size' END AS rule FROM r)
SELECT archive, count(*) AS n, coalesce(arg_min(rule, pos) FILTER (WHERE rule IS NOT NULL), CASE WHEN sum(file_size) > 268435456 AND sum(file_size) > 200 * greatest(sum(compress_size), 1) THEN 'total ratio' END) AS reason FROM x GROUP BY archive""")
def expansion_guard(spark, t):
    li = t("lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    members = li.select(F.col("l_orderkey").alias("archive"), pos.alias("pos"), F.floor(F.col("l_extendedprice") * 9000).alias("file_size"), F.floor(F.col("l_extendedprice") * 9000 / (F.col("l_quantity") * 8)).alias("compress_size"), F.when(F.col("l_partkey") % 50 == 0, 12).otherwise(8).alias("compress_type"))
    return identity.archive_verdicts(members)


#: doc_id % 17 -> what is wrong with the file.
@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 17 = 1 THEN 'format' WHEN doc_id % 17 = 2 THEN 'link' WHEN doc_id % 17 = 3 THEN 'not a file'
WHEN length(text) = 0 OR doc_id % 17 = 4 THEN 'empty' WHEN doc_id % 17 = 5 THEN 'too large' WHEN doc_id % 17 IN (6, 7) THEN 'changed' ELSE 'ok' END AS status FROM documents""")
def ingest_guard(spark, t):
    d, bad = F.col("doc_id"), F.col("doc_id") % 17
    path = F.concat(F.lit("/in/"), F.when(d % 10 == 0, F.lit(".")).otherwise(F.lit("")), d.cast("string"), F.when(bad == 1, ".PDF").otherwise(".txt"))
    length = F.when(bad == 4, 0).when(bad == 5, identity.MOST_BYTES + 1).otherwise(F.length("text"))
    files = t("documents").select("doc_id", path.alias("path"), length.alias("length"), (bad == 2).alias("is_link"), (bad != 3).alias("is_regular"), F.lit(5.0).alias("mtime"), (length + (bad == 6).cast("int")).alias("length_after"), F.when(bad == 7, 6.0).otherwise(5.0).alias("mtime_after"))
    return identity.taken_in(files).select("doc_id", "status")


HALVED = "list_transform(range(1), lambda _: CAST(p_size AS BIGINT))"
for _ in range(sentences.HALVINGS):
    HALVED = f"flatten(list_transform({HALVED}, lambda n: CASE WHEN n * 9 - 1 > 60 AND n > 1 THEN [n // 2, n - n // 2] ELSE [n] END))"


@query(f"SELECT p_partkey, array_to_string(list_transform({HALVED}, lambda n: rtrim(repeat('Раз два. ', n))), '|') AS out FROM part", heavy=True)
def halved_pieces(spark, t):
    said = F.rtrim(F.repeat(F.lit("Раз два. "), F.col("p_size").cast("int")))
    return t("part").select("p_partkey", F.array_join(sentences.halved(said, lambda p: F.length(p) > 60), "|").alias("out"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: abs(CAST(floor(x * 1000) AS INT)) >= 64)) >= 640 / 50.0 AND len(embedding) >= 640 / 12.0 AND vec_id % 9 > 0 AS valid FROM embeddings")
def pcm_validity(spark, t):
    samples = F.transform("embedding", lambda x: F.floor(x.cast("float") * F.lit(1000).cast("float")).cast("int"))
    return t("embeddings").select("vec_id", identity.pcm_valid(samples, F.lit(640), F.when(F.col("vec_id") % 9 == 0, 2).otherwise(1), F.lit(2)).alias("valid"))


RUNS = """WITH r AS (SELECT user_id, event_type <> 'error' AS ok, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), g AS (SELECT user_id, run, count(*) AS n, sum(CAST(NOT ok AS BIGINT)) AS failed FROM r GROUP BY ALL)"""


@query(f"{RUNS} SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failed) AS BIGINT) AS failed, CAST(max(failed) AS BIGINT) AS longest, sum(failed) = sum(n) OR max(failed) >= 3 OR sum(failed) > greatest(3, ceil(sum(n) / 10.0)) AS abort FROM g GROUP BY user_id")
def silence_runs(spark, t):
    outcomes = t("events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return identity.silence_aborts(identity.silence_runs(outcomes, "user_id", ["ts", "event_id"], "ok"))


@query("SELECT user_id, count(*) AS chunks, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS silenced, array_to_string(list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'error'), ',') AS indices FROM events GROUP BY user_id")
def quality_summary(spark, t):
    bad = F.when(F.col("event_type") == "error", F.col("event_id"))
    ids = F.sort_array(F.collect_list(bad))
    return t("events").groupBy("user_id").agg(F.count("*").alias("chunks"), F.count(bad).alias("silenced"), F.when(F.count(bad) > 0, F.array_join(ids, ",")).alias("indices"))


# --- event time -------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), p AS (SELECT user_id AS path, seq AS poll_no, CAST(seq // 2 AS BIGINT) AS size FROM e)
SELECT path, poll_no, size FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY poll_no) AS before FROM p WHERE size > 0) WHERE before = size""")
def debounce_stable(spark, t):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    polls = t("events").select(F.col("user_id").alias("path"), seq.alias("poll_no"), F.floor(seq / 2).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return jobs.stable_polls(polls).select("path", F.col("poll_no").cast("long").alias("poll_no"), "size")


@query("""WITH s AS (SELECT user_id, list(CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 ORDER BY ts) AS ts FROM events GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_transform(ts, lambda t: {'t': t, 'last': NULL::DOUBLE, 'held': 0::BIGINT, 'out': []::STRUCT(t DOUBLE, n BIGINT)[]}),
  lambda a, x: CASE WHEN a.last IS NULL OR x.t - a.last >= 86400 THEN {'t': x.t, 'last': x.t, 'held': 0::BIGINT, 'out': list_append(a.out, {'t': x.t, 'n': a.held})} ELSE {'t': x.t, 'last': a.last, 'held': a.held + 1, 'out': a.out} END,
  {'t': 0.0::DOUBLE, 'last': NULL::DOUBLE, 'held': 0::BIGINT, 'out': []::STRUCT(t DOUBLE, n BIGINT)[]}).out AS o FROM s), u AS (SELECT user_id, unnest(o) AS o FROM f) SELECT user_id, o.t AS ts, o.n AS suppressed FROM u""")
def rate_limited_log(spark, t):
    events = t("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("ts"))
    return jobs.throttled(events, "user_id", 86400)


@query("""WITH r AS (SELECT user_id, event_id AS request, epoch_us(ts) / 1000000.0 AS ts FROM events WHERE event_type = 'click'), c AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS ts FROM events WHERE event_type = 'purchase')
SELECT r.request, min(c.ts) AS confirmed_at FROM r JOIN c ON r.user_id = c.user_id AND c.ts >= r.ts AND c.ts - r.ts <= 43200 GROUP BY r.request""")
def confirm_within_ttl(spark, t):
    e = t("events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    token = F.col("user_id").cast("string")
    requests = e.where("event_type = 'click'").select(token.alias("token"), "user_id", "ts", "event_id")
    confirms = e.where("event_type = 'purchase'").select(token.alias("token"), "user_id", "ts")
    hits = jobs.confirmed(requests.drop("event_id").distinct(), confirms, 43200)
    return requests.join(hits, ["token", "user_id", "ts"]).select(F.col("event_id").alias("request"), "confirmed_at")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS progress FROM events")
def progress_ratio(spark, t):
    return jobs.progress(t("events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "progress")


WANTED = ["queued", "extracting", "cleaning", "synthesizing", "assembling", "ready", "delivering", "done", "failed", "cancelled"]


def _next_sql() -> str:
    moves = " OR ".join(f"(a.s = '{a}' AND x.w IN ({', '.join(repr(b) for b in to)}))" for a, to in jobs.NEXT.items() if to)
    return f"CASE WHEN {moves} OR (x.w IN ('failed', 'cancelled') AND a.s NOT IN ('done', 'failed', 'cancelled')) THEN x.w ELSE a.s END"


@query(f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id FROM events), w AS (SELECT user_id, list({{'w': [{', '.join(map(repr, WANTED))}][CASE WHEN seq % 9 = 0 THEN event_id % 10 ELSE seq % 10 END + 1], 's': ''}} ORDER BY seq) AS xs FROM e GROUP BY user_id)
SELECT user_id AS id, list_reduce(xs, lambda a, x: {{'w': x.w, 's': {_next_sql()}}}, {{'w': '', 's': 'ingesting'}}).s AS stage FROM w""")
def stage_fold(spark, t):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t("events").select(F.col("user_id").alias("id"), seq.alias("seq"), "event_id")
    wanted = F.element_at(F.array(*map(F.lit, WANTED)), F.when(F.col("seq") % 9 == 0, F.col("event_id") % 10).otherwise(F.col("seq") % 10).cast("int") + 1)
    return jobs.fold_events(e.select("id", "seq", F.lit("stage").alias("kind"), wanted.alias("value"))).select("id", "stage")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'S' || c_name ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE 'F' END AS author FROM customer")
def metadata_override(spark, t):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    files = t("customer").select(k.alias("path"), F.col("c_name").alias("title"), F.lit("F").alias("author"), none.alias("series"), none.alias("series_index"))
    said = t("customer").where(k % 2 == 0).select(k.alias("path"), F.concat(F.lit("S"), "c_name").alias("title"), F.when(k % 4 == 0, F.lit("A")).alias("author"), none.alias("series"), none.alias("series_index"))
    return sinks.overridden(files, said).select(F.col("path").alias("c_custkey"), "title", "author")


@query("SELECT doc_id, text AS out FROM documents")
def decode_code_pages(spark, t):
    """Bytes of several encodings come back as the text that they were made from."""
    d = F.col("doc_id") % 3
    content = F.when(d == 0, F.encode("text", "UTF-8")).when(d == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    return t("documents").select("doc_id", text.decoded(content).alias("out"))


@query("SELECT o_orderkey, 'Однажды ' || o_orderkey || ' весною, в час небывало жаркого заката, в Москве' AS out FROM orders", heavy=True)
def decode_legacy_pages(spark, t):
    said = F.concat(F.lit("Однажды "), F.col("o_orderkey").cast("string"), F.lit(" весною, в час небывало жаркого заката, в Москве"))
    which = F.col("o_orderkey") % 4
    content = F.coalesce(*(F.when(which == i, F.encode(said, c)) for i, c in enumerate(text.CHARSETS)))
    return t("orders").select("o_orderkey", text.decoded(content).alias("out"))
