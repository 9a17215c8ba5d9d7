"""Rules of running text, sentences, chapters and decoding, on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from narrata.functions import letters, speech, whitespace
from narrata.operators import chapters, sentences
from narrata.sources import text

SPOKEN = [
    ("1 см. 2 см. 5 см.", "один сантиметр. два сантиметра. пять сантиметров."),
    ("В 1905 г. Москва.", "В тысяча девятьсот пятом году. Москва."),
    ("В 1905 г. он родился.", "В тысяча девятьсот пятом году он родился."),
    ("12.03.2024", "двенадцатого марта две тысячи двадцать четвёртого года"),
    ("к 5-му дому", "к пятому дому"),
    ("с 3-ым", "с третьим"),
    ("5%, №5", "пять процентов, номер пять"),
    ("В 90-е годы.", "В девяностые годы."),
    ("по 300 г. муки", "по триста граммов муки"),
    ("с 1941 по 1945 г.", "с тысяча девятьсот сорок первого по тысяча девятьсот сорок пятый год."),
    ("300 г. до н. э.", "трёхсотый год до нашей эры."),
    ("10 000", "десять тысяч"),
    ("3,14", "три целых четырнадцать сотых"),
    ("театр им. Пушкина", "театр имени Пушкина"),
    ("горжусь им. Он", "горжусь им. Он"),
]
CLEAN = [
    ("2+2", "два плюс два"), ("pека и cад", "река и сад"), ("кто-\nнибудь", "кто-нибудь"), ("что-\nто", "что-то"), ("мес-\nто", "место"), ("сло-\nво", "слово"),
    ("Начало XIX века.", "Начало девятнадцатого века."), ("Пётр I", "Пётр один"), ("Слово[12] и", "Слово и"), ("Ты серьёзно⁈", "Ты серьёзно?!"), ("а\n- 12 -\nб", "а б"), ("", ""), (None, None),
    ("Hello", "хелло"), ("“Да”", "«Да»"),
]


@pytest.mark.parametrize(("source", "wanted"), SPOKEN)
def test_spoken(source, wanted):
    assert speech.spoken(source) == wanted


def test_clean_text(spark):
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CLEAN)], "i int, s string").select("i", speech.clean_text(F.col("s")).alias("out")).orderBy("i").collect()
    assert [r.out for r in got] == [w for _, w in CLEAN]


def one(spark, column, *values):
    return [r.out for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("out")).orderBy("i").collect()]


def test_sentences(spark):
    got = one(spark, sentences.sentences, "Часть вторая\nБыло утро.", "А. С. Пушкин жил. Он писал", "5 руб. Это дёшево.", "", "Он сказал: «Да!» Она ушла")
    assert got == [["Часть вторая.", "Было утро."], ["А. С. Пушкин жил.", "Он писал."], ["5 руб.", "Это дёшево."], [], ["Он сказал: «Да!»", "Она ушла."]]


def test_halves(spark):
    assert one(spark, sentences.halves, "Раз два. Три четыре.", "Раз два, три четыре", "Слово") == [["Раз два.", "Три четыре."], ["Раз два,", "три четыре"], None]


def test_packing(spark):
    got = one(spark, lambda x: sentences.packed(F.split(x, "/"), 10), "aaaa/bbbb/c", "aaaaaaaaaaaaaaa/b", "a")
    assert got == [["aaaa bbbb", "c"], ["aaaaaaaaaaaaaaa", "b"], ["a"]]
    assert one(spark, lambda x: sentences.hard_split(x, 5), "aa bb cc", "abcdefghijkl m", "abc") == [["aa", "bb", "cc"], ["abcde", "fghij", "kl", "m"], ["abc"]]


def test_chapters(spark):
    got = one(spark, chapters.split_chapters, "Предисловие\nx\nГлава 1\nа\nГлава вторая. Встреча\nб", "Часть первая\n\nГлава 1\nа\nГлава 2\nб", "Глава семьи вошёл в комнату", "")
    assert [[(c.title, c.text) for c in r] for r in got] == [[("Предисловие", "x"), ("Глава 1", "а"), ("Глава вторая. Встреча", "б")], [("Часть первая. Глава 1", "а"), ("Глава 2", "б")], [(None, "Глава семьи вошёл в комнату")], [(None, "")]]


def test_names(spark):
    assert all(len(n.encode()) <= 120 and n for n in one(spark, letters.safe_filename, "Ж" * 100, "a/b:c", None, "..."))
    assert one(spark, letters.safe_filename, "CON", "a...b ", None) == ["_CON", "a.b", "audiobook"]
    assert one(spark, lambda x: letters.escaped_excerpt(x, 8), "a&b<c", "ab") == ["a&amp;b...", "ab"]
    assert one(spark, letters.fitted_filename, "Ж" * 150 + ".epub", "a.txt") == ["Ж" * 97 + ".epub", "a.txt"]
    assert [len(x) for x in one(spark, letters.clipped, "x" * 10_000, "y")] == [4096, 1]


def test_linear_hyphens(spark):
    assert one(spark, lambda x: F.length(whitespace.joined_hyphens(x)), "а" * 200_000) == [200_000]


@pytest.mark.parametrize("charset", ["cp1251", "koi8-r", "cp866", "iso8859-5", "utf-8", "utf-16", "utf-8-sig"])
def test_decoding(spark, charset):
    said = "Он долго стоял у окна и смотрел на пустую улицу, где шёл мокрый снег."
    df = spark.createDataFrame([(bytearray(said.encode(charset)),)], "content binary")
    assert df.select(text.decoded(F.col("content"))).head()[0] == said


def test_markup():
    page = '<head><title>x</title></head><p>сло<b>во</b><sup class="footnote">1</sup></p><p>a<br>b &amp;lt; H<sub>2</sub>O</p><script>1</script><sup><a href="#fn1">1</a></sup>'
    got = text.html_text(page)
    assert "слово" in got and "1" not in got and "b < H 2 O" in got and "x" not in got
    assert text.markdown_text("# Title\n\n- **bold** [link](http://x)\n> q\n```\ncode\n```").split() == ["Title", "bold", "link", "q", "code"]
    assert text.rtf_text(rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}\f0 \'cf\'f0\'e8\par b\u1078?}") == "При\nbж"


def test_captions(spark):
    got = spark.createDataFrame([("Автор: А\nназвание : Б\nАвтор: В\nЖанр: x\nСерия:",), (None,)], "c string").select(text.caption_fields(F.col("c")).alias("m")).collect()
    assert [r.m for r in got] == [{"author": "В", "title": "Б"}, {}]
