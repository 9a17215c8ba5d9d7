"""FB2 and EPUB readers, archive limits, covers, sinks."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from narrata.sources import books, sinks

FB2 = """<?xml version="1.0" encoding="utf-8"?><!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>
<author><first-name>Иван</first-name><last-name>Бунин</last-name></author><book-title>Книга  1</book-title><sequence name="Цикл" number="2"/>
<coverpage><image l:href="#c.jpg"/></coverpage></title-info></description><body>
<section><title><p>Часть первая.</p></title><section><title><p>Глава 1</p></title><p>Текст <b>один</b></p><!-- x --></section>
<section><title><p>Глава 2</p></title><poem><stanza><v>строка</v></stanza></poem></section></section></body><binary id="c.jpg">%s</binary></FictionBook>"""


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": """<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Т</dc:title><dc:creator>А</dc:creator>
<meta property="belongs-to-collection" id="s">Цикл</meta><meta refines="#s" property="group-position">3</meta></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="z" href="a.xhtml" media-type="application/xhtml+xml"/>
<item id="cv" href="c.xhtml" properties="cover-image" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="z" linear="no"/></spine></package>""",
    "OPS/a.xhtml": "<html><body><h1>Глава 1</h1><p>Текст</p></body></html>",
    "OPS/n.xhtml": "<html><body>nav</body></html>",
    "OPS/c.xhtml": '<html><img src="i/c.png"/></html>',
    "OPS/i/c.png": "PNG",
}


def test_fb2():
    b = books.book("x.fb2", (FB2 % base64.b64encode(b"JPG").decode()).encode())
    assert (b["title"], b["author"], b["series"], b["series_index"], b["cover"], b["status"]) == ("Книга 1", "Иван Бунин", "Цикл", "2", b"JPG", "ok")
    assert b["chapters"] == [("Часть первая. Глава 1", "Текст один"), ("Глава 2", "строка")]


def test_epub():
    b = books.book("x.epub", archive(EPUB))
    assert (b["title"], b["author"], b["series"], b["series_index"], b["cover"]) == ("Т", "А", "Цикл", "3", b"PNG")
    assert b["chapters"] == [("Глава 1", "Текст")]


def test_damaged(spark):
    big = archive({**EPUB, "big": "0" * (17 << 20)})
    files = spark.createDataFrame([("a.fb2", bytearray(b"<a>")), ("b.epub", bytearray(b"zip")), ("c.epub", bytearray(big)), ("d.fb2", bytearray(b"<body/>"))], "path string, content binary")
    got = {r.path: r.status for r in books.read_books(files).collect()}
    assert got["a.fb2"].startswith("damaged") and got["b.epub"].startswith("damaged")
    assert got["c.epub"] == "unsafe archive: member ratio" and got["d.fb2"] == "no text"


def test_hostile_paths():
    assert [books.inside("OPS/p.opf", r) for r in ("../../x", "/x", "http://h/x", "a\\b", "", "..%2F..%2Fx")] == [None] * 6
    assert books.inside("OPS/p.opf", "i/../c.png") == "OPS/c.png"


def test_publish_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([("h1", 1, "a"), ("h2", 2, "b"), ("h1", 1, "a")], "content_hash string, job_id long, name string")
    assert [sinks.publish(items, str(tmp_path / "lib")) for _ in range(2)] == [2, 0]
    assert spark.read.parquet(str(tmp_path / "lib")).count() == 2


def test_library_path(spark):
    lit = F.lit
    df = spark.range(1).select(sinks.library_path(lit("Автор"), lit("Книга"), lit("Цикл"), lit("02"), lit("s.fb2"), lit("e" * 64), lit(7)), sinks.base_name(lit("Т"), lit("А"), lit("x.fb2")), sinks.base_name(lit(""), lit("А"), lit("x.fb2")))
    assert list(df.head()) == ["Автор/Цикл/02 - Книга [eeeeeeeeeeee-7]", "А - Т", "x"]


def test_publish_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "lib")
    item = lambda h, j, t: (h, j, t)
    frame = lambda *rows: spark.createDataFrame(rows, "content_hash string, job_id long, title string")
    assert sinks.published(spark, path) is None
    assert sinks.publish(frame(item("a", 1, "x"), item("a", 1, "x"), item("b", 2, None)), path) == 2
    (tmp_path / "lib" / ".staging-left").mkdir()  # as a broken run leaves it
    assert sinks.publish(frame(item("a", 1, "x"), item("c", 3, "z")), path) == 1
    for wrong in (frame(item("d", 4, "new"), item("a", 1, "other")), frame(item("e", 5, "1"), item("e", 5, "2"))):
        with pytest.raises(ValueError):
            sinks.publish(wrong, path)
    assert sorted(r.content_hash for r in sinks.published(spark, path).collect()) == ["a", "b", "c"]
    assert sinks.publish(frame(), path) == 0 and not [p for p in (tmp_path / "lib").iterdir() if p.name.startswith(".staging-") and p.name != ".staging-left"]


def test_publish_meets_another_writer(spark, tmp_path, monkeypatch):
    path, items = str(tmp_path / "lib"), spark.createDataFrame([("a", 1), ("b", 2)], "content_hash string, job_id long")
    assert sinks.publish(items, path) == 2
    monkeypatch.setattr(sinks, "published", lambda *a: None)  # the other writer was not done when this one looked
    assert sinks.publish(items, path) == 0
    monkeypatch.undo()
    assert sinks.published(spark, path).count() == 2
