"""Books: FB2 and EPUB files as rows with their chapters, metadata and cover. One Arrow pass over binary files."""

from __future__ import annotations

import base64
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from narrata.operators.identity import MEMBER_BYTES, MEMBER_FROM, MEMBERS, RATIO, TOTAL_BYTES, TOTAL_FROM
from narrata.sources.text import html_text

DEEPEST, LONGEST_TITLE = 32, 80
COVER_BYTES, XML_BYTES = 20 << 20, 4 << 20
SCHEMA = "path string, title string, author string, series string, series_index string, chapters array<struct<title:string,text:string>>, cover binary, status string"
PROSE = ("p", "v", "subtitle", "text-author")


def local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def field(value: str | None) -> str | None:
    return " ".join(value.split()) or None if value else None


def tree(data: bytes) -> ET.Element:
    """XML without its document type, so that no entity is defined; stray ampersands and control characters are tolerated."""
    data = re.sub(rb"<!DOCTYPE(?:[^>\[]|\[.*?\])*>", b"", data, count=1, flags=re.S)
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        repaired = re.sub(rb"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", b"&amp;", re.sub(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", b"", data))
        return ET.fromstring(repaired)


def named(root: ET.Element, *path: str) -> list[ET.Element]:
    """Elements by a path of local names, the first anywhere below the root."""
    found = [e for e in root.iter() if local(e) == path[0]]
    for name in path[1:]:
        found = [c for e in found for c in e if local(c) == name]
    return found


def prose(section: ET.Element, skipped: tuple[str, ...]) -> list[str]:
    """The texts of the outermost prose elements in order, without the named children."""
    out, stack = [], [c for c in reversed(section) if local(c) not in skipped]
    while stack:
        e = stack.pop()
        if local(e) in PROSE:
            if text := "".join(e.itertext()).strip():
                out.append(text)
        elif local(e):
            stack += reversed(e)
    return out


def sections(body: ET.Element) -> Iterator[tuple[str | None, str]]:
    """Chapters of a body. A section's title without prose goes before its first child's; below DEEPEST all is one chapter."""
    stack = [(s, None, 0) for s in reversed(body) if local(s) == "section"]
    if not stack and (text := "\n\n".join(prose(body, ()))).strip():
        yield None, text
    while stack:
        s, lead, depth = stack.pop()
        own = " ".join(t.strip() for c in s if local(c) == "title" for t in c.itertext() if t.strip()) or None
        title = f"{lead.rstrip('.:')}. {own}" if lead and own else lead or own
        inner = [c for c in s if local(c) == "section"] if depth < DEEPEST else []
        text = "\n\n".join(prose(s, ("title", "section") if inner else ("title",)))
        if text.strip():
            yield title, text
            title = None
        stack += [(c, title if i == 0 else None, depth + 1) for i, c in reversed(list(enumerate(inner)))]


def read_fb2(data: bytes) -> dict:
    root = tree(data)
    info = (named(root, "title-info") or [ET.Element("none")])[0]
    text = lambda *p: next((e.text for e in named(info, *p) if e.text and e.text.strip()), None)
    author = " ".join(filter(None, (field(text("author", "first-name")), field(text("author", "last-name"))))) or None
    series = (named(info, "sequence") or [ET.Element("none")])[0]
    image = next(iter(named(info, "coverpage", "image")), None)
    ref = next((v for k, v in image.attrib.items() if k.rpartition("}")[2] == "href"), "") if image is not None else ""
    binary = next((b for b in named(root, "binary") if ref[:1] == "#" and b.get("id") == unquote(ref[1:])), None)
    cover = None
    if binary is not None and len(binary.text or "") <= 2 * COVER_BYTES:
        try:
            cover = base64.b64decode("".join((binary.text or "").split()), validate=True)
        except ValueError:
            cover = None
    return {"title": field(text("book-title")), "author": author, "series": field(series.get("name")), "series_index": field(series.get("number")), "chapters": [c for b in named(root, "body") for c in sections(b)], "cover": cover}


def unsafe(archive: zipfile.ZipFile) -> str | None:
    """The first limit that an archive breaks."""
    members = archive.infolist()
    size = packed = 0
    if len(members) > MEMBERS:
        return "members"
    for m in members:
        size, packed = size + m.file_size, packed + m.compress_size
        rules = {"compression": m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), "member size": m.file_size > MEMBER_BYTES, "member ratio": m.file_size > MEMBER_FROM and m.file_size > RATIO * max(m.compress_size, 1), "total size": size > TOTAL_BYTES}
        if broken := next((k for k, v in rules.items() if v), None):
            return broken
    return "total ratio" if size > TOTAL_FROM and size > RATIO * max(packed, 1) else None


def inside(base: str, reference: str) -> str | None:
    """The archive path that a reference from base means; null if it leaves the archive or is no path."""
    url = urlsplit(reference or "")
    path = unquote(url.path)
    if url.scheme or url.netloc or not path or path[0] == "/" or "\\" in path:
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), path))
    return None if path == ".." or path.startswith("../") else path


def series_of(package: ET.Element) -> tuple[str | None, str | None]:
    """Series and number: Calibre's, else those of a collection and the position that refines it."""
    own: dict[str, str | None] = {}
    collections, positions = {}, {}
    for m in named(package, "metadata", "meta"):
        value = field(m.get("content") or "".join(m.itertext()))
        if (m.get("name") or "").startswith("calibre:series"):
            own[m.get("name")] = value
        elif m.get("property") == "belongs-to-collection" and value:
            collections[m.get("id", "")] = value
        elif m.get("property") == "group-position" and value:
            positions[(m.get("refines") or "").lstrip("#")] = value
    name = own.get("calibre:series") or next(iter(collections.values()), None)
    return name, own.get("calibre:series_index") or next((positions[i] for i in collections if i in positions), None)


def epub_cover(archive: zipfile.ZipFile, package: ET.Element, at: str) -> bytes | None:
    items = named(package, "manifest", "item")
    marked = {m.get("content") for m in named(package, "metadata", "meta") if m.get("name") == "cover"}
    refs = [i.get("href") for i in items if "cover-image" in (i.get("properties") or "").split()] + [i.get("href") for i in items if i.get("id") in marked]
    refs += [r.get("href") for r in named(package, "guide", "reference") if r.get("type") == "cover"]
    for ref in dict.fromkeys(refs):
        try:
            name = inside(at, ref)
            if name and posixpath.splitext(name)[1].lower() in (".xhtml", ".html", ".htm", ".svg"):
                page = tree(archive.read(name)) if archive.getinfo(name).file_size <= XML_BYTES else ET.Element("none")
                pictures = [v for e in page.iter() if local(e) in ("img", "image") for k, v in e.attrib.items() if k.rpartition("}")[2] in ("src", "href")]
                name = inside(name, pictures[0]) if pictures else None
            if name and archive.getinfo(name).file_size <= COVER_BYTES:
                return archive.read(name)
        except (KeyError, ET.ParseError, zipfile.BadZipFile):
            continue
    return None


def read_epub(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if broken := unsafe(archive):
            return {"status": f"unsafe archive: {broken}"}
        at = named(tree(archive.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        package = tree(archive.read(at))
        items = {i.get("id"): i for i in named(package, "manifest", "item")}
        spine = named(package, "spine", "itemref")
        order = [items[r.get("idref")] for r in spine if r.get("linear") != "no" and r.get("idref") in items] if spine else list(items.values())
        chapters = []
        for item in order:
            if "html" not in (item.get("media-type") or "") or "nav" in (item.get("properties") or "").split():
                continue
            try:
                text = html_text(archive.read(inside(at, item.get("href")) or "").decode("utf-8", "replace")).strip()
            except KeyError:
                continue
            if not text:
                continue
            first = next(line.strip() for line in text.splitlines() if line.strip())
            rest = text[len(first) :].strip() if len(first) <= LONGEST_TITLE and text.startswith(first) else ""
            chapters.append((first, rest) if rest else (None, text))
        meta = lambda name: field(next((e.text for e in named(package, "metadata", name) if e.text), None))
        series, index = series_of(package)
        return {"title": meta("title"), "author": meta("creator"), "series": series, "series_index": index, "chapters": chapters, "cover": epub_cover(archive, package, at)}


def book(path: str, data: bytes) -> dict:
    """A row of SCHEMA; what can't be read gets a status instead of an error."""
    row = dict.fromkeys(("title", "author", "series", "series_index", "cover")) | {"path": path, "chapters": [], "status": "ok"}
    try:
        row |= read_epub(data) if path.lower().endswith(".epub") else read_fb2(data)
    except (ET.ParseError, zipfile.BadZipFile, KeyError, IndexError, ValueError, NotImplementedError, RuntimeError) as e:
        row["status"] = f"damaged: {type(e).__name__}"
    if row["status"] == "ok" and not row["chapters"]:
        row["status"] = "no text"
    return row


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for files in batches:
        rows = [book(p, bytes(c)) for p, c in zip(files["path"], files["content"], strict=True)]
        for r in rows:
            r["chapters"] = [{"title": t, "text": x} for t, x in r["chapters"]]
        yield pd.DataFrame(rows, columns=names)


def read_books(files: DataFrame) -> DataFrame:
    """path, content of FB2 and EPUB files -> rows of SCHEMA."""
    return files.select("path", "content").mapInPandas(_books, SCHEMA)
