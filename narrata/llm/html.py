"""Main text of web pages, with the removal of site templates.

A small tree builder reads a page. The subtrees of all pages are hashed (tags and text) and counted for each host in
Spark, before anything else is taken out; those that recur on many pages of a host are deleted. Of what is left, the
articles (without any, the main elements, else the body) are the text: a block for each block element, in page order,
without the elements that are no text by their tag or role, or by a class or id that names one of the kinds of the
contract (menu, header, footer, sidebar, notice, advert, form, reader comments). Nothing else is dropped.

A subtree is a template of a host with n pages if it is on needed(n) of them: a tenth, or MANY, but LEAST at least and in
small hosts half of the pages (up to MIN_PAGES). Outside articles every element is counted, on pages. Inside articles
every block element is, paragraphs, headings and items too (an inline element is part of a sentence). As articles are copied and
edited, pages count there by their companies, the least hash among the other blocks of the articles: copies share it and
near copies mostly do, so that what recurs only among them is no template. As another template may be the least, that is
done in a few random orders, of which the one with the most companies counts. A subtree is deleted only on the side (inside
or outside articles) where it recurs.

Defined cases: null or empty html gives empty text; unclosed tags, comments and references are read as browsers do, up to
the end of the page; a host of fewer than LEAST pages has no templates; pages of a null url count as one host, the empty
one; repeated rows each get the same text; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import lean, mix64, small, stage, table
from narrata.llm.urls import host_of

LEAST, MIN_PAGES, MIN_SHARE, MANY = 3, 8, 0.1, 1000
#: What hashes are mixed with for the orders that companies are by; and what stands for no company.
ORDERS = mix64(np.arange(1, 5, dtype=np.uint64))
NONE = np.iinfo(np.uint64).max

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: An open element of the first kind ends when one of the second begins, unless one of the third is between.
ENDED_BY = {
    "p": (BLOCK, frozenset("article aside blockquote body button div fieldset figure footer form header html li main nav section table td th".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "tbody", "tfoot", "thead"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "tr", "tbody", "tfoot"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "head": (frozenset(["body"]), frozenset()),
}
ENDS = frozenset().union(*(ends for ends, _ in ENDED_BY.values()))
# Fixed values of the contract, as tags, roles, and parts of class names and ids.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input menu head title search noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus".split())
CONTENT = frozenset(["html", "body", "main", "article"])
#: A comment, a CDATA section, a tag (an attribute's value may be quoted and hold anything), a declaration. No part is read
#: twice: what may not match is possessive, and a quote that is never closed is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children", "digest", "chars", "template")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.template = tag, attributes, [], False


def parsed(page: str) -> Element:
    root = Element("")
    open_, names = [root], Counter()
    at, last = 0, page.rfind(">")

    def close(i: int) -> None:
        names.subtract(e.tag for e in open_[i:])
        del open_[i:]

    while m := TOKEN.search(page, at, last + 1):  # no tag ends after the last ">"
        if m.start() > at:
            open_[-1].children.append(page[at : m.start()])
        at = m.end()
        if at == last + 1 and (m[1] is not None or m.group().startswith("<!--")) and not m.group().endswith(("-->", "]]>")):
            at = len(page)  # it is never closed
        if m[1]:
            open_[-1].children.append(m[1].replace("&", "&amp;"))
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            for i in range(len(open_) - 1, 0, -1) if names[tag] else ():
                if open_[i].tag == tag:
                    close(i)
                    break
                if open_[i].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        for i in range(len(open_) - 1, 0, -1) if tag in ENDS else ():
            ends, scope = ENDED_BY.get(open_[i].tag, ((), ()))
            if tag in ends:
                close(i)
                break
            if open_[i].tag in BLOCK and open_[i].tag not in ENDED_BY or open_[i].tag in scope:
                break
        e = Element(tag, m[4] or m[7] or "")
        open_[-1].children.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and (tag in BLOCK or not e.attributes.endswith("/")):
            open_.append(e)
            names[tag] += 1
    if rest := re.split("<[!?/]", page[at:], maxsplit=1)[0]:
        open_[-1].children.append(rest)
    return root


def hashed(e: Element) -> bytes:
    """Hashes e and all elements in it, without recursion."""
    stack = [(e, False)]
    while stack:
        x, ready = stack.pop()
        if not ready:
            stack.append((x, True))
            stack += [(c, False) for c in x.children if not isinstance(c, str)]
            continue
        h, x.chars = blake2b(x.tag.encode(), digest_size=8), 0
        for c in x.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                x.chars += len(text)
                h.update(b"\0" + text.encode())
            else:
                x.chars += c.chars
                h.update(b"\1" + c.digest)
        x.digest = h.digest()
    return e.digest


def dropped(e: Element, inside: bool) -> bool:
    """Whether an element is no text by its tag or attributes. inside: it is in an article."""
    if e.tag in DROPPED or e.tag == "header" and not inside:
        return True
    if not e.attributes or e.tag in CONTENT:
        return False
    for m in ATTRIBUTE.finditer(e.attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ROLES:
                return True
        elif any(p in NAMES or p == "header" and not inside for p in re.split(r"[^a-z]+", value)):
            return True
    return False


def content(root: Element) -> list[Element]:
    """The outermost articles; without any, the main elements; else the root."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    stack = [root]
    while stack:
        e = stack.pop()
        if e.tag in found:
            found[e.tag].append(e)
            if e.tag == "article":
                continue
        if e.tag == "" or not dropped(e, False):
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]
    return found["article"] or found["main"] or [root]


def subtrees(root: Element) -> Iterator[tuple[Element, bool]]:
    """The elements that may be templates (hashed), with whether they are in an article."""
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        if e.tag in CONTENT or e.tag == "":
            inside = inside or e.tag == "article"
        elif e.chars and (not inside or e.tag in BLOCK):
            yield e, inside
        stack += [(c, inside) for c in e.children if not isinstance(c, str)]


def counted(page: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Hashes of a page's elements outside articles; of those inside; the companies of these, and those of no element.

    A company is the least of the hashes of the innermost blocks that are not in an element, in each of len(ORDERS) random
    orders; NONE if there are none. Of equal elements the least counts.
    """
    root = parsed(page)
    hashed(root)
    outside, leaves, inside, first, last = set(), [], [], [], []
    stack: list[tuple[Element, bool, int | None]] = [(root, False, None)]
    while stack:
        e, within, since = stack.pop()
        if since is not None:  # all that is in e is done
            if since == len(leaves):
                leaves.append(e.digest)
            inside.append(number(e))
            first.append(since)
            last.append(len(leaves))
            continue
        if e.tag in CONTENT or e.tag == "":
            within = within or e.tag == "article"
        elif e.chars and not within:
            outside.add(number(e))
        elif e.chars and e.tag in BLOCK:
            stack.append((e, True, len(leaves)))
        stack += [(c, within, None) for c in e.children if not isinstance(c, str)]
    h = mix64(np.frombuffer(b"".join(leaves), np.uint64)[None, :] ^ ORDERS[:, None])
    end = np.full((len(ORDERS), 1), NONE)
    before = np.minimum.accumulate(np.hstack([end, h]), 1)
    after = np.minimum.accumulate(np.hstack([end, h[:, ::-1]]), 1)[:, ::-1]
    company = np.minimum(before[:, first], after[:, last]).T if inside else np.empty((0, len(ORDERS)), np.uint64)
    if len(set(inside)) < len(inside):
        inside, of = np.unique(np.array(inside), return_inverse=True)
        least = np.full((len(inside), len(ORDERS)), NONE)
        np.minimum.at(least, of, company)
        inside, company = inside.tolist(), least
    return list(outside), inside, company, before[:, -1]


def number(e: Element) -> int:
    return int.from_bytes(e.digest, "little", signed=True)


def main_text(page: str, outside: frozenset[int] = frozenset(), inside: frozenset[int] = frozenset()) -> str:
    """The text of a page without the templates (hashes) outside and inside articles."""
    root = parsed(page)
    if outside or inside:
        hashed(root)
        for e, i in list(subtrees(root)):
            e.template = number(e) in (inside if i else outside)
    blocks, text = [], []

    def close() -> None:
        if line := " ".join("".join(text).split()):
            blocks.append(line)
        text.clear()

    tops = content(root)
    stack: list = []
    for top in reversed(tops):
        stack += [close, *reversed(top.children), close]
    in_article = tops[0].tag == "article"
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            text.append(html.unescape(x) if "&" in x else x)
        elif not isinstance(x, Element):
            x()
        elif x.tag == "br":
            text.append(" ")
        elif not x.template and not dropped(x, in_article):
            if x.tag in BLOCK:
                close()
                stack.append(close)
            stack += reversed(x.children)
    close()
    return "\n\n".join(blocks)


HASHES = "host string, outside array<long>, inside array<long>, companies array<array<long>>, whole array<long>"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page; companies of -1 are none."""
    for b in batches:
        found = [counted(page.as_py() or "") for page in b.column("html")]
        columns = [[x[0] for x in found], [x[1] for x in found], [x[2].view(np.int64).tolist() for x in found], [x[3].view(np.int64).tolist() for x in found]]
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("host"), *(pa.array(c, t) for c, t in zip(columns, (long, long, pa.list_(long), long), strict=True))], ["host", "outside", "inside", "companies", "whole"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [main_text(p.as_py() or "", *(frozenset(x.as_py() or ()) for x in t)) for p, *t in zip(b.column("html"), b.column("outside"), b.column("inside"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], ["page_id", "url", "text", "n_chars"])


def needed(pages: Column) -> Column:
    """On how many of a host's pages a subtree must be to be a template."""
    share = F.greatest(F.lit(float(LEAST)), MIN_SHARE * pages, F.least(F.lit(float(MIN_PAGES)), pages / 2))
    return F.least(F.lit(float(MANY)), share)


def site_templates(pages: DataFrame) -> DataFrame:
    """host, outside, inside: hashes of the subtrees that recur on the host's pages. pages: host, html.

    Pages are counted first; companies only of what is on LEAST pages or more, as they can't be more. All counts are
    summed before they move.
    """
    rows = stage(pages.select("host", "html").mapInArrow(lean(_hashes), HASHES), "subtrees")
    inside = rows.select("host", F.explode(F.arrays_zip("inside", "companies")).alias("x")).select("host", F.col("x.inside").alias("digest"), "x.companies")
    count = lambda df: df.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    outside = count(rows.select("host", F.explode("outside").alias("digest"))).withColumn("inside", F.lit(False))
    often = stage(count(inside.select("host", "digest")).select("host", "digest"), "recurring")
    size = often.agg(F.sum(F.length("host") + 32)).head()[0] or 0
    known = lambda df, *by: df.where("company <> -1").distinct().groupBy(*by, "order").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("n"))
    companies = known(inside.join(small(often, size), ["host", "digest"]).select("host", "digest", F.posexplode("companies").alias("order", "company")), "host", "digest")
    found = outside.unionByName(companies.withColumn("inside", F.lit(True)))
    wholes = known(rows.select("host", F.posexplode("whole").alias("order", "company")), "host").select("host", F.lit(True).alias("inside"), F.col("n").alias("pages"))
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("pages")).withColumn("inside", F.lit(False)).unionByName(wholes), "hosts")
    size = hosts.agg(F.sum(F.length("host") + 32)).head()[0] or 0
    often = found.join(small(hosts, size), ["host", "inside"]).where(F.col("n") >= needed(F.col("pages")))
    side = lambda i: F.collect_list(F.when(F.col("inside") == i, F.col("digest")))
    return often.groupBy("host").agg(side(False).alias("outside"), side(True).alias("inside"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. The pages are read twice; they are shuffled only if templates are many."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    templates = stage(site_templates(pages), "templates")
    size = templates.agg(F.sum((F.size("outside") + F.size("inside")) * 8 + F.length("host") + 64)).head()[0] or 0
    joined = pages.join(small(templates, size), "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "outside", "inside")
    return joined.mapInArrow(lean(_texts), "page_id long, url string, text string, n_chars long")


def op6_html_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
