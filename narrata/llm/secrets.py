"""Secret scans: pattern spans, and literals that source or configuration text assigns to sensitive names.

The lexer reads name-literal pairs (name = "x", "name": x, name => 'x', <name>x</name>, export NAME=x) and, where the
right side is made of names, the literals that those names are bound to there (constants, also by several steps and
joined by +; see literal_spans). A literal is reported if a name it reaches is sensitive enough and it looks like a secret.
All of it is linear in the text, and names and literals have any length.

Defined cases: null text is empty (no spans); repeated rows each get the same spans; offsets are code points, end
exclusive; other columns are ignored, or kept by redact_secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import lean, table

KINDS = ("assign", "access", "hex", "literal")
#: One must be in the text, in lower case, for ASSIGN to match.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a word in a name says that the value is secret; the sum for a name counts.
WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.5, "api": 0.3, "private": 0.4, "access": 0.3, "key": 0.6,
    "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.2, "webhook": 0.2, "salt": 0.4,
    "public": -0.8, "example": -0.6, "name": -0.6, "id": -0.3, "path": -0.7, "file": -0.6, "url": -0.5, "length": -0.9,
    "count": -0.9, "type": -0.8, "field": -0.6, "max": -0.8, "min": -0.8, "ttl": -0.9, "expiry": -0.9, "hint": -0.6, "policy": -0.8,
}
SENSITIVE = 0.8
LIKELY = 0.45
TELLING = {w: x for w, x in WEIGHT.items() if x > 0}
PAIR = re.compile(r"""(?<![\w$.-])(["'`]?)([A-Za-z_$][\w$.-]*+)\1[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*""")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\s]++)</\1>")
TERM = re.compile(r"""(?P<quote>["'`])(?P<quoted>(?:[^"'`\\\n]|\\.)*)(?P=quote)|(?P<bare>[^\s"'`,;(){}\[\]<>+]+)""")
PLUS = re.compile(r"[\x20\t]*(?:\+|\.\.|&)[\x20\t]*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
NAME = re.compile(r"[A-Za-z_$][\w$.-]*")
PLACEHOLDER = re.compile(r"(?i)(?:your|my|some|the)?[-_]?(?:change[-_]?me|placeholder|example|todo|none|null|true|false|undefined|redacted|x{3,}|\*{3,}|\.{3,})")


def name_score(name: str) -> float:
    found = [w.lower() for w in WORDS.findall(name)]
    return sum(WEIGHT.get(w, 0.0) for w in dict.fromkeys(found))


def may_name(lower: str) -> bool:
    """Whether the words in a text, in lower case, could make up a sensitive name; if not, there is nothing to parse."""
    total = 0.0
    for w, x in TELLING.items():
        if w in lower:
            total += x
            if total > SENSITIVE - 1e-9:
                return True
    return False


def literal_score(text: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret rather than a word, a number, a template or a placeholder."""
    if len(text) < 6 or PLACEHOLDER.fullmatch(text) or text[:1] in "$<{%" or "://" in text and "@" not in text:
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    score = min(1.0, n / 20) * 0.3 + min(1.0, bits / 3.5) * 0.4 + (classes - 1) * 0.2
    if re.search(r"\s", text) or classes == 1 and not quoted:
        score -= 0.4
    return max(0.0, min(1.0, score))


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, each leftmost and non-overlapping."""
    found = []
    if any(n in lower for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def pairs(text: str) -> Iterator[tuple[str, int, bool, list[tuple[str, int, int, bool]]]]:
    """Bindings in order: name, place, whether it is indented, and the terms of the right side: (text, start, end, quoted)."""
    for m in PAIR.finditer(text):
        at, terms = m.end(), []
        while t := TERM.match(text, at):
            which = "quoted" if t["quote"] else "bare"
            terms.append((t[which], *t.span(which), which == "quoted"))
            at = t.end()
            if not (p := PLUS.match(text, at)):
                break
            at = p.end()
        if terms:
            yield m[2], m.start(), m.start() > 0 and text[m.start() - 1] in " \t", terms
    for m in ELEMENT.finditer(text):
        yield m[1], m.start(), True, [(m[2], *m.span(2), False)]


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name.

    A name on a right side stands for its last binding before (for its first one, if all come later). A binding that is
    indented may be conditional, so those of the same name before it still count; one that is not hides them. A binding is
    as sensitive as the most sensitive name that its value flows to: from sensitive names backwards, each binding once.
    """
    bound = sorted(pairs(text), key=lambda b: b[1])
    by_name: dict[str, list[int]] = {}
    for i, (name, *_) in enumerate(bound):
        by_name.setdefault(name, []).append(i)
    before = dict.fromkeys(range(len(bound)), -1)
    for places in by_name.values():
        for earlier, i in zip(places, places[1:], strict=False):
            before[i] = earlier if bound[i][2] else -1
    open_ = [i for i, (name, *_) in enumerate(bound) if name_score(name) >= SENSITIVE]
    reached = set(open_)
    while open_:
        i = open_.pop()
        sources = [before[i]]
        for t, _, _, quoted in bound[i][3]:
            if not quoted and (places := by_name.get(t)):
                sources.append(places[max(0, bisect_left(places, i) - 1)])
        for j in sources:
            if j >= 0 and j not in reached:
                reached.add(j)
                open_.append(j)
    return sorted({(a, 3, b) for i in reached for t, a, b, quoted in bound[i][3] if (quoted or t not in by_name) and literal_score(t, quoted) >= LIKELY})


def beyond(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the literals found, those of which a part lies in no base span. base: sorted."""
    starts, ends = [], []
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in found if not (i := bisect_right(starts, s[0])) or ends[i - 1] < s[2]]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added ones. Added are those that reach beyond the base spans; they may overlap them."""
    lower = text.lower()
    base = base_spans(text, lower)
    added = []
    if ("=" in text or ":" in text or "</" in text) and may_name(lower):
        added = beyond(literal_spans(text), base)
    return base, added


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column("text"):
            base, added = spans(text.as_py() or "")
            n = Counter(k for _, k, _ in base + added)
            rows.append((*(n[k] for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], [f.split()[0] for f in OUT.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts by kind, a digest of the base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scan), OUT)


def redacted(text: str) -> str:
    """text with every span, or run of overlapping spans, replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in sorted(sum(spans(text), [])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [None if t is None else redacted(t) for t in b.column("text").to_pylist()]
        new = {"text": pa.array(done, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in done], pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], b.schema.names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced and n_chars (if there) counted anew; no row is dropped."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.mapInArrow(lean(_redact), docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
