"""Queries over whole texts, on texts with very long sentences and words, and with something to do far from the start."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from narrata.functions import speech
from narrata.plans.registry import QUERIES

SCHEMA = "doc_id long, source string, text string"


@pytest.fixture
def sf(spark, tmp_path):
    def written(texts):
        spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return written


def hard(text, most):
    """The hard split, word by word."""
    if len(text) <= most:
        return [text]
    out, cur = [], None
    for w in text.split(" "):
        if len(w) > most:
            out += [cur] * (cur is not None) + [w[i : i + most] for i in range(0, len(w), most)]
            cur, n = None, 0
        elif cur is not None and n + len(w) + 1 > most:
            out.append(cur)
            cur, n = w, len(w) + 1
        else:
            cur, n = (w, len(w) + 1) if cur is None else (f"{cur} {w}", n + len(w) + 1)
    return out + [cur] * (cur is not None)


def pack(pieces, most=800):
    out, buf, n = [], [], 0
    for p in pieces:
        if n and n + len(p) + 1 > most:
            out.append(" ".join(buf))
            buf, n = [], 0
        buf.append(p)
        n += len(p) + 1
    return out + [" ".join(buf)] * (n > 0)


LONG = [["word " * 700 + "end.", "Short one."], ["x" * 2500 + "."], ["Ab cd.", "Y" + "y" * 300 + " z" * 500 + " " + "w" * 1201 + " tail."], ["Only this."]]


def test_chunk_plan_sizes(spark, sf):
    d = sf([" ".join(s) for s in LONG])
    chunks = {k: [c for i, s in enumerate(LONG) if i % 2 == k for c in pack([p for x in s for p in hard(x, 1000)])] for k in (0, 1)}
    got = {r.source: (r.chunks, r.longest) for r in QUERIES["chunk_plan_sizes"](spark, d).collect()}
    assert got == {f"s{k}": (len(c), max(map(len, c))) for k, c in chunks.items()}


def test_chunk_hard_split(spark, sf):
    texts = [" ".join(s) for s in LONG] + ["a" * 200 + " " + "b" * 201, ""]
    d = sf(texts)
    got = {r.doc_id: r.pieces for r in QUERIES["chunk_hard_split"](spark, d).collect()}
    assert got == {i: len(hard(f"{t} {'z' * 450} end", 200)) for i, t in enumerate(texts)}


FAR = "a" * 100


@pytest.mark.parametrize(
    ("name", "text", "wanted"),
    [
        ("quote_normalize", f"{FAR} “x” it’s", f"«{FAR} «x» it's» «x» \" it's"),
        ("punctuation_ligatures", f"{FAR}⁉", f"{FAR}!??! !? !! ??"),
        ("metadata_text", f"{FAR} \n\t b", f"{FAR} b"),
        ("escape_meta", f"{FAR}=;\nx", rf"{FAR}\=\; x \= a\;b\#c\\"),
    ],
)
def test_expressions_reach_the_end(spark, sf, name, text, wanted):
    d = sf([text])
    assert [r.out for r in QUERIES[name](spark, d).collect()] == [wanted]


def test_active_duplicates_by_text(spark, sf, tmp_path):
    d = sf(["x", "same", "other", "same", "y"])
    orders = spark.range(1, 9).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.content_hash for r in QUERIES["active_duplicates"](spark, d).collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest() for t in ("same", "other", "y")}


def test_clean_text_full(spark, sf):
    """The one query without SQL: the carrier's words, and that no document is lost."""
    d = sf(["Plain text, 7 of it.", ""])
    said = "В тысяча девятьсот пятом году он купил пять кг и так далее.\nГлава четырнадцать."
    got = {r.doc_id: r.out for r in QUERIES["clean_text_full"](spark, d).collect()}
    assert got[1] == said and got[0].startswith(said) and "семь" in got[0] and len(got) == 2


def test_long_texts_are_spoken_in_linear_time():
    text = "В 1905 г. он купил 5 кг и т. д. Глава 14. в 300 г. до н. э. и 5 % от 3,5 г муки. " * 12_000
    began = time.time()
    speech.spoken(text)
    assert len(text) > 900_000 and time.time() - began < 30
