"""Media columns: payloads kept as content-defined chunks, each stored once, and rebuilt from ordered chunk lists.

A payload is cut by a rolling gear hash. Joins over all documents find the chunks that occur more than once and the
document that owns each. The stored table has one row for each document (the ordered list of chunk digests and lengths,
with the chunks that only it has) and one for each shared chunk. Reading back fetches shared chunks by digest, inflates
every chunk, holds it against its digest, and only then computes features. Stored units are bytes: deflated 8-bit samples.

Defined cases: null text is an empty payload (64 zero bytes); equal texts have equal stored forms, whoever owns their
chunks; repeated rows each get the same values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.chunking import chunks, digest, fetched, plan, with_plan
from narrata.llm.common import lean, stage, table, text_key

HOW = {"bits": 11, "least": 512, "most": 16384, "chars": False}
UNIT = 64
STORED = "doc_id long, key binary, kind int, digest binary, n_bytes long, listed array<binary>, own array<binary>, need array<binary>"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}


def payload(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or UNIT * (not data))


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def feature(data: bytes) -> str:
    """Entropy of the samples in bits, their mean and deviation, and the share of neighbours that differ in their top bit."""
    x = np.frombuffer(data, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    turns = np.count_nonzero((x[1:] ^ x[:-1]) & 0x80)
    return f"{-(p * np.log2(p)).sum():.4f},{x.mean():.4f},{x.std():.4f},{turns / len(x):.4f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 250):
            part, rows = b.slice(at, 250), []
            for doc_id, key, text, planned in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text", "chunks")), strict=True):
                data = (text or "").encode()
                owned = {x["digest"]: x["owned"] for x in planned or ()}
                listed, own, need, sent = [], [], [], set()
                for c in chunks(payload(data), **HOW):
                    d = digest(c)
                    listed.append(d + struct.pack("<I", len(c)))
                    if d not in owned:
                        own.append(zlib.compress(c, 1))
                    elif d not in sent:
                        sent.add(d)
                        need.append(d)
                        if owned[d]:
                            rows.append((None, None, 1, d, None, None, [zlib.compress(c, 1)], None))
                rows.append((doc_id, key, 0, None, len(data), listed, own, need))
            yield batch(rows, STORED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, n_bytes, listed, own, others in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "listed", "own", "others")), strict=True):
            shared = {x["digest"]: x["stored"] for x in others or ()}
            mine = iter(own)
            stored = [shared[x[:16]] if x[:16] in shared else next(mine) for x in listed]
            parts = []
            for x, s in zip(listed, stored, strict=True):
                parts.append(c := zlib.decompress(s))
                if digest(c) != x[:16] or len(c) != struct.unpack("<I", x[16:])[0]:
                    raise ValueError(f"document {doc_id}: a stored chunk differs from its digest")
            data = b"".join(parts)
            media = struct.pack("<QI", n_bytes, len(listed)) + b"".join(listed) + b"".join(stored)
            rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
        if rows:
            yield batch(rows, OUT)


def store_payloads(docs: DataFrame) -> DataFrame:
    """The stored table of the texts of docs, written as Parquet in the shared folder; see the module's docstring."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    return stage(with_plan(docs, plan(docs, payload, HOW)).select("doc_id", "key", "text", "chunks").mapInArrow(lean(_store), STORED), "media")


def read_payloads(stored: DataFrame) -> DataFrame:
    """Rebuilds, verifies and measures every payload of a stored table."""
    docs = stored.where("kind = 0").select("doc_id", "key", "n_bytes", "listed", "own", "need")
    once = stored.where("kind = 1").select("digest", F.col("own")[0].alias("stored")).dropDuplicates(["digest"])
    others = fetched(docs.where(F.size("need") > 0), once, "stored")
    alone = docs.where(F.size("need") == 0).select("doc_id", "n_bytes", "listed", "own", F.lit(None).cast("array<struct<digest:binary,stored:binary>>").alias("others"))
    joined = docs.where(F.size("need") > 0).join(others, "key").select("doc_id", "n_bytes", "listed", "own", "others")
    return alone.mapInArrow(lean(_read), OUT).unionByName(joined.mapInArrow(lean(_read), OUT))


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_payloads(table(spark, sf_dir, "documents")))
