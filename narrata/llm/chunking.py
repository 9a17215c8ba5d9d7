"""Content-defined chunks: a gear hash rolls over the bytes and cuts where its top bits are zero.

The same passage is cut the same way in any document, so equal passages give equal chunk digests. plan() finds, with
Spark joins over all documents, which digests occur more than once and which document owns each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import hot_join, hot_keys, lean, mix64, small, stage

GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: The hash at a byte depends on this many bytes up to it.
WINDOW = 32
#: Bytes hashed at a time.
STEP = 1 << 21


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: h[i] = sum of GEAR[data[i - j]] << j, by doubling instead of a loop."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        shifted = h[:-s] << np.uint32(s)
        h[s:] += shifted
    return h


def cuts(data: bytes, bits: int, least: int, most: int, chars: bool) -> list[int]:
    """Ends of the chunks of data: where the top `bits` of the hash are 0, at least `least` and about `most` bytes apart.

    chars: data is UTF-8 and no chunk ends inside a character.
    """
    n = len(data)
    if n <= least:
        return [n]
    found: list[int] = []
    for at in range(0, n, STEP):
        lead = min(at, WINDOW - 1)
        h = gear(np.frombuffer(data, np.uint8, min(STEP, n - at) + lead, at - lead))
        found += (np.flatnonzero(h[lead:] < np.uint32(1 << (32 - bits))) + (at + 1)).tolist()
    ends, last = [], 0

    def aligned(i: int) -> int:
        while chars and i < n and data[i] & 0xC0 == 0x80:
            i += 1
        return i

    for c in [*found, n]:
        while c - last > most:
            last = aligned(last + most)
            ends.append(last)
        if c < n and c - last >= least and (c := aligned(c)) < n:
            ends.append(c)
            last = c
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes, **how) -> list[bytes]:
    ends = cuts(data, **how)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch], prepare, how: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[digest(c) for c in chunks(prepare((t or "").encode()), **how)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.list_(pa.binary()))], ["key", "digests"])


def plan(docs: DataFrame, prepare, how: dict) -> tuple[DataFrame, int]:
    """(key, chunks array of (digest, owned)): the chunks of each document that occur elsewhere too; and its size in bytes.

    docs: key, text. prepare: from a text's bytes to those that are cut. The owner of a digest is the document with the
    least key. Only digests move: about 32 bytes for each chunk, summed by digest before they are joined.
    """
    each = docs.select("key", "text").mapInArrow(lean(partial(_digests, prepare=prepare, how=how)), "key binary, digests array<binary>").select("key", F.explode("digests").alias("digest"))
    each = stage(each, "chunk-digests")
    shared = stage(each.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("owner")).where("n > 1"), "chunk-shared")
    hot = hot_keys(shared.select("digest", "n"), "digest", each.count())
    refs = hot_join(each, shared.drop("n"), "digest", "key", hot).select("key", F.struct("digest", (F.col("key") == F.col("owner")).alias("owned")).alias("chunk"))
    out = stage(refs.groupBy("key").agg(F.collect_set("chunk").alias("chunks")), "chunk-plan")
    n = out.agg(F.sum(F.size("chunks") * 24 + 48)).head()[0] or 0
    return out, n


def fetched(needs: DataFrame, once: DataFrame, held: str) -> DataFrame:
    """(key, others array of (digest, held)): what each key needs of the shared chunks. needs: key, need; once: digest, held.

    A passage in very many documents is a hot key: see common.hot_join.
    """
    n = needs.agg(F.sum(F.size("need"))).head()[0] or 0
    each = needs.select("key", F.explode("need").alias("digest"))
    hot = stage(hot_keys(each.groupBy("digest").agg(F.count("*").alias("n")), "digest", n), "hot-chunks")
    return hot_join(each.distinct(), once, "digest", "key", hot).groupBy("key").agg(F.collect_list(F.struct("digest", held)).alias("others"))


def with_plan(docs: DataFrame, planned: tuple[DataFrame, int]) -> DataFrame:
    """docs with the chunks of plan(); broadcast only if small, else joined by key in a shuffle."""
    return docs.join(small(*planned), "key", "left")
