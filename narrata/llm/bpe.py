"""BPE encoding and decoding with content-defined chunk reuse.

Documents are cut into chunks by a rolling hash. A chunk that occurs in several places is encoded once, by the document
that owns it, and its ids reach the other documents through a join on the chunk's digest. Chunk ends fall anywhere, so
each join of two chunks is repaired: the word fragments on both sides are put together and encoded anew, widened until
white space stands on either side. No pre-token crosses white space (it is dropped before merging), so from there on the
ids agree exactly with those of the whole text.

Rows: null text counts as empty (no tokens); repeated rows each get the same result; a table without rows gives none;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.chunking import chunks, digest, fetched, plan, with_plan
from narrata.llm.common import lean, stage, table, text_key

HOW = {"bits": 10, "least": 256, "most": 8192, "chars": True}
#: Pieces kept with their ids in each Python worker; the memory of the codec is bounded by it.
KEPT = 200_000
WHITE = b" \t\n\r\x0b\x0c"
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
STAGED = f"{OUT}, key binary, kind int, digest binary, pieces array<binary>, need array<binary>"

# Fixed values of the tokenizer file for which ASCII text is split here: its normalizer and its pre-tokenizer's pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: PATTERN over lower-case ASCII bytes.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The same, but all of a word in which there are other characters.
MIXED_PIECES = re.compile(rb"[^\s\x80-\xff]*+[\x80-\xff]\S*|" + ASCII_PIECES.pattern)
#: The longest word that MIXED_PIECES is used on, as it looks ahead from each piece to the end of the word.
LONGEST = 1000


class Codec:
    """A tokenizer file, and the pieces of text met lately with their ids and their decoded text.

    A piece is a pre-token where the text is ASCII and the file splits as PATTERN does, else what stands between white
    space. The library encodes every new piece, so ids are always its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        says = json.loads(self.of.to_str())
        if says["decoder"] is not None:
            raise ValueError(f"{path}: only tokenizers without a decoder are supported, whose tokens are joined by a space")
        split, byte_level = ((says["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        self.ascii = says["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": PATTERN} and byte_level.get("type") == "ByteLevel" and not byte_level["add_prefix_space"]
        self.special = [t["content"].encode() for t in says["added_tokens"]]
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}
        n = 1 + max(self.of.get_vocab(with_added_tokens=True).values())
        self.names = [(self.of.id_to_token(i) or "").encode() for i in range(n)]
        self.numbers = [b"%d" % i for i in range(n)]

    def split(self, data: bytes) -> list[bytes]:
        # a long word with other characters goes to the library as a whole, as looking ahead in it would be quadratic; the
        # ids are the same either way
        if self.ascii and not any(s in data for s in self.special):
            if data.isascii():
                return ASCII_PIECES.findall(data.lower())
            if len(max(words := data.split(), key=len)) <= LONGEST:
                return MIXED_PIECES.findall(data.lower())
            return words
        return data.split()

    def learn(self, pieces: list[bytes]) -> None:
        if not (new := set(pieces).difference(self.ids)):
            return
        if len(self.ids) + len(new) > KEPT:
            self.ids.clear()
            self.text.clear()
            new = set(pieces)
        letters = [p for p in new if p.isalpha() and p.islower()] if self.ascii else []  # bytes: ASCII letters only
        tokens = self.of.model.tokenize
        got = [(p, [t.id for t in tokens(p.decode())]) for p in letters]
        rest = list(new.difference(letters))
        got += ((p, e.ids) for p, e in zip(rest, self.of.encode_batch([p.decode() for p in rest], add_special_tokens=False), strict=True))
        for p, ids in got:
            self.ids[p], self.text[p] = self.spelled(ids)

    def spelled(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b" ".join([self.numbers[i] for i in ids]), b" ".join([self.names[i] for i in ids])

    def encoded(self, data: bytes) -> tuple[bytes, bytes]:
        """The ids of a text, and what they decode to, both joined by a space."""
        pieces = self.split(data)
        self.learn(pieces)
        ids, text = (b" ".join(map(of.__getitem__, pieces)) for of in (self.ids, self.text))
        if not all(map(self.ids.__getitem__, set(pieces))):  # a piece may have no ids
            ids, text = (b" ".join(filter(None, map(of.__getitem__, pieces))) for of in (self.ids, self.text))
        return ids, text

    def whole(self, data: bytes) -> tuple[int, str, str]:
        return result(*self.encoded(data))

    def piece(self, chunk: bytes) -> bytes:
        """A chunk's own part: the fragment before its first white space, the one after its last, the ids between."""
        ends = re.split(rb"[ \t-\r]+", chunk)
        if len(ends) == 1:
            return struct.pack("<BII", 1, len(chunk), 0) + chunk
        first, last = ends[0], ends[-1]
        middle = chunk[len(first) : len(chunk) - len(last)]
        return struct.pack("<BII", 0, len(first), len(last)) + first + last + np.array(self.encoded(middle)[0].split(), np.uint32).tobytes()

    def joined(self, pieces: list[bytes]) -> tuple[int, str, str]:
        """Of a document's pieces in order; the seams are encoded anew."""
        done: list[tuple[bytes, bytes]] = []
        seam = b""
        for p in pieces:
            single, a, b = struct.unpack_from("<BII", p)
            first, last, middle = p[9 : 9 + a], p[9 + a : 9 + a + b], p[9 + a + b :]
            seam += first
            if not single:
                done += [self.encoded(seam), self.spelled(np.frombuffer(middle, np.uint32).tolist())]
                seam = last
        done.append(self.encoded(seam))
        return result(*(b" ".join(filter(None, x)) for x in zip(*done, strict=True)))


def result(ids: bytes, text: bytes) -> tuple[int, str, str]:
    return ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec, names = Codec(path), [f.split()[0] for f in STAGED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    for b in batches:
        for at in range(0, len(b), 512):
            part, rows = b.slice(at, 512), []
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            for doc_id, key, data, planned in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), texts, part.column("chunks").to_pylist(), strict=True):
                owned = {x["digest"]: x["owned"] for x in planned or ()}
                cut = [(digest(c), c) for c in chunks(data, **HOW)] if owned else []
                rows += [(None, None, None, None, None, 2, d, [codec.piece(c)], None) for d, c in dict(cut).items() if owned.get(d)]
                if all(owned.get(d, True) for d, _ in cut):
                    rows.append((doc_id, *codec.whole(data), key, 0, None, None, None))
                else:
                    pieces = [b"\1" + codec.piece(c) if owned.get(d, True) else b"\0" + d for d, c in cut]
                    rows.append((doc_id, None, None, None, key, 1, None, pieces, list({p[1:] for p in pieces if p[:1] == b"\0"})))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _join(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for b in batches:
        rows = []
        for doc_id, pieces, others in zip(b.column("doc_id").to_pylist(), b.column("pieces").to_pylist(), b.column("others").to_pylist(), strict=True):
            got = {x["digest"]: x["piece"] for x in others}
            rows.append((doc_id, *codec.joined([p[1:] if p[:1] == b"\1" else got[p[1:]] for p in pieces])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], [f.split()[0] for f in OUT.split(", ")])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; tokenizer is the path of a tokenizers file.

    The texts are read twice and not shuffled while the table of shared chunks is small (see common.BROADCAST_LIMIT).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    staged = stage(with_plan(docs, plan(docs, bytes, HOW)).select("doc_id", "key", "text", "chunks").mapInArrow(lean(partial(_encode, path=tokenizer)), STAGED), "bpe-pieces")
    columns = [f.split()[0] for f in OUT.split(", ")]
    open_ = staged.where("kind = 1").select("doc_id", "key", "pieces", "need")
    once = staged.where("kind = 2").select("digest", F.col("pieces")[0].alias("piece")).dropDuplicates(["digest"])
    others = fetched(open_, once, "piece")
    closed = open_.join(others, "key").select("doc_id", "pieces", "others").mapInArrow(lean(partial(_join, path=tokenizer)), OUT)
    return staged.where("kind = 0").select(columns).unionByName(closed)


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
