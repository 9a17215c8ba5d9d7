"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and distributed union-find.

SuperMinHash gives each shingle one pseudo-random permutation of the signature's slots: at rank j the shingle offers
j + r (r in [0, 1)) to the j-th slot of its permutation, and a slot keeps the least offer. Offers of one shingle to
different slots are anti-correlated, hence a lower variance than independent hashes; once every slot has an offer of rank
at most j no later rank can win, hence the early stop. Here a rank is taken for all shingles of many documents at once.

Documents with equal shingle sets fall into one class first. Classes that share a band are compared on their full sets,
but not as all pairs of a band: first with one pivot for each band. Where a band still holds several components, packed
blocks of its documents are compared on 16 bits of each shingle's hash, which bounds the similarity from above, and pairs
that may be linked are decided on their sets: first a forest of the likeliest ones over components, at most one for two
components, which joins nearly all of them, then all that are still in different components. So any two documents that
share a band end either compared or in one component. What the later links join are components, not their documents.

Defined cases: null or white text has no shingles (n_shingles 0), links with nothing and is kept; fewer words than the
shingle's length make one shingle of all words; rows with a null doc_id are kept, never linked, and have a null component;
rows that repeat a doc_id are one document, also where their texts differ: it is linked with whatever any of its texts is
linked with, and each of its rows has its own n_shingles and the same component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import hot_join, hot_keys, lean, mix64, salted, salted_join, small, stage, table

BANDS, ROWS = 32, 5
KEPT_WORDS = 150_000
#: Shingles signed at a time; with it the permutations of one step stay under 20 MB (slots are bytes, so at most 256).
STEP = 120_000
#: Documents in a block of the later comparisons, and pairs of components that a task holds before it gives out their forest.
BLOCK, HELD = 64, 100_000
#: Blocks of a band on one side of a cell of block pairs, about.
SIDE = 16
#: Rows of a label table that are written together, so that its many rounds don't leave many small files.
ROWS_A_FILE = 500_000
GOLD = 0x9E3779B97F4A7C15
#: A pair of classes, their components, and their similarity as far as known.
PROMISING = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("la", pa.int64()), ("lb", pa.int64()), ("like", pa.float64())])
EMPTY = np.iinfo(np.uint64).max


class Words(dict):
    """Word -> its 64-bit hash, for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(data: bytes, k: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a text in lower case (A-Z only)."""
    found = data.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out *= np.uint64(GOLD)
        out += h[j : len(h) - width + 1 + j]
        mix64(out)
    return np.unique(out)


def digest(s: np.ndarray) -> bytes:
    """What stands for a set: equal sets, and no others, share it."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sign(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets), m): rank in the upper 32 bits, r in the lower. No set may be empty."""
    sig = np.full((len(sets), m), EMPTY, np.uint64)
    if not sets:
        return sig
    flat = sig.reshape(-1)
    e = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    def at(j: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(e + np.uint64((2 * j + 1) * GOLD & (2**64 - 1)))
        return (h & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32), j + ((h >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)

    perm = None
    for j in range(m):
        value, slot = at(j)
        if perm is not None:
            each = np.arange(len(e))
            taken = perm[each, slot]
            perm[each, slot] = perm[:, j]
            perm[:, j] = taken
            slot = taken.astype(np.int64)
        np.minimum.at(flat, row * m + slot, value)
        going = (sig >= np.uint64((j + 1) << 32)).any(1)
        if not going.any():
            break
        left = going[row]
        if perm is None:
            e, row, slot = e[left], row[left], slot[left]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            perm[np.arange(len(e)), slot] = 0
            perm[:, 0] = slot
        elif left.mean() < 0.8:
            e, row, perm = e[left], row[left], perm[left]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.reshape(len(sig), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for i in range(rows):
        h *= np.uint64(GOLD)
        h += part[:, :, i]
        mix64(h)
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    words = Words()

    def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        for i, x in zip(full, band_keys(sign([sets[i] for i in full], bands * rows), bands, rows), strict=True):
            keys[i] = x
        same = [digest(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "same", "bands"])

    for b in batches:
        ids, sets, n = [], [], 0
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids.append(doc_id)
            sets.append(shingles((text.as_py() or "").encode(), k, words))
            n += len(sets[-1])
            if n > STEP:
                yield out(ids, sets)
                ids, sets, n = [], [], 0
        if ids:
            yield out(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        for at in range(0, len(b), 500):
            found = [s for t in b.slice(at, 500).column("text").to_pylist() if len(s := shingles((t or "").encode(), k, words))]
            short = [(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in ([digest(s) for s in found], [s.tobytes() for s in found], short)], ["same", "shingles", "short"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yes = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            yes.append(100 * both >= percent * (len(p) + len(q) - both))
        yield b.select([c for c in b.schema.names if c not in ("x", "y")]).filter(pa.array(yes, pa.bool_()))


def _forest(likeliest: dict[tuple[int, int], tuple[float, int, int]]) -> pa.RecordBatch:
    """Of the likeliest pairs (a, b) of every two components (la, lb), those of a spanning forest, the likeliest first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for (la, lb), (like, a, b) in sorted(likeliest.items(), key=lambda kv: (-kv[1][0], kv[0])):
        x, y = find(la), find(lb)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b, la, lb, like))
    return pa.RecordBatch.from_pylist([dict(zip(PROMISING.names, r, strict=True)) for r in out], PROMISING)


def _promising(batches: Iterator[pa.RecordBatch], percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs between two blocks of a band, of different components, that may be linked as far as 16 bits of each hash tell.

    Shortened hashes can only raise the intersection, so no link is lost. A pair is given out by the first band that it
    shares, the document of the lesser component first. forest: only such that form a forest over the components.
    """
    likeliest: dict[tuple[int, int], tuple[float, int, int]] = {}

    def read(x: pa.Array) -> tuple:
        bands = x.field("bands")
        return x.field("cls").to_numpy(), x.field("label").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint16) for s in x.field("short")], bands.flatten().to_numpy().reshape(len(x), -1)

    for b in batches:
        found = [[np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64)]]
        for band, x, y in zip(b.column("band").to_pylist(), b.column("x"), b.column("y"), strict=True):
            (doc, label, sets, keys), (docs, labels, others, bands) = read(x.values), read(y.values)
            n = np.array([len(s) for s in others])
            has = np.zeros((len(docs), 1 << 16), np.bool_)
            has[np.repeat(np.arange(len(docs)), n), np.concatenate(others)] = True
            for i, s in enumerate(sets):
                at = np.flatnonzero((labels != label[i]) & (100 * np.minimum(n, len(s)) >= percent * np.maximum(n, len(s))))
                at = at[bands[at, (bands[at] == keys[i]).argmax(1)] == band]
                if not len(at):
                    continue
                both = np.minimum(has[at[:, None], s].sum(1), n[at])
                ok = 100 * both >= percent * (n[at] + len(s) - both)
                at, like = at[ok], both[ok] / (n[at] + len(s) - both)[ok]
                if forest:
                    at, like = (v[np.argsort(-like, kind="stable")] for v in (at, like))
                    once = np.unique(labels[at], return_index=True)[1]
                    at, like = at[once], like[once]
                first = label[i] < labels[at]
                one, two = np.full(len(at), doc[i]), np.full(len(at), label[i])
                pair = [np.where(first, one, docs[at]), np.where(first, docs[at], one), np.minimum(two, labels[at]), np.maximum(two, labels[at]), like]
                if not forest:
                    found.append(pair)
                    continue
                for a, to, la, lb, r in zip(*(v.tolist() for v in pair), strict=True):
                    if (la, lb) not in likeliest or r > likeliest[la, lb][0]:
                        likeliest[la, lb] = r, a, to
            if len(likeliest) > HELD:
                yield _forest(likeliest)
                likeliest.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=PROMISING)
    if likeliest:
        yield _forest(likeliest)


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the least class reachable over links (a, b); by least neighbour and pointer jumping, to a fixpoint.

    A class with very many links, or a label with very many members, is a hot key of these joins: see common.hot_join.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    n = both.count()
    parts = 1 + n // ROWS_A_FILE
    hubs = stage(hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", n), "hubs")
    if not hubs.isEmpty():
        both = stage(salted(both, "b", "a", hubs), "links")
    else:
        both = both.withColumn("_salt", F.lit(0))
    labels = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("label"))
    labels = stage(labels.coalesce(parts), "labels")
    n = labels.count()
    while True:
        near = salted_join(both, labels.withColumnRenamed("cls", "b"), "b", hubs).groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("m"))
        hop = labels.join(near, "cls").select("cls", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = stage(hop.coalesce(parts), "hop")
        hot = hot_keys(hop.groupBy("label").agg(F.count("*").alias("n")), "label", n)
        jump = hot_join(hop, labels.select(F.col("cls").alias("label"), F.col("label").alias("far")), "label", "cls", hot).select("cls", "old", F.least("label", "far").alias("label"))
        jump = stage(jump.coalesce(parts), "labels")
        labels = jump.select("cls", "label")
        if jump.where("label <> old").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, label) after links of their components (la, lb). Only the components' graph is gone through again.

    A class that labels lacks is a component of its own.
    """
    roots = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    labels = labels.union(roots.join(labels, "cls", "left_anti").select("cls", F.col("cls").alias("label")))
    hot = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), "label", labels.count())
    found = hot_join(labels, roots.select(F.col("cls").alias("label"), F.col("label").alias("root")), "label", "cls", hot, "left")
    return stage(found.select("cls", F.coalesce("root", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Links join documents with 100 * intersection >= percent * union of their shingle sets. A pair at just 80 % shares none
    of 32 bands of 5 with probability 3e-6; every pair that shares one is decided on the full sets.

    Everything between the signatures and the result is about classes (cls), one for each different set. Their numbers
    are in the order of their least doc_id, so that the least class of a component has its least document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInArrow(lean(partial(_signed, k=shingle, bands=bands, rows=rows)), "doc_id long, n long, same binary, bands array<long>"), "signatures")
    named = signed.where("doc_id is not null")
    reps = named.where("n > 0").groupBy("same").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r"), F.count("*").alias("rows"))
    reps = reps.select("same", "rows", F.col("r.doc_id").alias("doc"), "r.n", "r.bands").repartitionByRange("doc").sortWithinPartitions("doc", "same")
    reps = stage(reps.withColumn("cls", F.monotonically_increasing_id()), "classes")

    each = reps.select("cls", "n", F.explode("bands").alias("band"))
    several = stage(each.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "n")).alias("p")).where("c > 1"), "bands")
    hot = hot_keys(several.select("band", F.col("c").alias("n")), "band", bands * reps.count())
    members = hot_join(each, several, "band", "cls", hot).select("band", "cls", "n", F.col("p.cls").alias("p"), F.col("p.n").alias("pn"))
    members = stage(members, "members")

    alike = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    candidates = stage(members.select("cls").distinct().join(reps.select("cls", "same", "doc"), "cls"), "candidates")
    ids = candidates.select(F.col("doc").alias("doc_id")).distinct()
    sets = docs.join(small(ids, 16 * candidates.count()), "doc_id", "left_semi").mapInArrow(lean(partial(_sets, k=shingle)), "same binary, shingles binary, short binary").dropDuplicates(["same"])
    sets = stage(sets.join(candidates.select("same", "cls"), "same").select("cls", "shingles", "short"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (staged) that are links. Both sets are sought out; that of a pivot is asked for by very many pairs."""
        n, joined = pairs.count(), pairs
        for one, by, held in (("a", "b", "x"), ("b", "a", "y")):
            hot = hot_keys(pairs.groupBy(one).agg(F.count("*").alias("n")), one, n)
            joined = hot_join(joined, sets.select(F.col("cls").alias(one), F.col("shingles").alias(held)), one, by, hot)
        return joined.select(*pairs.columns, "x", "y").mapInArrow(lean(partial(_verified, percent=percent)), pairs.schema)

    pairs = stage(members.where((F.col("cls") != F.col("p")) & alike("n", "pn")).select(*pair("cls", "p")).distinct(), "pairs")
    repeated = named.groupBy("doc_id").agg(F.min("same").alias("s"), F.max("same").alias("t"), F.count("same").alias("texts"), F.count("*").alias("rows"))
    repeated = stage(repeated.where("s <> t or texts between 1 and rows - 1").select("doc_id", F.col("s").alias("first")), "repeated")
    links = verified(pairs)
    if several_texts := not repeated.isEmpty():
        # a doc_id of several texts is one document: it links their classes
        of = lambda name: reps.select(F.col("same").alias(name), F.col("cls").alias("a" if name == "first" else "b"))
        own = named.where("n > 0").select("doc_id", "same").distinct().join(repeated, "doc_id").where("same <> first")
        links = links.union(own.join(of("first"), "first").join(of("same"), "same").select(*pair("a", "b")).distinct())
    labels = components(stage(links, "links"))
    seen = stage(reps.select("cls", "bands").join(sets.select("cls", "short"), "cls"), "seen")
    for forest in (True, False):
        parts = members.select("band", "cls").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        groups = stage(parts.groupBy("band", "label").agg(F.count("*").alias("c")), "groups")
        full = F.col("c") >= BLOCK
        blocks = F.sum(F.when(full, F.ceil(F.col("c") / BLOCK)).otherwise(0)) + F.ceil(F.sum(F.when(full, 0).otherwise(F.col("c"))) / BLOCK)
        several = groups.groupBy("band").agg(F.count("*").alias("k"), F.sum(F.when(full, 0).otherwise(F.col("c"))).alias("rest"), F.ceil(blocks / SIDE).alias("sides")).where("k > 1")
        groups = groups.join(several, "band").select("band", "label", F.when(full, F.col("label")).alias("own"), F.when(full, F.col("c")).otherwise(F.col("rest")).alias("size"), "sides", F.struct("band", "label").alias("group"), F.col("c").alias("n"))
        hot = hot_keys(groups, "group", members.count())
        parts = hot_join(parts.withColumn("group", F.struct("band", "label")).drop("band", "label"), groups.drop("n"), "group", "cls", hot)
        block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / BLOCK)).alias("block")
        parts = parts.join(seen, "cls").groupBy("band", "own", "sides", block).agg(F.collect_list(F.struct("cls", "label", "short", "bands")).alias("x"))
        blocks = stage(parts, "blocks")
        if blocks.isEmpty():
            break
        # the pairs of blocks of a band lie in a square of `sides` x `sides` cells; each cell is a key of its own, of about
        # SIDE blocks on either side, so a band of very many documents is no single task
        side = F.pmod(F.xxhash64("own", "block"), F.col("sides")).cast("int")
        all_sides = F.explode(F.sequence(F.lit(0), (F.col("sides") - 1).cast("int")))
        name = lambda own, block: F.struct(F.coalesce(F.col(own), F.lit(-1)), F.col(own).isNull(), F.col(block))
        these = blocks.select("band", "own", "block", "x", side.alias("row"), all_sides.alias("column"))
        other = blocks.select("band", F.col("own").alias("y_own"), F.col("block").alias("y_block"), F.col("x").alias("y"), side.alias("column"), all_sides.alias("row"))
        met = these.join(other, ["band", "row", "column"]).where((name("own", "block") <= name("y_own", "y_block")) & F.coalesce(F.col("own") != F.col("y_own"), F.lit(True)))
        met = met.select("band", "x", "y").mapInArrow(lean(partial(_promising, percent=percent, forest=forest)), "a long, b long, la long, lb long, like double")
        met = met.groupBy("la", "lb").agg(F.max(F.struct("like", "a", "b")).alias("p")).select("p.a", "p.b", "la", "lb") if forest else met.drop("like").distinct()
        more = stage(verified(stage(met, "pairs")), "links")
        if not more.isEmpty():
            labels = merged(labels, more)

    labels = stage(reps.select("cls", "same", "rows").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labels")
    hot = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), "label", labels.count())
    classes = hot_join(labels, reps.select(F.col("cls").alias("label"), F.col("doc").alias("component_id")), "label", "cls", hot).select("same", "rows", "component_id")
    classes = stage(classes, "components")
    hot = hot_keys(classes.select("same", F.col("rows").alias("n")), "same", signed.count())
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    out = hot_join(out, classes.drop("rows"), "same", "doc_id", hot, "left")
    if several_texts:  # rows without text of a document that has one in another row
        known = repeated.join(classes.select(F.col("same").alias("first"), F.col("component_id").alias("whole")), "first").drop("first")
        out = out.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "whole"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near duplicates of one with a smaller doc_id; all columns stay."""
    gone = stage(near_duplicates(docs, **how).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(small(gone, 16 * gone.count()), "doc_id", "left_anti").select(docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: The definition itself, without bands: all pairs that share a shingle, counted, and the closure of the links.
OP10_SQL = r"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
    SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, least(doc_id, coalesce(least, doc_id)) = doc_id AS kept
FROM s LEFT JOIN least_of USING (doc_id)"""
