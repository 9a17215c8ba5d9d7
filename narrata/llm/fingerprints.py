"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A sketch is the sorted array of the k least hashes of a document's five-word shingles (fewer words: one shingle of all of
them; no words: an empty sketch). The sketch of a union is the k least of two sketches, so sketches of parts can be merged
in any order. With at most k shingles every estimate is exact.

Defined cases: null text is empty; documents stand in descending order of doc_id, null last; rows that repeat a doc_id
share one place, each gets its own result, and the least beginning among them is what the document before takes; the only
document follows itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.llm.common import stage, table

K, WIDTH = 128, 5
WHITE = r"[\x20\x09-\x0D]+"


def sketched(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column in out. Each step is a column of its own, so that none is computed twice."""
    h, s = f"_{out}_h", f"_{out}_s"
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    n = F.size(h)
    wide = n >= WIDTH
    df = df.withColumn(h, F.transform(F.filter(F.split(text, WHITE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn(s, F.when(wide, pair(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1))))
    df = df.withColumn(s, F.when(wide, pair(F.slice(s, 1, n - 3), F.slice(s, 3, n - 3))))
    df = df.withColumn(s, F.when(wide, pair(F.slice(s, 1, n - 4), F.slice(h, 5, n - 4))).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)")))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(s)), 1, k)).drop(h, s)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) / the k-th least hash on a scale from 0 to 1."""
    last = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection / union: how many of the union's sketch are in both. Two empty sketches are alike."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), both / distinct(a, k))).otherwise(F.lit(1.0))


def spelled(a: Column) -> Column:
    """A sketch as text, 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def before(ids: DataFrame) -> DataFrame:
    """doc_id, prev_id: the document before each in descending order of doc_id, null last (before the first: the last).

    ids: one row for each doc_id. Dealt out by ranges, so that only one row for each range is put in order by itself.
    """
    order = F.col("doc_id").desc_nulls_last()
    ranged = ids.select("doc_id").repartitionByRange(order).sortWithinPartitions(order)
    placed = stage(ranged.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "order")
    ends = placed.groupBy("part").agg(F.max_by(F.struct("doc_id"), "pos").alias("end"))
    every = Window.partitionBy().orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(every), F.last("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    inside = placed.withColumn("prev", F.lag(F.struct("doc_id")).over(Window.partitionBy("part").orderBy("pos")))
    return inside.join(ends, "part").select("doc_id", F.coalesce("prev", "end")["doc_id"].alias("prev_id"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of the text that ends like the next document begins; see the contract of op5.

    The texts are shuffled once, by doc_id; beginnings (a third of a text) and sketches of k hashes once more.
    """
    # k and z stand for doc_id, with null equal to null; all joins and groups are on them and all read the same columns, so
    # that one shuffle of the texts serves both sides
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("z"))
    doc_id = F.when(~F.col("z"), F.col("k")).alias("doc_id")
    docs = docs.select(*key, F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    ids = stage(docs.groupBy("k", "z").agg(F.max(third).alias("need")).select(doc_id, "need"), "ids")
    needs = ids.select(F.col("doc_id").alias("p"), "need")
    nodes = before(ids).join(needs, F.col("prev_id").eqNullSafe(F.col("p")))
    nodes = stage(nodes.select(*key, F.coalesce("prev_id", F.lit(0)).alias("prev_k"), F.col("prev_id").isNull().alias("prev_z"), "need"), "nodes")
    here = sketched(docs.join(nodes, ["k", "z"]), "text", "next_sketch", k)
    heads = here.select(F.col("prev_k").alias("k"), F.col("prev_z").alias("z"), F.substring("text", F.lit(1), F.col("need")).alias("head"), "next_sketch")
    heads = heads.groupBy("k", "z").agg(F.min(F.struct("head", "next_sketch")).alias("next"))
    out = docs.join(heads, ["k", "z"]).withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next.head"), F.lit(1), third)))
    out = sketched(sketched(out, "text", "sketch", k), "edited", "edited_sketch", k)
    return out.select(
        doc_id, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next.next_sketch"), k).alias("near_next"),
    )


def op5_fingerprint_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
