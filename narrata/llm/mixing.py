"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size (ties by a hash of doc_id, then doc_id), each with an expected number
of copies. The running sum of these, plus one random offset for each source, crosses whole numbers; a document is emitted
once for each that it crosses.

The expected copies of a source are all the same, target / size of the source, or (for each of PARTS) documents of over
that part of the target expect a whole number, 0 to `most`, and the others what is then missing to the target. A few large
documents can otherwise throw a small source far off its target. Each of these plans is drawn with OFFSETS offsets, evenly
spaced from a hashed start; the draw whose words come nearest to the target is taken (the first of equals). What all draws
would take is found in one pass: a document takes a copy more or less only at the two offsets where its ends cross.

The running sum needs a rank within the source, which may hold most rows: rows are dealt out by ranges of the whole sort
key, each part is numbered on its own, and the parts' counts (one row for each part and source) are summed before it.

Defined cases: null text has size 0; null is a source of its own, the last one; a source of size 0 has target 0; repeated
rows count each on their own; other columns go along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.llm.common import small, stage, table

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
PARTS, OFFSETS = (3, 10, 40), 64
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """_mix_source, _mix_source_size -> and _mix_target: the sizes' sum shared by weight, none above `most` times its size.

    One row for each source. With the sources in order of limit / weight, those that reach their limits come first: each
    is tested against the level that the rest would share.
    """
    every = Window.partitionBy()
    named = sources.withColumn("i", F.row_number().over(every.orderBy(F.col("_mix_source").asc_nulls_last())))
    named = named.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") - 1) % len(weights) + 1).cast("double"))
    named = named.withColumn("most", F.lit(most) * F.col("_mix_source_size"))
    order = every.orderBy(F.col("most") / F.col("w"), "i")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("_mix_source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(rest)
    named = named.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return named.withColumn("shared", shared).select("_mix_source", "_mix_source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("shared") * F.col("w")).alias("_mix_target"))


def mix(docs: DataFrame, source: str = "source", seed: int = 0, **how) -> DataFrame:
    """docs, with the size of each in _mix_size and its doc_id, and _mix_source_size, _mix_target, _mix_copies beside them."""
    docs = docs.withColumn("_mix_source", F.col(source)).withColumn("_mix_tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = ["_mix_source", "_mix_size", "_mix_tie", "doc_id"]
    ranged = docs.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = stage(ranged.withColumn("_mix_part", F.spark_partition_id()).withColumn("_mix_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mixed")
    parts = placed.groupBy("_mix_part", "_mix_source").agg(F.count("*").alias("n"), F.min("_mix_pos").alias("first"), F.sum("_mix_size").alias("words"))
    parts = stage(parts, "mix-parts")
    before = Window.partitionBy("_mix_source").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_mix_before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    goals = targets(parts.groupBy("_mix_source").agg(F.sum("words").alias("_mix_source_size")), **how)
    goals = stage(goals, "mix-goals")
    most = how.get("most", MOST)
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    parts = parts.join(goals.withColumnRenamed("_mix_source", "g"), same("_mix_source", "g"))
    parts = stage(parts.select(F.col("_mix_part").alias("p"), F.struct(F.col("_mix_source").alias("s"), "_mix_before", "_mix_source_size", "_mix_target").alias("_mix_in")), "mix-parts")
    n_parts = parts.count()
    out = placed.join(small(parts, 128 * n_parts), (F.col("_mix_part") == F.col("p")) & F.col("_mix_source").eqNullSafe(F.col("_mix_in.s")))
    size, goal = F.col("_mix_size"), F.col("_mix_in._mix_target")
    large = lambda part, x: F.sum(F.when(size * part > goal, x).otherwise(0))
    sums = out.groupBy("_mix_source").agg(F.max("_mix_in").alias("x"), F.count("*").alias("rows"), *(c.alias(f"{n}{part}") for part in PARTS for n, c in (("words", large(part, size)), ("large", large(part, F.lit(1))))))
    plans = stage(sums.select("_mix_source", F.col("x._mix_target").alias("goal"), F.col("x._mix_source_size").alias("all"), F.explode(_plans(most)).alias("plan")).where("plan.each between 0 and " + str(most)), "mix-plans")
    rows = out.select("_mix_source", "_mix_size", "_mix_pos", F.col("_mix_in._mix_before").alias("before"), F.col("_mix_part").alias("part"))
    listed = plans.groupBy("_mix_source").agg(F.collect_list("plan").alias("plans"))
    by_part = parts.select(F.col("p").alias("part"), F.col("_mix_in.s").alias("s")).join(listed, same("s", "_mix_source")).select("part", "s", "plans")
    rows = rows.join(small(by_part, n_parts * 40 * (1 + len(PARTS) * (most + 1))), (rows["part"] == by_part["part"]) & rows["_mix_source"].eqNullSafe(by_part["s"])).select("_mix_source", "_mix_size", (F.col("before") + F.col("_mix_pos")).alias("rank"), F.explode("plans").alias("plan"))
    rows = rows.select("_mix_source", "_mix_size", "plan.i", _running(F.col("plan"), F.col("rank")).alias("a"), _running(F.col("plan"), F.col("rank") + 1).alias("b"))
    first = lambda x: F.ceil(OFFSETS * (1 - (x - F.floor(x))) - _start("_mix_source", seed))  # noqa: E731  the first offset at which x crosses one more
    steps = F.array(
        F.struct(F.lit(0).cast("long").alias("k"), (F.floor("b") - F.floor("a")).alias("n")), F.struct(first(F.col("b")).alias("k"), F.lit(1).cast("long").alias("n")), F.struct(first(F.col("a")).alias("k"), F.lit(-1).cast("long").alias("n"))
    )
    steps = rows.select("_mix_source", "_mix_size", "i", F.explode(steps).alias("x")).where(F.col("x.k") < OFFSETS).groupBy("_mix_source", "i", "x.k").agg(F.sum(F.col("_mix_size") * F.col("x.n")).alias("words"))
    taken = F.sum("words").over(Window.partitionBy("_mix_source", "i").orderBy("k"))
    steps = steps.withColumn("taken", taken).withColumnRenamed("_mix_source", "s")
    draws = steps.join(plans, same("s", "_mix_source") & (F.col("plan.i") == F.col("i")))
    best = draws.groupBy("s").agg(F.min_by(F.struct("k", "plan"), F.struct(F.abs(F.col("taken") - F.col("goal")), "i", "k")).alias("best"))
    chosen = parts.join(best, F.col("_mix_in.s").eqNullSafe(F.col("s")), "left").select("p", F.col("_mix_in.s").alias("s"), "_mix_in", "best")
    chosen = stage(chosen, "mix-chosen")
    out = placed.join(small(chosen, 192 * n_parts), (F.col("_mix_part") == F.col("p")) & F.col("_mix_source").eqNullSafe(F.col("s")))
    rank, plan = F.col("_mix_in._mix_before") + F.col("_mix_pos"), F.col("best.plan")
    offset = (F.col("best.k") + _start("_mix_source", seed)) / OFFSETS
    copies = F.floor(_running(plan, rank + 1) + offset) - F.floor(_running(plan, rank) + offset)
    out = out.withColumn("_mix_source_size", F.col("_mix_in._mix_source_size")).withColumn("_mix_target", F.col("_mix_in._mix_target")).withColumn("_mix_copies", F.least(copies, F.lit(most)))
    return out.drop("p", "s", "best", "_mix_in", "_mix_part", "_mix_pos", "_mix_tie", "_mix_source")


def _start(source: str, seed: int) -> Column:
    """0 to 1, drawn for each source."""
    drawn = F.md5(F.concat(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), F.lit(f"/{seed}")))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _plans(most: int) -> Column:
    """array<struct<i, small, each, whole>> of a source: its first `small` documents expect `each` copies, the others `whole`."""
    goal, all_ = F.col("x._mix_target"), F.col("x._mix_source_size")
    plan = lambda i, small_, each, whole: F.struct(F.lit(i).alias("i"), small_.alias("small"), F.coalesce(each, F.lit(0.0)).alias("each"), F.lit(whole).alias("whole"))
    out = [plan(0, F.col("rows"), F.try_divide(goal, all_), 0)]
    for part in PARTS:
        words, large = F.col(f"words{part}"), F.col(f"large{part}")
        out += [plan(len(out) + w, F.col("rows") - large, F.try_divide(goal - words * w, all_ - words), w) for w in range(most + 1)]
    return F.array(*out)


def _running(plan: Column, rank: Column) -> Column:
    """The copies that the first `rank` documents expect."""
    return plan["each"] * F.least(rank, plan["small"]) + plan["whole"] * F.greatest(rank - plan["small"], F.lit(0))


def mixed_documents(docs: DataFrame, source: str = "source", **how) -> DataFrame:
    """docs with every row as often as the mix takes it.

    Only ids and sizes are put in order. Their copies come back to the rows by a key over all columns, broadcast while they
    are small, so the texts are read twice and not shuffled then. Rows that are equal in all columns share a key: they are
    put out once for each of the copies of all of them.
    """
    columns = docs.columns
    text, id_ = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    key = F.concat(F.unhex(F.md5(F.concat_ws("\n", id_, F.coalesce(source, F.lit("")), text))), F.unhex(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")))
    keyed = docs.withColumn("_mix_key", key)
    narrow = stage(keyed.select("_mix_key", "doc_id", F.col(source).alias("_mix_from"), size_of(F.col("text")).alias("_mix_size")), "sizes")
    taken = mix(narrow, "_mix_from", **how).groupBy("_mix_key").agg(F.sum("_mix_copies").alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    taken = stage(taken.where("_mix_copies > 0"), "taken")
    n, most = taken.agg(F.count("*"), F.max("_mix_rows")).head()
    out = keyed.join(small(taken.where("_mix_rows = 1"), 64 * n), "_mix_key")
    if (most or 0) > 1:
        out = out.unionByName(keyed.join(small(taken.where("_mix_rows > 1"), 64 * n), "_mix_key").dropDuplicates(["_mix_key"]))
    return out.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int")))).select(columns)


def op2_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("_mix_size")), "sizes")
    return mix(sizes).select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i, 3 * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level * w >= most THEN most::DOUBLE ELSE max(level) FILTER (WHERE level * w < most) OVER () * w END AS target,
  ('0x' || substr(md5(coalesce('s' || source, 'n') || '/0'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, source_size, target, u, count(*) AS n, {", ".join(f"CAST(sum(CASE WHEN size * {p} > target THEN size ELSE 0 END) AS BIGINT) AS words{p}, count(*) FILTER (WHERE size * {p} > target) AS large{p}" for p in PARTS)} FROM r GROUP BY ALL),
p AS ({" UNION ALL ".join(["SELECT source, target, u, 0 AS i, n AS small, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each, 0 AS whole FROM g", *(f"SELECT source, target, u, {1 + k * (MOST + 1) + w}, n - large{x}, CASE WHEN source_size > words{x} THEN (target - words{x} * {w}) / (source_size - words{x}) ELSE 0.0 END, {w} FROM g" for k, x in enumerate(PARTS) for w in range(MOST + 1))])}),
q AS (SELECT * FROM p WHERE each BETWEEN 0 AND {MOST}),
o AS (SELECT *, (k + u) / {OFFSETS} AS off FROM q, (SELECT unnest(range({OFFSETS})) AS k)),
b AS (SELECT r.source, o.i, o.k, o.target, o.off, o.small, o.each, o.whole, sum(r.size * (floor(o.each * least(r.rank + 1, o.small) + o.whole * greatest(r.rank + 1 - o.small, 0) + o.off) - floor(o.each * least(r.rank, o.small) + o.whole * greatest(r.rank - o.small, 0) + o.off))) AS taken
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source GROUP BY ALL),
c AS (SELECT source, arg_min({{'off': off, 'small': small, 'each': each, 'whole': whole}}, [abs(taken - target), i, k]) AS x FROM b GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target, r.size * least(CAST(floor(x.each * least(rank + 1, x.small) + x.whole * greatest(rank + 1 - x.small, 0) + x.off) - floor(x.each * least(rank, x.small) + x.whole * greatest(rank - x.small, 0) + x.off) AS BIGINT), {MOST}) AS taken
FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""
