"""What is written: plans, metadata of published items, paths, and publication that can be repeated."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import letters

UNKNOWN_AUTHOR = "Неизвестный автор"
PLAN = "array<struct<chapter_index:int,chapter_title:string,index:bigint,text:string>>"


def plans_as_json(plan: DataFrame) -> DataFrame:
    """doc_id, json: a document's plan as one JSON array in order."""
    row = F.struct("chapter_index", "chapter_title", "index", "text")
    ordered = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", row.alias("row")))).alias("all"))
    return ordered.select("doc_id", F.to_json("all.row", {"ignoreNullFields": "false"}).alias("json"))


def plans_from_json(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", F.explode(F.from_json("json", PLAN)).alias("c")).select("doc_id", "c.*")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def base_name(title: Column, author: Column, source: Column) -> Column:
    return F.when(given(author).isNotNull() & given(title).isNotNull(), F.concat(author, F.lit(" - "), title)).otherwise(F.coalesce(given(title), stem(source)))


def library_path(author: Column, title: Column, series: Column, index: Column, source: Column, content_hash: Column, job_id: Column) -> Column:
    """Author/[Series/][NN - ]Title [hash-job]."""
    name = letters.safe_filename
    prefix = F.when(given(series).isNotNull() & given(index).isNotNull(), F.concat(name(index, most=16), F.lit(" - "))).otherwise(F.lit(""))
    folder = F.concat(prefix, name(F.coalesce(given(title), stem(source))), F.lit(" ["), F.substring(content_hash, 1, 12), F.coalesce(F.concat(F.lit("-"), job_id.cast("string")), F.lit("")), F.lit("]"))
    return F.concat_ws("/", name(F.coalesce(given(author), F.lit(UNKNOWN_AUTHOR))), F.when(given(series).isNotNull(), name(series)), folder)


def output_name(base: Column, part: Column, of: Column, most: int = 240) -> Column:
    suffix = F.when(of > 1, F.format_string("_part_%02d.m4b", part)).otherwise(F.lit(".m4b"))
    cut = F.when(of > 1, letters.cut_bytes(base, most - 12)).otherwise(letters.cut_bytes(base, most - 4))
    return F.concat(F.coalesce(given(F.regexp_replace(cut, "[ .]+$", "")), F.lit("audiobook")), suffix)


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def package_file(title: Column, author: Column, series: Column, index: Column, source: Column, narrator: str) -> Column:
    """The metadata file of a published item, as XML."""
    quoted = lambda x: F.replace(escaped(x), F.lit('"'), F.lit("&quot;"))
    meta = lambda name, x: F.when(given(series).isNotNull() & given(x).isNotNull(), F.concat(F.lit(f'<opf:meta name="calibre:{name}" content="'), quoted(x), F.lit('" />')))
    return F.concat_ws(
        "", F.lit("<?xml version='1.0' encoding='utf-8'?>\n<opf:package xmlns:dc=\"http://purl.org/dc/elements/1.1/\" xmlns:opf=\"http://www.idpf.org/2007/opf\" version=\"2.0\"><opf:metadata><dc:title>"),
        escaped(F.coalesce(given(title), stem(source))), F.lit("</dc:title><dc:creator>"), escaped(F.coalesce(given(author), F.lit(UNKNOWN_AUTHOR))),
        F.lit(f'</dc:creator><dc:language>ru</dc:language><dc:creator opf:role="nrt">{narrator}</dc:creator>'), meta("series", series), meta("series_index", index), F.lit("</opf:metadata></opf:package>"),
    )


def overridden(metadata: DataFrame, overrides: DataFrame) -> DataFrame:
    """Metadata of files, replaced field by field by what their senders said."""
    fields = ("title", "author", "series", "series_index")
    return metadata.join(overrides.select("path", *(F.col(f).alias(f"_{f}") for f in fields)), "path", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in metadata.columns))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """What path holds, with the receipt of each item; null if nothing has been published there."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    there = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*"))
    return spark.read.parquet(path).drop("batch") if there else None


def publish(items: DataFrame, path: str) -> int:
    """Publishes the items (content_hash, job_id, ...) that path does not hold yet, all or none; how many were new.

    An item's receipt is the hash of its other columns. The new items are written to a hidden staging folder, whose name
    is changed once, to one that depends on them alone: a reader sees all of a batch or nothing, a broken run leaves only
    staging behind, repeating a batch writes nothing, and of two writers of one batch the second finds it there. An item
    that path holds with another receipt is an error, and nothing is written. Rows that repeat an item are published once; unlike
    rows of one item are an error too. The change of name is atomic where the file system's is (HDFS, local disks).
    """
    spark: SparkSession = items.sparkSession
    key = ["content_hash", "job_id"]
    rest = [c for c in items.columns if c not in key]
    receipt = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit(""), 256)
    items = items.withColumn("receipt", receipt).dropDuplicates([*key, "receipt"])
    if not items.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("unlike rows of one item")
    old = published(spark, path)
    if old is not None:
        known = old.select(*key, F.col("receipt").alias("_known"))
        if not items.join(known, key).where("receipt <> _known").isEmpty():
            raise ValueError("an item is there with other content; it is not overwritten")
        items = items.join(known, key, "left_anti")
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    staging = fs.Path(f"{path}/.staging-{uuid.uuid4().hex}")
    system = staging.getFileSystem(conf)
    try:
        items.write.parquet(staging.toString())
        n, name = spark.read.schema(items.schema).parquet(staging.toString()).agg(F.count("*"), F.bit_xor(F.xxhash64(*key, "receipt"))).first()
        if not n:
            return 0
        plain = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(system.getUri(), conf).rename(staging, fs.Path(f"{path}/batch={n}-{name & (1 << 64) - 1:016x}"), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.toString():
                raise
            return 0
        return n
    finally:
        system.delete(staging, True)
