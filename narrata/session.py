"""The settings that queries rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # windows-1251, koi8-r, ibm866, iso-8859-5
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # captions: the last of equal keys wins
}


def tuned(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("narrata")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
