"""A streaming front end: artifacts that arrive as files are classified, counted and merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import ingest

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def reports(spark: SparkSession, folder: str, per_trigger: int = 1_000) -> DataFrame:
    """key, title, bug_type, family of report files as they arrive; the title is the first line."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_trigger).load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = f.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("key"), F.regexp_extract(text, r"^[^\r\n]*", 0).alias("title"))
    return out.select("key", "title", classify.bug_type(F.col("title")).alias("bug_type"), classify.family(F.col("title")).alias("family"))


def attempts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window, event_type, n, users of a stream of events; late ones are waited for, repeated ids count once."""
    own = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = own.groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select("window.start", "window.end", "event_type", "n", "users")


def merge_into(store_root: str):
    """A foreachBatch function that adds a batch of (key, content) payloads to a blob folder, new ones only.

    Blobs lie in folders by the first two digits of their digest, and only the folders of the batch's digests are read.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{store_root}/blobs"
        prefix = lambda digest: F.concat(F.lit("x"), F.substring(digest, 1, 2))
        digests = batch.where("content is not null").select(prefix(F.sha2(F.col("content").cast("binary"), 256)))
        met = [r[0] for r in digests.distinct().collect()]  # 256 at most
        try:
            known = spark.read.parquet(path).where(F.col("prefix").isin(*met)).select("sha256")
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "sha256 string")
        new = ingest.new_blobs(known, batch).withColumn("prefix", prefix(F.col("sha256")))
        new.write.mode("append").partitionBy("prefix").parquet(path)

    return merge
