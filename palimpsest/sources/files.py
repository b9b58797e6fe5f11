"""Reading and writing memories as files: Markdown notes, HTML pages, transcripts, JSON lines, SQLite exports as Parquet.

All readers are file sources of Spark, so they scale with the number of files
and a folder can be read as a stream as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPE_RULES = [("opinion", r"(?i)\b(prefers?|likes?|dislikes?)\b"), ("causal", r"(?i)\b(because|therefore|causes?)\b"), ("procedural", r"(?i)\b(how to|step|run)\b"), ("episodic", r"(?i)\b(today|yesterday|met|meeting)\b")]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row for each bullet or paragraph of the notes under ``path``: file, place, section, content, memory_type, importance.

    Headings name the section of what follows; ``**bold**`` or ``!`` raises the importance.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("place", "line"))
    w = W.partitionBy("file").orderBy("place")
    head = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_replace("line", r"^#{1,6}\s+", ""))
    x = lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    content = F.trim(F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)]|\[[ xX]\])\s+", ""))
    x = x.withColumn("content", content).filter((F.col("content") != "") & ~F.col("line").rlike(r"^#{1,6}\s"))
    kind = F.lit("factual")
    for name, rx in reversed(TYPE_RULES):
        kind = F.when(F.col("content").rlike(rx), name).otherwise(kind)
    importance = F.least(F.lit(1.0), 0.3 + 0.3 * F.col("content").rlike(r"\*\*").cast("int") + 0.2 * F.col("content").contains("!").cast("int"))
    return x.select("file", "place", "section", "content", kind.alias("memory_type"), F.round(importance, 2).alias("importance"))


def html_text(html):
    """The text of a page: scripts and styles go, block ends become line ends, tags go, the common entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for code, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(c))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Turns of transcripts (``speaker: text``), each with the four before it as context."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("turn", "line"))
    t = lines.filter(F.col("line").rlike(r"^\s*[^:]{1,40}:\s")).select("file", "turn", F.trim(F.regexp_extract("line", r"^\s*([^:]{1,40}):", 1)).alias("speaker"), F.trim(F.regexp_extract("line", r"^\s*[^:]{1,40}:\s(.*)$", 1)).alias("text"))
    return t.withColumn("context", F.collect_list("text").over(W.partitionBy("file").orderBy("turn").rowsBetween(-4, -1)))


def export_json(memories: DataFrame, path: str) -> None:
    """JSON lines by namespace folder; null namespaces are ``default``."""
    memories.withColumn("namespace", F.coalesce("namespace", F.lit("default"))).write.mode("overwrite").partitionBy("namespace").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``export_json`` wrote; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def topic_pages(topics: DataFrame) -> DataFrame:
    """One Markdown page for each topic (topic, content, created): its memories, oldest first, at most 200 of them shown."""
    w = W.partitionBy("topic").orderBy("created", "content")
    t = topics.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("topic"))).filter("r <= 200")
    page = t.groupBy("topic", "n").agg(F.array_sort(F.collect_list(F.struct("r", "content"))).alias("x"))
    body = F.array_join(F.transform("x", lambda z: F.concat(F.lit("- "), z["content"])), "\n")
    return page.select("topic", F.concat(F.lit("# "), "topic", F.lit("\n\n"), body, F.lit("\n")).alias("page"), F.col("n").alias("n_memories"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the last of a key wins by ``loaded_at``."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc("loaded_at")))
    fresh = new.withColumn("_r", r).filter("_r = 1").drop("_r")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)
